"""Keyword search over the catalogue: ranked, exact, fuzzy and prefix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakescout.functions.text import words

K1, B = 1.2, 0.75


def postings(docs: DataFrame) -> DataFrame:
    """(nid, term, tf) of (nid, text)."""
    return docs.select("nid", F.explode(words(F.col("text"))).alias("term")).groupBy("nid", "term").agg(F.count(F.lit(1)).alias("tf"))


def occurrences(tokens: str, term: str):
    return F.size(F.filter(tokens, lambda x: x == term))


def bm25(docs: DataFrame, query: str, n: int) -> DataFrame:
    """(nid, score): the n best texts. Only the query's terms are counted, in one pass over the texts."""
    terms = sorted(set(w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split()))
    tokens = docs.select("nid", words(F.col("text")).alias("w"))
    counted = tokens.select("nid", F.size("w").alias("dl"), *(occurrences("w", t).alias(f"tf{i}") for i, t in enumerate(terms)))
    stats = counted.agg(F.count(F.lit(1)).alias("N"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    parts = []
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("N") - df + 0.5) / (df + 0.5))
        parts.append(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))))
    score = F.round(reduce(lambda a, b: a + b, parts), 6)
    hit = reduce(lambda a, b: a | b, [F.col(f"tf{i}") > 0 for i in range(len(terms))])
    return counted.where(hit).join(F.broadcast(stats), F.lit(True)).select("nid", score.alias("score")).orderBy(F.desc("score"), "nid").limit(n)


def field_search(names: DataFrame, query: str, n: int) -> DataFrame:
    """(nid, score): ranked matches of a name, then names that contain the query with score 0.5."""
    ranked = bm25(names, query, n).withColumn("branch", F.lit(0))
    like = names.where(F.col("text").ilike(f"%{query}%")).select("nid", F.lit(0.5).alias("score"), F.lit(1).alias("branch")).join(ranked.select("nid"), "nid", "left_anti").select("nid", "score", "branch")
    return ranked.select("nid", "score", "branch").union(like).orderBy("branch", F.desc("score"), "nid").limit(n).select("nid", "score")


def exact_content(docs: DataFrame, keyword: str, n: int) -> DataFrame:
    import re

    return docs.where(F.col("text").rlike(rf"\b{re.escape(keyword)}\b")).select("nid", F.lit(1.0).alias("score")).orderBy("nid").limit(n)


def exact_name(names: DataFrame, keyword: str, n: int) -> DataFrame:
    return names.where(F.col("text") == keyword).select("nid", F.lit(1.0).alias("score")).orderBy("nid").limit(n)


def like_name(names: DataFrame, keyword: str, n: int) -> DataFrame:
    return names.where(F.col("text").ilike(f"%{keyword}%")).select("nid", F.lit(1.0).alias("score")).orderBy("nid").limit(n)


def fuzzy(docs: DataFrame, keyword: str, edits: int, n: int) -> DataFrame:
    """(nid, edits, score): texts with a token within so many edits of the keyword, nearest first."""
    tokens = docs.select("nid", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("t"))
    distance = F.levenshtein(F.col("t"), F.lit(keyword.lower()), edits)
    near = tokens.where(F.abs(F.length("t") - len(keyword)) <= edits).select("nid", distance.alias("d")).where("d >= 0").groupBy("nid").agg(F.min("d").alias("edits"))
    return near.select("nid", F.col("edits").cast("int").alias("edits"), (1.0 / (1 + F.col("edits"))).alias("score")).orderBy("edits", "nid").limit(n)


def suggest(names: DataFrame, prefix: str, edits: int, n: int) -> DataFrame:
    """(name, edits): distinct names whose beginning is within so many edits of the prefix."""
    head = F.substring(F.lower("text"), 1, len(prefix))
    return names.select(F.col("text").alias("name"), F.levenshtein(head, F.lit(prefix.lower())).cast("int").alias("edits")).where(F.col("edits") <= edits).distinct().orderBy("edits", "name").limit(n)


def any_of(results: list[DataFrame]) -> DataFrame:
    """Union of hits, each nid with its best score."""
    return reduce(DataFrame.unionByName, results).groupBy("nid").agg(F.max("score").alias("score"))


def first_of_each(hits: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy("priority", F.desc("score"), "nid")
    return hits.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def contains_entity(profile: DataFrame, keyword: str, n: int) -> DataFrame:
    """(nid, score): columns whose entities contain the keyword."""
    return profile.where(F.col("entities").contains(keyword)).select("nid", F.lit(1.0).alias("score")).orderBy("nid").limit(n)


def automatic_edits(keyword: str) -> int:
    """Edits that a fuzzy search allows if none are named: 0 up to 2 characters, 1 up to 5, else 2."""
    return 0 if len(keyword) <= 2 else 1 if len(keyword) <= 5 else 2


def fuzzy_auto(docs: DataFrame, keyword: str, n: int) -> DataFrame:
    return fuzzy(docs, keyword, automatic_edits(keyword), n)


def by_nid(nodes: DataFrame, nids: list[str]) -> DataFrame:
    """The names of columns given by nid."""
    return nodes.where(F.col("nid").isin(nids)).select("nid", "db_name", "source_name", "field_name")


def path_of(profile: DataFrame, nid: str) -> DataFrame:
    """(nid, path): where the table of a column is stored."""
    return profile.where(F.col("nid") == nid).select("nid", "path")


def similar_names(names: DataFrame, query: str, n: int, tokens) -> DataFrame:
    """(nid, cosine): the n names nearest to the query by tf-idf cosine, exactly. ``tokens`` makes words of a text;
    words of the query that no name has don't count."""
    from lakescout.operators.edges import tfidf

    docs = names.select(F.col("nid").alias("key"), tokens(F.col("text")).alias("terms"))
    asked = names.sparkSession.range(1).select(F.explode(tokens(F.lit(query))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("tf"))
    # The query's few words.
    held = tfidf(docs).join(F.broadcast(asked), "term")
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    wanted = asked.join(df, "term").join(F.broadcast(total), F.lit(True)).select("term", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("q"))
    length = wanted.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("length"))
    weights = wanted.join(F.broadcast(length), F.lit(True)).select("term", (F.col("q") / F.col("length")).alias("q"))
    found = held.select("key", "term", "w").join(F.broadcast(weights), "term").groupBy(F.col("key").alias("nid")).agg(F.round(F.sum(F.col("w") * F.col("q")), 6).alias("cosine"))
    return found.orderBy(F.desc("cosine"), "nid").limit(n)
