"""Typed edges between columns: similarity joins over profiles and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakescout.config import DEFAULT, DiscoveryConfig


def intervals(profile: DataFrame) -> DataFrame:
    """(nid, left, right, domain, min_value, max_value, median) of numeric columns: median -+ iqr."""
    return profile.where("data_type = 'N'").select("nid", "min_value", "max_value", "median", (F.col("median") - F.col("iqr")).alias("left"), (F.col("median") + F.col("iqr")).alias("right")).withColumn("domain", F.col("right") - F.col("left"))


def interval_pairs(profile: DataFrame, least: float) -> DataFrame:
    """(ref, cand, overlap, ratio, ...) of columns whose intervals overlap by a share of at least ``least`` of ref's.

    An interval that holds such a share contains one of the probe points that cut ref's into parts below that share.
    Every candidate lies in at most two cells of the level of its width, every probe in one cell of each level there
    is, so the join is on equal cells instead of all pairs.
    """
    v = intervals(profile).where("domain > 0")
    level = F.ceil(F.log2("domain")).cast("int")
    width = F.pow(F.lit(2.0), F.col("level"))
    cand = v.select(*(F.col(c).alias(f"c_{c}") for c in v.columns), level.alias("level"))
    cells = F.array_distinct(F.array(F.floor(F.col("c_left") / width).cast("double"), F.floor(F.col("c_right") / width).cast("double")))
    cand = cand.select("*", F.explode(cells).alias("cell"))
    # The levels that occur: at most a few thousand, as doubles have so many exponents.
    levels = cand.select("level").distinct()
    parts = int(1 / least) + 1
    probes = F.explode(F.array(*(F.lit(i / parts) for i in range(1, parts))))
    ref = v.select("*", probes.alias("_at")).select("*", (F.col("left") + F.col("_at") * F.col("domain")).alias("probe")).drop("_at")
    ref = ref.join(F.broadcast(levels), F.lit(True)).select("*", F.floor(F.col("probe") / width).cast("double").alias("cell"))
    overlap = F.least("right", "c_right") - F.greatest("left", "c_left")
    met = ref.join(cand, ["level", "cell"]).where("nid <> c_nid").select("nid", "c_nid", "domain", "c_domain", "min_value", "max_value", "c_min_value", "c_max_value", (overlap / F.col("domain")).alias("overlap"), (F.col("c_domain") / F.col("domain")).alias("ratio"))
    return met.where(F.col("overlap") >= least).distinct()


def top_per(pairs: DataFrame, key: str, score: str, tie: str, k: int) -> DataFrame:
    return pairs.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), tie))).where(F.col("_r") <= k).drop("_r")


def canonical(pairs: DataFrame, a: str, b: str, relation: str, score, last) -> DataFrame:
    """One undirected edge for each pair; of several scores, the one with the largest ``last``."""
    rows = pairs.select(F.least(a, b).alias("src_nid"), F.greatest(a, b).alias("dst_nid"), score.alias("score"), last.alias("_last"))
    return rows.groupBy("src_nid", "dst_nid").agg(F.max_by("score", "_last").alias("score")).select("src_nid", "dst_nid", F.lit(relation).alias("relation"), "score")


def numeric_content(profile: DataFrame, config: DiscoveryConfig = DEFAULT) -> DataFrame:
    """CONTENT_SIM of numeric columns: intervals that mostly coincide. The column with the smaller domain writes last."""
    th = config.num_overlap_th
    good = interval_pairs(profile, th).where((F.col("ratio") >= th))
    best = top_per(good, "nid", "overlap", "c_nid", config.max_degrees)
    return canonical(best, "nid", "c_nid", "CONTENT_SIM", F.round("overlap", 4), F.struct((-F.col("domain")).alias("d"), F.col("nid").alias("n")))


def inclusion(profile: DataFrame, config: DiscoveryConfig = DEFAULT) -> DataFrame:
    """INCLUSION_DEPENDENCY of numeric columns: a range within another one's that overlaps its middle."""
    th = config.inclusion_dep_th
    good = interval_pairs(profile, th).where((F.col("ratio") >= th) & (F.col("c_min_value") >= F.col("min_value")) & (F.col("c_max_value") <= F.col("max_value")) & (F.col("c_min_value") >= 0))
    best = top_per(good, "nid", "overlap", "c_nid", config.max_degrees)
    return canonical(best, "nid", "c_nid", "INCLUSION_DEPENDENCY", F.lit(1.0), F.lit(1))


def zero_iqr(profile: DataFrame, config: DiscoveryConfig = DEFAULT) -> DataFrame:
    """CONTENT_SIM of numeric columns without spread: medians in one island of gaps of at most eps.

    With two points making a cluster, density clustering in one dimension is gaps and islands. Islands of more than
    ``max_degrees`` columns give nothing, so pairs within an island are bounded.
    """
    eps, th = config.dbscan_eps, config.num_overlap_th
    points = intervals(profile).where("domain = 0").select("nid", F.col("left").alias("m"))
    # One row for each such column of the lake.
    order = Window.orderBy("m", "nid")
    gap = F.when(F.col("m") - F.lag("m").over(order) > eps, 1).otherwise(0)
    islands = points.withColumn("_gap", gap).withColumn("island", F.sum("_gap").over(order)).drop("_gap")
    sizes = islands.groupBy("island").agg(F.count(F.lit(1)).alias("n")).where(f"n between 2 and {config.max_degrees}")
    a, b = islands.join(sizes, "island").select("island", "nid", "m"), islands.select("island", F.col("nid").alias("nid2"), F.col("m").alias("m2"))
    distance = F.abs(F.col("m") - F.col("m2"))
    score = F.when(distance == 0, 1.0).otherwise(1.0 - (distance / eps) * (1.0 - th))
    score = F.round(F.greatest(F.lit(th), F.least(F.lit(1.0), score)), 4)
    return a.join(b, "island").where("nid < nid2").select(F.col("nid").alias("src_nid"), F.col("nid2").alias("dst_nid"), F.lit("CONTENT_SIM").alias("relation"), score.alias("score"))


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst_nid").alias("src_nid"), F.col("src_nid").alias("dst_nid"), "relation", "score"))


def pkfk(edges: DataFrame, nodes: DataFrame, config: DiscoveryConfig = DEFAULT) -> DataFrame:
    """PKFK between a nearly unique column and what includes it (numbers) or resembles it (text)."""
    n = nodes.select(F.col("nid").alias("src_nid"), "data_type", F.col("cardinality").alias("card"))
    other = nodes.select(F.col("nid").alias("dst_nid"), F.col("cardinality").alias("card2"))
    around = symmetric(edges).join(n, "src_nid").join(other, "dst_nid").where(F.col("card") > config.pkfk_cardinality_th)
    fits = around.where(((F.col("data_type") == "N") & (F.col("relation") == "INCLUSION_DEPENDENCY")) | ((F.col("data_type") == "T") & (F.col("relation") == "CONTENT_SIM")))
    return canonical(fits, "src_nid", "dst_nid", "PKFK", F.greatest("card", "card2"), F.lit(1))


def same_table(nodes: DataFrame) -> DataFrame:
    a = nodes.select("source_name", F.col("nid").alias("src_nid"))
    b = nodes.select("source_name", F.col("nid").alias("dst_nid"))
    return a.join(b, "source_name").where("src_nid < dst_nid").select("src_nid", "dst_nid", F.lit("SCHEMA").alias("relation"), F.lit(1.0).alias("score"))


def tfidf(docs: DataFrame, sublinear: bool = False) -> DataFrame:
    """(key, term, w): L2-normalised tf-idf of (key, terms) with smooth idf."""
    tf = docs.select("key", F.explode("terms").alias("term")).groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"))
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1) * ((1 + F.log("tf")) if sublinear else F.col("tf"))
    raw = tf.join(df, "term").join(F.broadcast(total), F.lit(True)).select("key", "term", weight.alias("w"))
    norms = raw.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, "key").select("key", "term", (F.col("w") / F.col("norm")).alias("w"))


def cosine_pairs(vectors: DataFrame) -> DataFrame:
    """(a, b, cosine) of keys that share a term, a < b: a join on terms, never all pairs."""
    a, b = vectors.toDF("a", "term", "wa"), vectors.toDF("b", "term", "wb")
    return a.join(b, "term").where("a < b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))


def schema_sim(nodes: DataFrame, terms, k: int = DEFAULT.schema_sim_neighbours) -> DataFrame:
    """SCHEMA_SIM: the k nearest names of each column by tf-idf cosine, with score 1."""
    docs = nodes.select(F.col("nid").alias("key"), terms.alias("terms"))
    both = cosine_pairs(tfidf(docs)).select("a", "b", F.round("cosine", 6).alias("cosine"))
    directed = both.union(both.select("b", "a", "cosine")).where("cosine > 0")
    best = top_per(directed, "a", "cosine", "b", k)
    return best.select(F.least("a", "b").alias("src_nid"), F.greatest("a", "b").alias("dst_nid"), F.lit("SCHEMA_SIM").alias("relation"), F.lit(1.0).alias("score"), "cosine").distinct()


def banded_pairs(signatures: DataFrame, bands: int, rows: int) -> DataFrame:
    """(a, b) of columns that share a band of MinHash, a < b."""
    keys = F.array(*(F.hash(F.lit(b), *(F.element_at("minhash", b * rows + r + 1) for r in range(rows))) for b in range(bands)))
    banded = signatures.select("nid", F.posexplode(keys).alias("band", "bucket"))
    a, b = banded.withColumnRenamed("nid", "a"), banded.withColumnRenamed("nid", "b")
    return a.join(b, ["band", "bucket"]).where("a < b").select("a", "b").distinct()


def text_content_unverified(signatures: DataFrame, bands: int, rows: int) -> DataFrame:
    """CONTENT_SIM of all text columns that share a band, with score 1 and nothing compared further."""
    return banded_pairs(signatures, bands, rows).select(F.col("a").alias("src_nid"), F.col("b").alias("dst_nid"), F.lit("CONTENT_SIM").alias("relation"), F.lit(1.0).alias("score"))


def text_content(signatures: DataFrame, bands: int, rows: int, config: DiscoveryConfig = DEFAULT) -> DataFrame:
    """CONTENT_SIM of text columns: candidates share a band of MinHash, and the signatures' agreement reaches the threshold."""
    from lakescout.functions.minhash import estimated_jaccard

    pairs = banded_pairs(signatures, bands, rows)
    left, right = signatures.toDF("a", "ma"), signatures.toDF("b", "mb")
    scored = pairs.join(left, "a").join(right, "b").select("a", "b", estimated_jaccard(F.col("ma"), F.col("mb")).alias("j")).where(F.col("j") >= config.minhash_threshold)
    directed = scored.union(scored.select("b", "a", "j"))
    best = top_per(directed, "a", "j", "b", config.max_degrees)
    return best.select(F.least("a", "b").alias("src_nid"), F.greatest("a", "b").alias("dst_nid"), F.lit("CONTENT_SIM").alias("relation"), F.round("j", 4).alias("score")).distinct()


def exact_jaccard(tokens: DataFrame, least: float) -> DataFrame:
    """(a, b, jaccard) of keys of distinct (key, token) by shared tokens."""
    sizes = tokens.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    a, b = tokens.toDF("a", "token"), tokens.toDF("b", "token")
    both = a.join(b, "token").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    out = both.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    return out.select("a", "b", (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("jaccard")).where(F.col("jaccard") >= least)


def value_overlap(a: DataFrame, b: DataFrame, th: float = DEFAULT.join_overlap_th) -> DataFrame:
    """(n_a, n_b, shared, overlaps) of two one-column frames of values."""
    x, y = a.toDF("v").where("v is not null").distinct(), b.toDF("v").where("v is not null").distinct()
    counts = x.withColumn("side", F.lit(1)).union(y.withColumn("side", F.lit(2))).groupBy("v").agg(F.sum("side").alias("s"))
    out = counts.agg(F.count_if(F.col("s") != 2).alias("n_a"), F.count_if(F.col("s") != 1).alias("n_b"), F.count_if(F.col("s") == 3).alias("shared"))
    return out.withColumn("overlaps", F.col("shared") > th * (F.col("n_a") + F.col("n_b")))


def ks_statistic(a: DataFrame, b: DataFrame) -> DataFrame:
    """(d, n_a, n_b) of two one-column samples: the largest distance of their distribution functions.

    Counts by distinct value are summed in order; ranges of values are summed apart first, so that no task sorts all.
    """
    counts = a.toDF("x").where("x is not null").select("x", F.lit(1).alias("ca"), F.lit(0).alias("cb")).union(b.toDF("x").where("x is not null").select("x", F.lit(0), F.lit(1))).groupBy("x").agg(F.sum("ca").alias("ca"), F.sum("cb").alias("cb"))
    ranged = counts.repartitionByRange("x").withColumn("part", F.spark_partition_id())
    totals = ranged.groupBy("part").agg(F.sum("ca").alias("ta"), F.sum("cb").alias("tb"))
    before = totals.select("part", (F.sum("ta").over(Window.orderBy("part")) - F.col("ta")).alias("pa"), (F.sum("tb").over(Window.orderBy("part")) - F.col("tb")).alias("pb"), F.sum("ta").over(Window.partitionBy()).alias("na"), F.sum("tb").over(Window.partitionBy()).alias("nb"))
    inner = Window.partitionBy("part").orderBy("x")
    gaps = ranged.join(F.broadcast(before), "part").select("na", "nb", F.abs((F.col("pa") + F.sum("ca").over(inner)) / F.col("na") - (F.col("pb") + F.sum("cb").over(inner)) / F.col("nb")).alias("gap"))
    return gaps.agg(F.max("gap").alias("d"), F.max("na").alias("n_a"), F.max("nb").alias("n_b"))


def ks_similar(a: DataFrame, b: DataFrame, d_th: float = 0.1, p_th: float = 0.05) -> DataFrame:
    """(d, p, similar): two samples are alike where the distance is small and not significant; p is asymptotic."""
    n = F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))
    # The alternating series settles within a few terms unless its argument is near 0, where p is 1.
    at = (n + 0.12 + 0.11 / n) * F.col("d")
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * k * k * F.col("at") * F.col("at")))
    p = F.when(F.col("at") < 0.2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))
    out = ks_statistic(a, b).withColumn("at", at).withColumn("p", p)
    return out.select("d", "p", ((F.col("d") < d_th) & (F.col("p") > p_th)).alias("similar"))


def text_tfidf(cells: DataFrame, terms, k: int = DEFAULT.schema_sim_neighbours) -> DataFrame:
    """CONTENT_SIM of text columns: the k nearest of each by tf-idf cosine of the words of all its values.

    Words are counted by column before anything is compared, so a column's size only matters to the count.
    """
    counts = cells.select(F.col("nid").alias("key"), F.explode(terms).alias("term")).groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"))
    total = counts.select("key").distinct().agg(F.count(F.lit(1)).alias("n"))
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = counts.join(df, "term").join(F.broadcast(total), F.lit(True)).select("key", "term", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    norms = raw.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    vectors = raw.join(norms, "key").select("key", "term", (F.col("w") / F.col("norm")).alias("w"))
    both = cosine_pairs(vectors).select("a", "b", F.round("cosine", 6).alias("cosine")).where("cosine > 0")
    best = top_per(both.union(both.select("b", "a", "cosine")), "a", "cosine", "b", k)
    return best.select(F.least("a", "b").alias("src_nid"), F.greatest("a", "b").alias("dst_nid"), F.lit("CONTENT_SIM").alias("relation"), F.col("cosine").alias("score")).distinct()
