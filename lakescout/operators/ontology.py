"""Matching of columns to the classes of an ontology, given as (id, name, parent)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescout.functions.text import name_tokens
from lakescout.operators.vectors import dot


def name_matches(classes: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(class_id, nid, jaccard) of class and column names that share words."""
    c = classes.select(F.col("id").alias("class_id"), F.array_distinct(name_tokens(F.col("name"))).alias("ct"))
    n = nodes.select("nid", F.array_distinct(name_tokens(F.col("field_name"))).alias("nt"))
    shared = c.select("class_id", F.explode("ct").alias("t")).join(n.select("nid", F.explode("nt").alias("t")), "t").groupBy("class_id", "nid").agg(F.count(F.lit(1)).alias("s"))
    sized = shared.join(c.select("class_id", F.size("ct").alias("c")), "class_id").join(n.select("nid", F.size("nt").alias("n")), "nid")
    return sized.select("class_id", "nid", (F.col("s") / (F.col("c") + F.col("n") - F.col("s"))).alias("jaccard")).where(F.col("jaccard") >= least)


def semantic_matches(a: DataFrame, b: DataFrame, vectors: DataFrame, positive: float = 0.5) -> DataFrame:
    """(a, b, similarity): the mean product of the vectors of words that two names don't share."""
    x = a.toDF("a", "ta").join(vectors.toDF("ta", "va"), "ta")
    y = b.toDF("b", "tb").join(vectors.toDF("tb", "vb"), "tb")
    pairs = x.join(F.broadcast(y), F.col("ta") != F.col("tb")).groupBy("a", "b").agg(F.avg(dot(F.col("va"), F.col("vb"))).alias("similarity"))
    return pairs.where(F.col("similarity") > positive)


def is_a_links(matches: DataFrame, classes: DataFrame) -> DataFrame:
    """(nid, other): columns that match a class and its parent."""
    child = matches.select(F.col("class_id").alias("id"), "nid")
    parent = matches.select(F.col("class_id").alias("parent"), F.col("nid").alias("other"))
    return child.join(classes.select("id", "parent"), "id").join(parent, "parent").where("nid <> other").select("nid", "other").distinct()


def aggregates(similarities: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, largest, least and median of the similarities of a group."""
    return similarities.groupBy(key).agg(F.avg(value).alias("mean"), F.max(value).alias("largest"), F.min(value).alias("least"), F.call_function("percentile", F.col(value), F.lit(0.5)).alias("median"))
