"""Result sets with provenance: set algebra by nid, explanations and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("nid", "source_name").agg(F.max("score").alias("score"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("nid"), "nid", "left_semi")


def intersection_by_table(a: DataFrame, b: DataFrame) -> DataFrame:
    """All hits of either side whose table is in both."""
    return union(a.join(b.select("source_name"), "source_name", "left_semi"), b.join(a.select("source_name"), "source_name", "left_semi"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("nid"), "nid", "left_anti")


def tables(hits: DataFrame) -> DataFrame:
    return hits.select("source_name").distinct()


def ends(provenance: DataFrame) -> DataFrame:
    """(nid, kind): origins, which nothing leads to ('leaf'), and results, which lead to nothing ('head')."""
    src, dst = provenance.select(F.col("src_nid").alias("nid")).distinct(), provenance.select(F.col("dst_nid").alias("nid")).distinct()
    return src.join(dst, "nid", "left_anti").withColumn("kind", F.lit("leaf")).union(dst.join(src, "nid", "left_anti").withColumn("kind", F.lit("head")))


def paths(provenance: DataFrame, max_hops: int) -> DataFrame:
    """(origin, nid, path, ops): every simple path from an origin, grown hop by hop."""
    leaves = ends(provenance).where("kind = 'leaf'")
    grown = leaves.select(F.col("nid").alias("origin"), "nid", F.array("nid").alias("path"), F.expr("cast(array() as array<string>)").alias("ops"))
    found = grown
    for _ in range(max_hops):
        grown = grown.join(provenance, F.col("nid") == F.col("src_nid")).where(~F.array_contains("path", F.col("dst_nid"))).select("origin", F.col("dst_nid").alias("nid"), F.concat("path", F.array("dst_nid")).alias("path"), F.concat("ops", F.array("op")).alias("ops"))
        found = found.union(grown)
    return found


def why(all_paths: DataFrame) -> DataFrame:
    """(nid, origin): the origins of each element."""
    return all_paths.where(F.size("path") > 1).select("nid", "origin").distinct()


def how(all_paths: DataFrame) -> DataFrame:
    """(nid, explanation): 'a --[OP]--> b ...' for each path."""
    steps = F.zip_with("ops", F.slice("path", 2, F.size("ops")), lambda o, p: F.concat(F.lit(" --["), o, F.lit("]--> "), p))
    return all_paths.where(F.size("path") > 1).select("nid", F.concat(F.element_at("path", 1), F.array_join(steps, "")).alias("explanation"))


def certainty(all_paths: DataFrame, scores: DataFrame) -> DataFrame:
    """(nid, certainty): the largest sum of scores along a path that ends in the element; negative sums count as 0 on the way."""
    steps = all_paths.select("nid", "path", F.posexplode("path").alias("at", "step")).join(scores.toDF("step", "s"), "step")
    ordered = steps.groupBy("nid", "path").agg(F.array_sort(F.collect_list(F.struct("at", "s"))).alias("steps"))
    total = F.aggregate("steps", F.lit(0.0), lambda a, x: F.greatest(a, F.lit(0.0)) + x["s"])
    return ordered.groupBy("nid").agg(F.max(total).alias("certainty"))


def coverage(all_paths: DataFrame) -> DataFrame:
    """(nid, coverage): the share of all origins that lead to the element."""
    leaves = all_paths.where(F.size("path") == 1).agg(F.count_distinct("origin").alias("n"))
    each = why(all_paths).groupBy("nid").agg(F.count_distinct("origin").alias("c"))
    return each.join(F.broadcast(leaves), F.lit(True)).select("nid", (F.col("c") / F.col("n")).alias("coverage"))
