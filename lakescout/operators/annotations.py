"""Annotations, comments and tags on columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Relations that are stored from the target to the source.
REVERSED = {"SUPERCLASS": "SUBCLASS", "CONTAINER": "MEMBER"}


def annotate(sources: DataFrame, targets: DataFrame | None, author: str, kind: str, text: str, relation: str | None = None) -> DataFrame:
    """Annotation rows on each source, or on each (source, target) of a relation."""
    rows = sources.select(F.col("nid").alias("source"))
    rows = rows.withColumn("target", F.lit(None).cast("string")) if targets is None else rows.crossJoin(F.broadcast(targets.select(F.col("nid").alias("target"))))
    if relation in REVERSED:
        rows, relation = rows.select(F.col("target").alias("source"), F.col("source").alias("target")), REVERSED[relation]
    key = F.md5(F.concat_ws("|", F.lit(author), F.lit(kind), F.lit(text), "source", F.coalesce("target", F.lit("")), F.lit(relation or "")).cast("binary"))
    return rows.select(key.alias("id"), F.lit(author).alias("author"), F.lit(kind).alias("class"), F.lit(text).alias("text"), "source", "target", F.lit(relation).cast("string").alias("relation"), F.expr("cast(array() as array<string>)").alias("tags"))


def add_tags(annotations: DataFrame, tags: DataFrame) -> DataFrame:
    """Tags (id, tag) of annotations that exist."""
    grouped = tags.groupBy("id").agg(F.collect_set("tag").alias("new"))
    return annotations.join(grouped, "id", "left").withColumn("tags", F.array_sort(F.array_union("tags", F.coalesce("new", F.expr("cast(array() as array<string>)"))))).drop("new")


def search(annotations: DataFrame, nids: DataFrame, relation: str | None = None) -> DataFrame:
    """Annotations on the nids, from either end of the relation."""
    found = annotations if relation is None else annotations.where(F.col("relation") == relation)
    ends = found.select("*", F.explode(F.array_compact(F.array("source", "target"))).alias("_end"))
    return ends.join(nids.select(F.col("nid").alias("_end")).distinct(), "_end", "left_semi").drop("_end").distinct()


def keyword_search(annotations: DataFrame, keyword: str) -> DataFrame:
    text = F.concat_ws(" ", F.col("text"), F.array_join("tags", " "))
    return annotations.where(F.lower(text).contains(keyword.lower()))
