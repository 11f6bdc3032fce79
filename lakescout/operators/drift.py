"""Change of columns between two snapshots, by the values that they share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """(nid, jaccard, change) of (nid, value) cells: similarity of distinct values, scaled by the sizes' ratio."""
    x = before.distinct().withColumn("s", F.lit(1)).unionByName(after.distinct().withColumn("s", F.lit(2)))
    counts = x.groupBy("nid", "value").agg(F.sum("s").alias("s")).groupBy("nid").agg(F.count_if(F.col("s") != 2).alias("a"), F.count_if(F.col("s") != 1).alias("b"), F.count_if(F.col("s") == 3).alias("c"))
    jaccard = F.col("c") / (F.col("a") + F.col("b") - F.col("c"))
    scaled = F.least(F.lit(1.0), jaccard * F.when(F.col("a") > 0, F.col("b") / F.col("a")).otherwise(1.0))
    return counts.select("nid", jaccard.alias("jaccard"), (1 - scaled).alias("change"))


def changed(changes: DataFrame, more_than: float) -> DataFrame:
    return changes.where(F.col("change") > more_than).select("nid")
