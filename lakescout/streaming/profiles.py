"""Incremental profiles: micro-batches of a table's rows merged into mergeable statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def partial_profile(cells: DataFrame) -> DataFrame:
    """(nid, n, hll, lo, hi, total) of (nid, value) cells: what can be merged with another batch's."""
    x = F.col("value").try_cast("double")
    return cells.groupBy("nid").agg(F.count("value").alias("n"), F.hll_sketch_agg("value", 14).alias("hll"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.sum(x).alias("total"))


def merged(parts: DataFrame) -> DataFrame:
    return parts.groupBy("nid").agg(F.sum("n").alias("n"), F.hll_union_agg("hll").alias("hll"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("total").alias("total"))


def finished(parts: DataFrame) -> DataFrame:
    m = merged(parts)
    return m.select("nid", F.col("n").alias("total_values"), F.hll_sketch_estimate("hll").alias("unique_values"), F.col("lo").alias("min_value"), F.col("hi").alias("max_value"), (F.col("total") / F.col("n")).alias("avg_value"))


def follow(cells: DataFrame, path: str, checkpoint: str):
    """Append the partial profile of every micro-batch of a stream of (nid, value); batches are written once each."""

    def write(batch: DataFrame, number: int) -> None:
        partial_profile(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return cells.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
