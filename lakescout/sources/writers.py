"""Writers of the catalogue: tables, edge lists and triples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_profile(profile: DataFrame, path: str, version: str | None = None) -> None:
    """The profile as Parquet; of repeated nids the last version, if rows have one."""
    from lakescout.operators.profile import latest_by_nid

    (latest_by_nid(profile, version) if version else profile).write.mode("overwrite").parquet(path)


def write_network(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def write_network_csv(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.select("nid", F.concat_ws(".", "source_name", "field_name").alias("node")).write.mode("overwrite").csv(f"{path}/nodes")
    edges.select("src_nid", "dst_nid", F.lit(1).alias("weight")).write.mode("overwrite").csv(f"{path}/edges")


def triples(edges: DataFrame, base: str) -> DataFrame:
    """(value): a line of N-Triples for each edge."""
    iri = lambda c: F.concat(F.lit(f"<{base}"), c, F.lit(">"))
    return edges.select(F.concat_ws(" ", iri(F.col("src_nid")), iri(F.lower("relation")), iri(F.col("dst_nid")), F.lit(".")).alias("value"))


def write_view(view: DataFrame, path: str, number: int) -> None:
    view.write.mode("overwrite").option("header", True).csv(f"{path}/view_{number}")


def discard(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()
