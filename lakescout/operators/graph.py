"""Navigation over the column graph: neighbours, traversal and paths as joins on frontiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakescout.operators.edges import symmetric
from lakescout.operators.lineage import cut


def of_relation(edges: DataFrame, relation: str | None) -> DataFrame:
    return symmetric(edges if relation is None else edges.where(F.col("relation") == relation))


def neighbours(edges: DataFrame, nodes: DataFrame, start: DataFrame, relation: str | None = None) -> DataFrame:
    """Hits next to any of the start nids, each with its best score."""
    met = of_relation(edges, relation).join(start.select(F.col("nid").alias("src_nid")).distinct(), "src_nid", "left_semi")
    best = met.groupBy(F.col("dst_nid").alias("nid")).agg(F.max("score").alias("score"))
    return best.join(nodes.select("nid", "db_name", "source_name", "field_name"), "nid")


def traverse(edges: DataFrame, start: DataFrame, relation: str | None, max_hops: int) -> DataFrame:
    """(nid, depth) of everything within so many hops: a frontier joins the edges and drops what was seen."""
    both = of_relation(edges, relation).select("src_nid", "dst_nid").distinct()
    seen = start.select("nid").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for hop in range(1, max_hops + 1):
        step = frontier.select(F.col("nid").alias("src_nid")).join(both, "src_nid").select(F.col("dst_nid").alias("nid")).distinct()
        frontier = cut(step.join(seen, "nid", "left_anti").withColumn("depth", F.lit(hop)))
        seen = seen.union(frontier)
    return seen


def shortest_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, relation: str | None, max_hops: int, every: bool = False) -> DataFrame:
    """(source, target, hops, path) of the shortest paths; of equal ones the least, or all if ``every``."""
    both = of_relation(edges, relation).select("src_nid", "dst_nid").distinct()
    paths = sources.select(F.col("nid").alias("source"), F.col("nid").alias("at"), F.array("nid").alias("path"))
    seen = paths.select("source", "at")
    found = paths
    for _ in range(max_hops):
        step = paths.join(both, F.col("at") == F.col("src_nid")).select("source", F.col("dst_nid").alias("at"), F.concat("path", F.array("dst_nid")).alias("path"))
        step = step.join(seen, ["source", "at"], "left_anti")
        if not every:
            step = step.groupBy("source", "at").agg(F.min("path").alias("path"))
        paths = cut(step)
        seen = seen.union(paths.select("source", "at").distinct())
        found = found.union(paths)
    hit = found.join(targets.select(F.col("nid").alias("at")).distinct(), "at", "left_semi")
    return hit.select("source", F.col("at").alias("target"), (F.size("path") - 1).alias("hops"), "path")


def table_paths(edges: DataFrame, nodes: DataFrame, source: str, target: str, relation: str, max_hops: int) -> DataFrame:
    """(hops, path) of all simple table paths: each hop leaves a column of the table and enters one of another."""
    n = nodes.select("nid", "source_name")
    hops = of_relation(edges, relation).join(n.toDF("src_nid", "src_table"), "src_nid").join(n.toDF("dst_nid", "dst_table"), "dst_nid").where("src_table <> dst_table").select("src_table", "dst_table", F.concat_ws(">", "src_nid", "dst_nid").alias("hop")).distinct()
    spark = edges.sparkSession
    paths = spark.createDataFrame([(source, [source], [])], "at string, tables array<string>, path array<string>")
    found = None
    for _ in range(max_hops):
        step = paths.where(F.col("at") != target).join(hops, F.col("at") == F.col("src_table")).where(~F.array_contains("tables", F.col("dst_table")))
        paths = cut(step.select(F.col("dst_table").alias("at"), F.concat("tables", F.array("dst_table")).alias("tables"), F.concat("path", F.array("hop")).alias("path")))
        done = paths.where(F.col("at") == target)
        found = done if found is None else found.union(done)
    return found.select(F.size("path").alias("hops"), F.concat_ws("|", "path").alias("path"))


def closure(edges: DataFrame, start: DataFrame, relation: str | None = None) -> DataFrame:
    """(nid, depth) of everything reachable: hops until nothing new comes, with the frontier cut from its lineage."""
    both = of_relation(edges, relation).select("src_nid", "dst_nid").distinct()
    both = cut(both)
    seen = start.select("nid").distinct().withColumn("depth", F.lit(0))
    frontier, hop = seen, 0
    while True:
        hop += 1
        step = frontier.select(F.col("nid").alias("src_nid")).join(both, "src_nid").select(F.col("dst_nid").alias("nid")).distinct()
        frontier = cut(step.join(seen, "nid", "left_anti").withColumn("depth", F.lit(hop)))
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)


def degrees(edges: DataFrame, k: int) -> DataFrame:
    """(nid, degree) of the k columns with the most edges, parallel ones counted."""
    return symmetric(edges).groupBy(F.col("src_nid").alias("nid")).agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "nid").limit(k)


def relation_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


def table_scores(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(table_a, table_b, relation, score): the best edge of each pair of tables."""
    n = nodes.select("nid", "source_name")
    both = edges.join(n.toDF("src_nid", "s"), "src_nid").join(n.toDF("dst_nid", "d"), "dst_nid").where("s <> d")
    return both.groupBy(F.least("s", "d").alias("table_a"), F.greatest("s", "d").alias("table_b"), "relation").agg(F.max("score").alias("score"))


def edge_type_bits(edges: DataFrame, codes: dict[str, int]) -> DataFrame:
    """(src_nid, dst_nid, types): one bit for each relation of a pair."""
    bits = F.lit(0)
    for relation, code in codes.items():
        bits = F.when(F.col("relation") == relation, F.lit(1 << code)).otherwise(bits)
    return edges.groupBy("src_nid", "dst_nid").agg(F.bit_or(bits).alias("types"))


def cross_table(hits: DataFrame, table: str, k: int) -> DataFrame:
    """The best hit of each other table, best first."""
    w = Window.partitionBy("source_name").orderBy(F.desc("score"), "nid")
    best = hits.where(F.col("source_name") != table).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return best.withColumn("score", F.round("score", 4)).orderBy(F.desc("score"), "nid").limit(k)


def synthetic_network(spark, tables: int, columns: int, jumps: dict[str, tuple[int, float]]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a made-up lake: column i is linked to column i + jump by each relation."""
    n = tables * columns
    ids = spark.range(n)
    name = lambda i: F.concat(F.lit("syn"), F.floor(i / columns), F.lit(".f"), i % columns)
    nodes = ids.select(name(F.col("id")).alias("nid"), F.lit("syndb").alias("db_name"), F.concat(F.lit("syn"), F.floor(F.col("id") / columns)).alias("source_name"), F.concat(F.lit("f"), F.col("id") % columns).alias("field_name"), F.lit("T").alias("data_type"), F.lit(0.5).alias("cardinality"))
    edges = None
    for relation, (jump, score) in jumps.items():
        e = ids.where(F.col("id") + jump < n).select(name(F.col("id")).alias("src_nid"), name(F.col("id") + jump).alias("dst_nid"), F.lit(relation).alias("relation"), F.lit(score).alias("score"))
        edges = e if edges is None else edges.union(e)
    return nodes, edges
