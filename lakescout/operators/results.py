"""Result sets that carry where they come from: every operation adds its edges, and set algebra merges them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakescout.operators import drs

HIT = ["nid", "source_name", "score"]
#: Operations whose origin is a text that the user gave.
LOOKUPS = {"KW_LOOKUP", "SCHNAME_LOOKUP", "ENTITY_LOOKUP"}
EDGE = "src_nid string, dst_nid string, op string, mark string"


@dataclass(frozen=True)
class ResultSet:
    """Hits (nid, source_name, score); all that led to them, as (nid, score) and (src_nid, dst_nid, op, mark)."""

    hits: DataFrame
    origins: DataFrame
    edges: DataFrame
    by_table: bool = False

    def absorb_provenance(self, other: ResultSet, mark: str | None = None) -> ResultSet:
        """The provenance of both. Edges that lead to a hit of both sets get the mark ('AND', 'OR')."""
        # An edge of both sets is one edge; of its marks the least that isn't null stays.
        edges = self.edges.unionByName(other.edges).groupBy("src_nid", "dst_nid", "op").agg(F.min("mark").alias("mark"))
        if mark is not None:
            shared = self.hits.select(F.col("nid").alias("dst_nid")).join(other.hits.select(F.col("nid").alias("dst_nid")), "dst_nid", "left_semi").distinct().withColumn("_both", F.lit(True))
            edges = edges.join(shared, "dst_nid", "left").withColumn("mark", F.when(F.col("_both"), F.lit(mark)).otherwise(F.col("mark"))).drop("_both")
        origins = self.origins.unionByName(other.origins).groupBy("nid").agg(F.max("score").alias("score"))
        return replace(self, origins=origins, edges=edges.select("src_nid", "dst_nid", "op", "mark"))

    def _with(self, hits: DataFrame, other: ResultSet, mark: str | None) -> ResultSet:
        return replace(self.absorb_provenance(other, mark), hits=hits.select(*HIT))

    def absorb(self, other: ResultSet) -> ResultSet:
        """Hits and provenance of both, without marks."""
        same_mode(self, other)
        return self._with(drs.union(self.hits, other.hits), other, None)

    def union(self, other: ResultSet) -> ResultSet:
        same_mode(self, other)
        return self._with(drs.union(self.hits, other.hits), other, "OR")

    def intersection(self, other: ResultSet) -> ResultSet:
        same_mode(self, other)
        hits = drs.intersection_by_table(self.hits, other.hits) if self.by_table else drs.intersection(self.hits, other.hits)
        return self._with(hits, other, "AND")

    def difference(self, other: ResultSet) -> ResultSet:
        """Hits that the other set lacks; in table mode, hits of tables that it lacks. Provenance stays its own."""
        same_mode(self, other)
        if self.by_table:
            return replace(self, hits=self.hits.join(other.hits.select("source_name"), "source_name", "left_anti").select(*HIT))
        return replace(self, hits=drs.difference(self.hits, other.hits).select(*HIT))

    def paths(self, max_hops: int) -> DataFrame:
        return drs.paths(self.edges.select("src_nid", "dst_nid", "op"), max_hops)

    def scores(self) -> DataFrame:
        """(nid, score) of every element of the provenance."""
        return self.origins.unionByName(self.hits.select("nid", "score")).groupBy("nid").agg(F.max("score").alias("score"))

    def ranked_by_certainty(self, max_hops: int = 4) -> DataFrame:
        """(nid, certainty), best first: of hits, their largest sum of scores along a path; without one, their own."""
        found = drs.certainty(self.paths(max_hops), self.scores())
        return self.hits.select("nid", "score").join(found, "nid", "left").select("nid", F.coalesce("certainty", "score").alias("certainty")).orderBy(F.desc("certainty"), "nid")

    def ranked_by_coverage(self, max_hops: int = 4) -> DataFrame:
        """(nid, coverage), best first: the share of all origins that lead to a hit, 0 where none does."""
        found = drs.coverage(self.paths(max_hops))
        return self.hits.select("nid").join(found, "nid", "left").select("nid", F.coalesce("coverage", F.lit(0.0)).alias("coverage")).orderBy(F.desc("coverage"), "nid")

    def table_scores(self, max_hops: int = 4) -> DataFrame:
        """(source_name, certainty, coverage): sums of certainty, and the share of origins that lead to any hit of it."""
        every = self.paths(max_hops)
        tables = self.hits.select("nid", "source_name")
        certainty = tables.join(self.ranked_by_certainty(max_hops), "nid").groupBy("source_name").agg(F.sum("certainty").alias("certainty"))
        origins = every.where(F.size("path") == 1).agg(F.count_distinct("origin").alias("n"))
        covered = tables.join(drs.why(every), "nid").groupBy("source_name").agg(F.count_distinct("origin").alias("c")).join(F.broadcast(origins), F.lit(True))
        return certainty.join(covered, "source_name", "left").select("source_name", "certainty", F.coalesce(F.col("c") / F.col("n"), F.lit(0.0)).alias("coverage"))

    def documents(self) -> DataFrame:
        """(source_name, document): for each table one JSON text with its hits, ordered by nid."""
        fields = F.array_sort(F.collect_list(F.struct(*HIT)))
        grouped = self.hits.groupBy("source_name").agg(fields.alias("field_res"))
        return grouped.select("source_name", F.to_json(F.struct(F.element_at("field_res", 1).alias("source_res"), "field_res")).alias("document"))


def same_mode(a: ResultSet, b: ResultSet) -> None:
    if a.by_table != b.by_table:
        raise ValueError("both result sets must be of columns, or both of tables")


def from_operation(hits: DataFrame, op: str = "ORIGIN", source: str | None = None, score: float = 0.0) -> ResultSet:
    """Hits and the edges that the operation gives them.

    NONE leaves no trace and ORIGIN makes each hit an origin. A lookup leads from an origin of its own, named by the
    text and scored -1, to each hit; any other operation leads there from the column ``source``.
    """
    spark, kept = hits.sparkSession, hits.select(*HIT)
    none = spark.createDataFrame([], EDGE)
    if op == "NONE" or (op not in LOOKUPS and op != "ORIGIN" and source is None):
        return ResultSet(kept, spark.createDataFrame([], "nid string, score double"), none)
    if op == "ORIGIN":
        return ResultSet(kept, kept.select("nid", F.col("score").cast("double").alias("score")), none)
    name, worth = (f"synthetic_origin:{source}", -1.0) if op in LOOKUPS else (source, score)
    edges = kept.select(F.lit(name).alias("src_nid"), F.col("nid").alias("dst_nid"), F.lit(op).alias("op"), F.lit(None).cast("string").alias("mark")).distinct()
    return ResultSet(kept, spark.createDataFrame([(name, worth)], "nid string, score double"), edges)


def columns_of_table(nodes: DataFrame, table: str) -> DataFrame:
    """The hits of all columns of a table, with score 0."""
    return nodes.where(F.col("source_name") == table).select("nid", "source_name", F.lit(0.0).alias("score"))


def expand_to_tables(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """All columns of the tables that the hits lie in; a hit keeps its score."""
    every = nodes.select("nid", "source_name").join(hits.select("source_name").distinct(), "source_name", "left_semi")
    return every.join(hits.groupBy("nid").agg(F.max("score").alias("score")), "nid", "left").select("nid", "source_name", F.coalesce("score", F.lit(0.0)).alias("score"))


def tables_in_order(hits: DataFrame) -> DataFrame:
    """(source_name, position): tables by where they are seen first in hits with a ``position``."""
    return hits.groupBy("source_name").agg(F.min("position").alias("position")).orderBy("position", "source_name")


def result_set(nodes: DataFrame, wanted) -> ResultSet:
    """A result set of whatever names columns: a result set, None, a nid, (db, table, column), a table, or a list."""
    spark = nodes.sparkSession
    none = spark.createDataFrame([], "nid string, source_name string, score double")
    if isinstance(wanted, ResultSet):
        return wanted
    if wanted is None:
        return from_operation(none, "NONE")
    if isinstance(wanted, list):
        out = from_operation(none, "NONE")
        for part in wanted:
            out = out.absorb(result_set(nodes, part))
        return out
    hit = nodes.select("nid", "source_name", F.lit(0.0).alias("score"))
    if isinstance(wanted, tuple):
        _, table, column = wanted
        found = nodes.where((F.col("source_name") == table) & (F.col("field_name") == column)).select("nid", "source_name", F.lit(0.0).alias("score"))
    elif isinstance(wanted, str):
        one = hit.where(F.col("nid") == wanted)
        found = columns_of_table(nodes, wanted) if one.isEmpty() else one
    else:
        raise ValueError(f"{type(wanted).__name__} doesn't name columns")
    return from_operation(found)


# --- search for agents ----------------------------------------------------------------------------------------------


def best_of_tables(hits: DataFrame) -> DataFrame:
    """The best hit of each table; of equal ones the first by ``place`` and nid."""
    order = Window.partitionBy("source_name").orderBy(F.desc("score"), "place", "nid")
    return hits.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def search_results(found: list[DataFrame], nodes: DataFrame, k: int, dedup_tables: bool = False) -> DataFrame:
    """(nid, table, column, score): the k best of several searches' (nid, score). A column that more than one finds
    counts by the first of them; scores have four digits."""
    tagged = None
    for place, hits in enumerate(found):
        rows = hits.select("nid", F.round("score", 4).alias("score"), F.lit(place).alias("place"))
        tagged = rows if tagged is None else tagged.union(rows)
    first = tagged.groupBy("nid").agg(F.min_by(F.struct("score", "place"), F.struct("place", -F.col("score"))).alias("h"))
    hits = first.select("nid", "h.score", "h.place").join(nodes.select("nid", "source_name", "field_name"), "nid")
    if dedup_tables:
        hits = best_of_tables(hits)
    best = hits.orderBy(F.desc("score"), "place", "nid").limit(k)
    return best.select("nid", F.col("source_name").alias("table"), F.col("field_name").alias("column"), "score")
