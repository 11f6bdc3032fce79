"""Join graphs of a group of tables: paths over key edges between all pairs, combined to full covers and ranked.

Paths and graphs are rows of the catalogue; data of the tables isn't read. A hop is 'column>column' of two tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescout.operators.graph import of_relation
from lakescout.operators.lineage import cut

Hop = tuple[str, str, str, str]


def pair_paths(edges: DataFrame, nodes: DataFrame, group: list[str], relation: str = "PKFK", max_hops: int = 2) -> DataFrame:
    """(source, target, hops, tables) of the simple table paths between all pairs of the group, in one walk for all.

    A path belongs to the pair in the order of the group. Tables outside the group may lie on the way.
    """
    n = nodes.select("nid", "source_name")
    steps = of_relation(edges, relation).join(n.toDF("src_nid", "from_table"), "src_nid").join(n.toDF("dst_nid", "to_table"), "dst_nid").where("from_table <> to_table")
    steps = cut(steps.select("from_table", "to_table", F.concat_ws(">", "src_nid", "dst_nid").alias("hop")).distinct())
    # A group has a few tables, which the caller names.
    wanted = edges.sparkSession.createDataFrame([(t, i) for i, t in enumerate(dict.fromkeys(group))], "name string, place int")
    grown = wanted.select(F.col("name").alias("source"), F.col("place").alias("first"), F.col("name").alias("at"), F.array("name").alias("tables"), F.expr("cast(array() as array<string>)").alias("hops"))
    found = None
    for _ in range(max_hops):
        step = grown.join(steps, F.col("at") == F.col("from_table")).where(~F.array_contains("tables", F.col("to_table")))
        grown = cut(step.select("source", "first", F.col("to_table").alias("at"), F.concat("tables", F.array("to_table")).alias("tables"), F.concat("hops", F.array("hop")).alias("hops")))
        ended = grown.join(F.broadcast(wanted.toDF("target", "last")), F.col("at") == F.col("target")).where("first < last").select("source", "target", "hops", "tables")
        found = ended if found is None else found.union(ended)
    return found


def columns_of(hops):
    """The distinct columns of an array of hops, sorted, as one text: equal for equal graphs."""
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(hops, lambda h: F.split(h, ">"))))), "|")


def join_graphs(paths: DataFrame, group: list[str]) -> DataFrame:
    """(graph_id, hops, n_hops): the graphs that cover the group, fewest hops first.

    A graph is a path that covers the group, or two paths of different pairs that share a table of it and together
    cover more than either. Of graphs with the same columns the one with the fewest hops stays, then the least.
    """
    members = list(dict.fromkeys(group))
    inside = F.array(*map(F.lit, members))
    covered = paths.withColumn("cover", F.array_sort(F.array_intersect("tables", inside)))
    whole = covered.where(F.size("cover") == len(members)).select("hops")
    if len(members) > 2:
        a = covered.select("source", "target", "hops", "cover", F.explode("cover").alias("shared"))
        b = a.select(*(F.col(c).alias(f"{c}2" if c != "shared" else c) for c in a.columns))
        met = a.join(b, "shared").where((F.struct("source", "target") < F.struct("source2", "target2")) & (F.size(F.array_union("cover", "cover2")) == len(members)))
        # Paths that share several tables meet several times.
        more = met.where((F.size("cover") < len(members)) & (F.size("cover2") < len(members)))
        whole = whole.union(more.select(F.concat("hops", "hops2").alias("hops")).distinct())
    named = whole.select(columns_of(F.col("hops")).alias("graph_id"), F.struct(F.size("hops").alias("n_hops"), "hops").alias("g"))
    best = named.groupBy("graph_id").agg(F.min("g").alias("g"))
    return best.select("graph_id", "g.hops", "g.n_hops").orderBy("n_hops", "graph_id")


def ranked(graphs: DataFrame, uniqueness: DataFrame) -> DataFrame:
    """(graph_id, hops, n_hops, score, product): the mean, and the product, of how unique the left column of each hop
    is, best mean first. ``uniqueness`` is (nid, uniqueness); a column that it lacks counts as 0."""
    left = graphs.select("graph_id", F.explode("hops").alias("hop")).select("graph_id", F.split("hop", ">")[0].alias("nid"))
    scored = left.join(uniqueness.select("nid", "uniqueness"), "nid", "left").withColumn("uniqueness", F.coalesce("uniqueness", F.lit(0.0)))
    means = scored.groupBy("graph_id").agg(F.avg("uniqueness").alias("score"), F.product("uniqueness").alias("product"))
    return graphs.join(means, "graph_id").orderBy(F.desc("score"), "n_hops", "graph_id")


def tree(hops: list[Hop]) -> list[Hop] | None:
    """The hops in an order in which each leads from a joined table to a new one; None if they aren't a tree."""
    left = list(dict.fromkeys(h if h[0] <= h[2] else (h[2], h[3], h[0], h[1]) for h in hops))
    if len({t for h in left for t in (h[0], h[2])}) != len(left) + 1:
        return None
    out, seen = [], {hops[0][0]}
    while left:
        at = next((h for h in left if (h[0] in seen) != (h[2] in seen)), None)
        if at is None:
            return None
        left.remove(at)
        a, ca, b, cb = at
        out.append(at if a in seen else (b, cb, a, ca))
        seen |= {a, b}
    return out


def discovered(edges: DataFrame, nodes: DataFrame, uniqueness: DataFrame | None = None, relation: str = "PKFK", max_hops: int = 2):
    """The function from a group of tables to its join graphs, each a tree of hops, that view search asks for."""
    names = {r["nid"]: (r["source_name"], r["field_name"]) for r in nodes.select("nid", "source_name", "field_name").toLocalIterator()}

    def hops_of(group: list[str]) -> list[list[Hop]]:
        graphs = join_graphs(pair_paths(edges, nodes, group, relation, max_hops), group)
        if uniqueness is not None:
            graphs = ranked(graphs, uniqueness)
        found = []
        for row in graphs.select("hops").toLocalIterator():
            ends = [h.split(">") for h in row["hops"]]
            order = tree([(*names[a], *names[b]) for a, b in ends])
            if order is not None:
                found.append(order)
        return found

    return hops_of
