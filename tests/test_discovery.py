"""Join graphs, result sets with provenance, and groups of views, against small cases worked out by hand."""

import duckdb
import numpy as np
import pytest

from lakescout.operators import dod, edges, joins, vectors, views
from lakescout.operators import joingraphs as JG
from lakescout.operators import results as RS
from lakescout.operators import search as S
from lakescout.plans import discovery
from lakescout.sources import readers

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(discovery.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    found = discovery.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    result = duck.execute(discovery.ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    expected = sorted(repr(tuple(row[names.index(c)] for c in columns)) for row in result.fetchall())
    assert sorted(repr(tuple(row[c] for c in columns)) for row in found.collect()) == expected


@pytest.fixture(scope="module")
def lake(spark):
    """Orders of customers in nations; a key edge of orders and nations that no row fits."""
    tables = {
        "o": spark.createDataFrame([(1, 10), (2, 11), (3, 10)], "order_id long, cust long"),
        "c": spark.createDataFrame([(10, "ann", 100), (11, "bob", 101)], "id long, name string, nat long"),
        "n": spark.createDataFrame([(100, "peru"), (101, "chad")], "nid long, nation string"),
    }
    nodes = spark.createDataFrame([(f"{t}.{c}", "lake", t, c, 1.0 if c in ("order_id", "id", "nid") else 0.5) for t, df in tables.items() for c in df.columns], "nid string, db_name string, source_name string, field_name string, cardinality double")
    edges = spark.createDataFrame([("o.cust", "c.id", "PKFK", 1.0), ("c.nat", "n.nid", "PKFK", 1.0), ("o.order_id", "n.nid", "PKFK", 1.0), ("o.cust", "n.nation", "CONTENT_SIM", 1.0)], "src_nid string, dst_nid string, relation string, score double")
    return tables, nodes, edges


def test_paths_and_graphs_of_a_group(lake):
    _, nodes, edges = lake
    paths = {(r["source"], r["target"], tuple(r["hops"])) for r in JG.pair_paths(edges, nodes, ["o", "c", "n"]).collect()}
    assert ("o", "c", ("o.cust>c.id",)) in paths
    assert ("o", "n", ("o.cust>c.id", "c.nat>n.nid")) in paths
    assert ("o", "n", ("o.order_id>n.nid",)) in paths
    assert all(s != "n" for s, _, _ in paths)
    graphs = JG.join_graphs(JG.pair_paths(edges, nodes, ["o", "c", "n"]), ["o", "c", "n"]).collect()
    ids = [r["graph_id"] for r in graphs]
    assert len(ids) == len(set(ids))
    assert "c.id|c.nat|n.nid|o.cust" in ids
    assert [r["n_hops"] for r in graphs] == sorted(r["n_hops"] for r in graphs)


def test_a_graph_that_is_not_joinable_gives_nothing(spark, lake):
    _, nodes, edges = lake
    none = edges.where("relation = 'none'")
    assert JG.join_graphs(JG.pair_paths(none, nodes, ["o", "c"]), ["o", "c"]).collect() == []
    assert JG.discovered(none, nodes)(["o", "c"]) == []


def test_graphs_are_ranked_by_left_columns(lake):
    _, nodes, edges = lake
    graphs = JG.join_graphs(JG.pair_paths(edges, nodes, ["o", "n"]), ["o", "n"])
    rows = JG.ranked(graphs, nodes.selectExpr("nid", "cardinality as uniqueness")).collect()
    assert rows[0]["graph_id"] == "n.nid|o.order_id" and rows[0]["score"] == 1.0
    assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)


def test_hops_are_put_in_the_order_of_a_tree():
    assert JG.tree([("a", "x", "b", "y"), ("c", "z", "d", "w"), ("b", "v", "c", "u")]) == [("a", "x", "b", "y"), ("b", "v", "c", "u"), ("c", "z", "d", "w")]
    assert JG.tree([("a", "x", "b", "y"), ("b", "y", "a", "x")]) == [("a", "x", "b", "y")]
    assert JG.tree([("a", "x", "b", "y"), ("a", "p", "b", "q")]) is None
    assert JG.tree([("a", "x", "b", "y"), ("c", "x", "d", "y"), ("a", "z", "b", "w")]) is None


def test_view_search_with_discovered_graphs(lake):
    tables, nodes, edges = lake
    values = nodes.selectExpr("nid", "'' as value")
    filters = [dod.Filter(0, "order_id"), dod.Filter(1, "nation")]
    # The edge of order ids and nations comes first, as the shortest, but no row fits it.
    group, view = next(dod.search(tables, nodes, values, JG.discovered(edges, nodes), filters))
    assert set(group) == {"o", "n"}
    assert sorted(map(tuple, view.collect())) == [(1, "peru"), (2, "chad"), (3, "peru")]


def test_every_group_of_tables():
    groups = list(dod.every_group([("a", frozenset({0})), ("b", frozenset({0, 1})), ("c", frozenset())]))
    assert [g for g, _ in groups] == [["b"], ["a", "b"], ["b", "c"], ["a", "b", "c"], ["a"], ["a", "c"], ["c"]]


def hits(spark, *rows):
    return spark.createDataFrame(list(rows), "nid string, source_name string, score double")


def test_provenance_of_operations(spark):
    found = hits(spark, ("t.a", "t", 0.5), ("t.b", "t", 1.0))
    assert RS.from_operation(found, "NONE").edges.count() == 0 == RS.from_operation(found, "NONE").origins.count()
    origin = RS.from_operation(found)
    assert origin.edges.count() == 0 and origin.origins.count() == 2
    lookup = RS.from_operation(found, "KW_LOOKUP", "word")
    assert {(r["src_nid"], r["dst_nid"], r["op"]) for r in lookup.edges.collect()} == {("synthetic_origin:word", "t.a", "KW_LOOKUP"), ("synthetic_origin:word", "t.b", "KW_LOOKUP")}
    assert [r["score"] for r in lookup.origins.collect()] == [-1.0]
    assert RS.from_operation(found, "PKFK").edges.count() == 0
    assert {r["src_nid"] for r in RS.from_operation(found, "PKFK", "s.x").edges.collect()} == {"s.x"}


def test_certainty_counts_negative_branches_as_nothing(spark):
    first = RS.from_operation(hits(spark, ("t.a", "t", 0.5)), "KW_LOOKUP", "word")
    then = RS.from_operation(hits(spark, ("u.b", "u", 0.25)), "PKFK", "t.a", 0.5).absorb_provenance(first)
    assert [(r["nid"], r["certainty"]) for r in then.ranked_by_certainty().collect()] == [("u.b", 0.75)]


def test_set_algebra_marks_edges_and_keeps_modes_apart(spark):
    a = RS.from_operation(hits(spark, ("t.a", "t", 1.0), ("t.b", "t", 1.0)), "KW_LOOKUP", "x")
    b = RS.from_operation(hits(spark, ("t.b", "t", 1.0), ("u.c", "u", 1.0)), "KW_LOOKUP", "y")
    both = a.intersection(b)
    assert [r["nid"] for r in both.hits.collect()] == ["t.b"]
    assert {(r["src_nid"], r["mark"]) for r in both.edges.where("dst_nid = 't.b'").collect()} == {("synthetic_origin:x", "AND"), ("synthetic_origin:y", "AND")}
    assert {r["mark"] for r in both.edges.where("dst_nid <> 't.b'").collect()} == {None}
    assert {r["mark"] for r in a.union(b).edges.where("dst_nid = 't.b'").collect()} == {"OR"}
    assert [r["nid"] for r in a.difference(b).hits.collect()] == ["t.a"]
    with pytest.raises(ValueError):
        a.union(RS.ResultSet(b.hits, b.origins, b.edges, by_table=True))


def test_result_sets_from_names(spark, lake):
    _, nodes, _ = lake
    names = lambda wanted: sorted(r["nid"] for r in RS.result_set(nodes, wanted).hits.collect())
    assert names("c") == ["c.id", "c.name", "c.nat"]
    assert names("c.id") == ["c.id"] == names(("any", "c", "id"))
    assert names(None) == [] == names("no such")
    assert names([("any", "c", "id"), "n"]) == ["c.id", "n.nation", "n.nid"]
    with pytest.raises(ValueError):
        RS.result_set(nodes, 1.5)


def test_documents_and_order_of_tables(spark):
    found = RS.from_operation(hits(spark, ("t.b", "t", 1.0), ("t.a", "t", 0.5)))
    assert [r["document"] for r in found.documents().collect()] == ['{"source_res":{"nid":"t.a","source_name":"t","score":0.5},"field_res":[{"nid":"t.a","source_name":"t","score":0.5},{"nid":"t.b","source_name":"t","score":1.0}]}']
    seen = spark.createDataFrame([("u", 1), ("t", 0), ("t", 2)], "source_name string, position int")
    assert [r["source_name"] for r in RS.tables_in_order(seen).collect()] == ["t", "u"]


def test_searches_are_merged_in_their_order(spark, lake):
    _, nodes, _ = lake
    frames = [spark.createDataFrame(rows, "nid string, score double") for rows in ([("c.id", 0.2)], [("c.id", 0.9), ("n.nid", 0.5)])]
    assert [(r["nid"], r["score"]) for r in RS.search_results(frames, nodes, 5).collect()] == [("n.nid", 0.5), ("c.id", 0.2)]
    assert [S.automatic_edits(w) for w in ("ab", "abcde", "abcdef")] == [0, 1, 2]


def test_groups_of_views(spark):
    view = lambda *rows: spark.createDataFrame(list(rows), "k int, v string")
    frames = {"a": view((1, "x"), (2, "y")), "b": view((1, "x")), "c": view((1, "z"), (3, "w")), "d": view((4, "q"))}
    assert views.schema_groups({**frames, "e": frames["a"].select("k")}) == {("k", "v"): ["a", "b", "c", "d"], ("k",): ["e"]}
    found = {(r["a"], r["b"]): r["relation"] for r in views.group_relations(frames, "k").collect()}
    assert found == {("a", "b"): "contained", ("a", "c"): "contradictory", ("a", "d"): "complementary", ("b", "c"): "contradictory", ("b", "d"): "complementary", ("c", "d"): "complementary"}
    assert views.key_of_pair(frames["a"], frames["d"]) in ("k", "v")


def test_estimates_and_projections(spark, lake):
    tables, _, _ = lake
    row = joins.join_estimate(tables["o"], tables["c"], 100).first()
    assert (row["row_bytes"], row["cartesian_rows"], row["cartesian_bytes"], row["fits"]) == (40, 6, 240, False)
    assert joins.attributes_to_project([("b", ""), ("a", "1"), ("b", ""), ("z", "")], ["a", "b"]) == ["b", "a"]


def test_principal_planes_equal_those_of_the_covariance(spark):
    rows = np.random.default_rng(2).normal(size=(300, 4)) * (5, 3, 2, 1)
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    planes = np.array(vectors.principal_planes(data, 2))
    wanted = np.linalg.eigh(np.cov(rows.T))[1][:, ::-1][:, :2].T
    assert np.allclose(np.abs((planes * wanted).sum(1)), 1)
    assert all(max(p, key=abs) > 0 for p in planes.tolist())
    expected = ["".join("1" if v @ p > 0 else "0" for p in planes) for v in rows]
    assert [r["bucket"] for r in vectors.buckets(data, planes.tolist()).orderBy("vec_id").collect()] == expected


def test_columns_that_share_a_band(spark):
    signatures = spark.createDataFrame([("a", [1, 2, 3, 4]), ("b", [1, 2, 9, 9]), ("c", [7, 2, 8, 8])], "nid string, minhash array<long>")
    assert [tuple(r) for r in edges.text_content_unverified(signatures, 2, 2).collect()] == [("a", "b", "CONTENT_SIM", 1.0)]
    assert edges.text_content(signatures, 2, 2).collect() == []


def test_sources_are_found_in_folders(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.csv").write_text("x,y\n1,a\n2,b\n")
    (tmp_path / "deep" / "b.csv").write_text("z\n1\n2\n")
    (tmp_path / "one.csv").write_text("z\n1\n")
    (tmp_path / "note.txt").write_text("no table")
    with pytest.warns(UserWarning, match="fewer than two rows"):
        found = list(readers.discover(spark, [readers.SourceConfig("lake", "csv", {"path": str(tmp_path)})]))
    assert [(db, t, df.columns) for db, t, df in found] == [("lake", "a.csv", ["x", "y"]), ("lake", "b.csv", ["z"])]
    with pytest.raises(ValueError):
        readers.discover(spark, [readers.SourceConfig("x", "no such type")])
    with pytest.warns(UserWarning, match="left out"):
        assert list(readers.discover(spark, [readers.SourceConfig("x", "parquet", {"path": str(tmp_path / "none")})])) == []


def test_lists_are_combined_to_a_total(spark):
    first = spark.createDataFrame([("a",), ("b",)], "uri string")
    more = spark.createDataFrame([(f"m{i}",) for i in range(50)], "uri string")
    out = [r["uri"] for r in readers.combined(first, more, 10).collect()]
    assert len(set(out)) == 10 and {"a", "b"} <= set(out)
    assert out == [r["uri"] for r in readers.combined(first, more.repartition(7), 10).collect()]
    assert sorted(r["uri"] for r in readers.combined(first, more, 1).collect()) == ["a", "b"]
