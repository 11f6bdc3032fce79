from pyspark.sql import functions as F

from lakescout.functions import text as TX
from lakescout.operators import annotations, dod, drs, edges, graph, profile, search, views
from lakescout.sources import readers, writers


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_numeric_statistics_skip_what_is_not_finite(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    row = profile.profile_table(df, "t", exact=True).first()
    assert (row["min_value"], row["max_value"], row["avg_value"], row["median"], row["iqr"]) == (1, 4, 2.5, 2.5, 1.5)
    assert row["total_values"] == 6


def test_profile_of_an_empty_table(spark):
    rows = profile.profile_table(spark.createDataFrame([], "a int, b string, c array<int>"), "t").collect()
    assert [(r["nid"], r["data_type"], r["total_values"], r["median"]) for r in rows] == [("t.a", "N", 0, 0.0), ("t.b", "T", 0, 0.0)]


def test_approximate_profile_is_near(spark):
    row = profile.profile_table(spark.range(1000).toDF("x"), "t").first()
    assert abs(row["unique_values"] - 1000) < 50 and abs(row["median"] - 499.5) < 2


def test_intervals(spark):
    p = spark.createDataFrame([("a", "N", 0.0, 10.0, 5.0, 5.0), ("b", "N", 2.0, 9.0, 5.5, 3.5), ("c", "N", -5.0, 20.0, 7.5, 12.5), ("d", "N", 10.0, 12.0, 11.0, 1.0)], "nid string, data_type string, min_value double, max_value double, median double, iqr double")
    pairs = {(r["nid"], r["c_nid"]): round(r["overlap"], 6) for r in edges.interval_pairs(p, 0.3).collect()}
    assert pairs[("a", "b")] == 0.7 and pairs[("a", "c")] == 1.0 and ("a", "d") not in pairs
    # The cells lose no pair that all pairs have.
    v = [(r["nid"], r["left"], r["right"]) for r in edges.intervals(p).collect()]
    brute = {(a, c) for a, l, r in v for c, l2, r2 in v if a != c and (min(r, r2) - max(l, l2)) / (r - l) >= 0.3}
    assert set(pairs) == brute


def test_islands(spark):
    p = spark.createDataFrame([(n, "N", 0.0, 0.0, m, 0.0) for n, m in (("a", 1.0), ("b", 1.05), ("c", 1.12), ("d", 2.0))], "nid string, data_type string, min_value double, max_value double, median double, iqr double")
    found = {(r["src_nid"], r["dst_nid"]): r["score"] for r in edges.zero_iqr(p).collect()}
    assert set(found) == {("a", "b"), ("a", "c"), ("b", "c")} and found[("a", "b")] == 0.925


def test_set_algebra(spark):
    a = spark.createDataFrame([(n, f"t{n[0]}", 1.0) for n in ("10", "0", "1", "2", "3")], "nid string, source_name string, score double")
    b = spark.createDataFrame([(n, f"t{n[0]}", 1.0) for n in ("1", "16", "17")], "nid string, source_name string, score double")
    assert drs.intersection(a, b).count() == 1 and drs.union(a, b).count() == 7 and drs.difference(a, b).count() == 4
    assert drs.intersection_by_table(a, b).count() == 4


def test_traversal_grows_with_hops(spark):
    nodes, e = graph.synthetic_network(spark, 5, 4, {"PKFK": (3, 0.8)})
    start = spark.createDataFrame([("syn0.f0",)], "nid string")
    sizes = [graph.traverse(e, start, "PKFK", h).count() for h in range(4)]
    assert sizes == [1, 2, 3, 4] and graph.closure(e, start).count() == 7
    path = graph.shortest_paths(e, start, spark.createDataFrame([("syn2.f1",)], "nid string"), "PKFK", 5).first()
    assert path["hops"] == 3 and path["path"] == ["syn0.f0", "syn0.f3", "syn1.f2", "syn2.f1"]
    assert nodes.count() == 20


def test_search_has_no_result_for_unknown_words(spark):
    docs = spark.createDataFrame([("a", "big red car"), ("b", "red red"), ("c", None)], "nid string, text string")
    assert [r["nid"] for r in search.bm25(docs, "red", 5).collect()] == ["b", "a"]
    assert search.bm25(docs, "none", 5).count() == 0


def test_names(spark):
    df = spark.createDataFrame([("MyFieldName",), ("myField-Name",)], "n string")
    assert [r[0] for r in df.select(TX.snake(F.col("n"))).collect()][0] == "my_field_name"
    assert [r[0] for r in df.select(TX.name_tokens(F.col("n"))).collect()][1] == ["my", "field", "name"]
    score = spark.range(1).select(TX.keyword_score(F.lit("a b"), F.lit("a c d"))).first()[0]
    assert round(score, 4) == 0.4667
    uris = spark.createDataFrame([(u,) for u in ("x/files/tsqz-67gi.txt", "x/files/34104.txt", "x/files/readme.txt", "y/my-slug/files/my-slug.txt", "x/files/sales.csv")], "u string")
    assert [r[0] for r in uris.select(TX.is_metadata_uri(F.col("u"))).collect()] == [True, True, True, True, False]


def test_candidate_groups_come_full_first():
    tables = [("t1", frozenset({0, 1})), ("t2", frozenset({2})), ("t3", frozenset({1}))]
    groups = [g for g, _ in dod.candidate_groups(tables, frozenset({0, 1, 2}))]
    assert groups[0] == ["t1", "t2"] and len({frozenset(g) for g in groups}) == len(groups)
    path = [("a", "x"), ("b", "y"), ("b", "z"), ("c", "w")]
    assert dod.hop_pairs(path) == [(("a", "x"), ("b", "y")), (("b", "z"), ("c", "w"))]


def test_views_of_other_columns_are_of_another_schema(spark):
    a, b = spark.range(3).toDF("x"), spark.range(3).toDF("y")
    assert views.equivalent(a, b).first()["view_class"] == "DIF_SCHEMA"
    assert views.equivalent(a, a.orderBy(F.desc("x"))).first()["equivalent"]


def test_annotations_of_reversed_relations(spark):
    s, t = (spark.createDataFrame([(n,)], "nid string") for n in ("a", "b"))
    rows = annotations.annotate(s, t, "me", "INSIGHT", "note", "SUPERCLASS")
    assert rows.first()["source"] == "b" and rows.first()["relation"] == "SUBCLASS"
    tagged = annotations.add_tags(rows, rows.select("id", F.lit("good").alias("tag")))
    assert annotations.keyword_search(tagged, "GOOD").count() == 1


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,a\n2,b\n")
    (tmp_path / "s.json").write_text('{"meta": {"view": {"columns": [{"name": "id", "flags": ["hidden"]}, {"name": "n"}]}}, "data": [["1", "p"], ["2", "q"]]}')
    (tmp_path / "g.json").write_text('{"features": [{"properties": {"k": 1}}, {"properties": {"k": 2}}]}')
    table = readers.read(spark, readers.SourceConfig("a", "csv", {"path": str(tmp_path / "a.csv")}))
    assert values(table) == [(1, "a"), (2, "b")] and readers.admitted(table.limit(1)) is None
    assert values(readers.socrata(spark, str(tmp_path / "s.json"))) == [("p",), ("q",)]
    assert values(readers.geojson(spark, str(tmp_path / "g.json"))) == [(1,), (2,)]
    kinds = {r["path"].rsplit("/", 1)[-1]: r["kind"] for r in readers.kinds_of_files(spark, str(tmp_path)).collect()}
    assert kinds == {"a.csv": "csv", "s.json": "json", "g.json": "json"}
    nodes, e = graph.synthetic_network(spark, 2, 2, {"PKFK": (1, 0.8)})
    writers.write_network(nodes, e, str(tmp_path / "net"))
    assert spark.read.parquet(str(tmp_path / "net/edges")).count() == 3
    assert writers.triples(e, "http://x/").first()["value"].endswith(".")


def test_stream_of_profiles(spark, tmp_path):
    from lakescout.streaming import profiles

    spark.createDataFrame([("a", "1"), ("a", "3"), ("b", "x")], "nid string, value string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("nid string, value string").parquet(str(tmp_path / "in"))
    profiles.follow(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    rows = {r["nid"]: r for r in profiles.finished(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert rows["a"]["total_values"] == 2 and rows["a"]["max_value"] == 3 and rows["b"]["unique_values"] == 1


def test_entry_points():
    import __spark_entry__ as entry

    assert {"nbr_pkfk", "join_tree_fold"} <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_peeking_and_names_of_metadata(spark):
    from lakescout.functions import text as TX

    peeks = {"a,b\n1,2\n3,4": True, '{"a": 1}\n{"a": 2}\n{"a": 3}': True, '{\n"a": 1,\n"b": 2,\n"c": 3,\n}': False, "[1,\n2,\n3,\n4]": False, "a\tb\t\n1\t2\n3\t4": True, "a;b\n1,2": False, '"x,y",b\n1,2\n3,4': True, "": False}
    rows = spark.createDataFrame([(t,) for t in peeks], "t string").select("t", TX.looks_like_table(F.col("t")).alias("y")).collect()
    assert {r["t"]: r["y"] for r in rows} == peeks
    uris = {"s3://b/x/files/34104-2.csv": True, "s3://b/x/files/v2.json": True, "s3://b/x/files/X.csv": True, "s3://b/x/files/doi-12": True, "s3://b/x/files/doi-1_2": False, "s3://b/x/files/changelog.md": False, "s3://b/x/files/index-yPXves.txt": True, "s3://b/x/www_a.b": True, "files/readme2": True, "x/sales.csv": False}
    rows = spark.createDataFrame([(t,) for t in uris], "t string").select("t", TX.is_metadata_uri(F.col("t")).alias("y")).collect()
    assert {r["t"]: r["y"] for r in rows} == uris


def test_exact_profile_equals_plain_python(spark):
    import random
    import statistics

    rng = random.Random(2)
    rows = [(rng.choice([None, 2**53, 2**53 + 1, 5, -3]), rng.choice([None, 0.5, 1.25, float("nan"), float("inf"), -0.0, 0.0]), rng.choice([None, "", "a", "b"]), None) for _ in range(300)]
    df = spark.createDataFrame(rows, "k long, x double, t string, e int")
    found = {r["column_name"]: r for r in profile.profile_table(df, "s", exact=True).collect()}
    for i, c in enumerate("kxte"):
        values = [r[i] for r in rows if r[i] is not None]
        assert found[c]["total_values"] == len(values) and found[c]["unique_values"] == len({"nan" if v != v else v for v in values}) and found[c]["nid"] == f"s.{c}"
    finite = [r[1] for r in rows if r[1] is not None and abs(r[1]) < 9]
    assert found["x"]["max_value"] == 1.25 and abs(found["x"]["avg_value"] - statistics.mean(finite)) < 1e-9 and found["x"]["median"] == statistics.median(finite)
    assert found["e"]["max_value"] == 0.0 and found["t"]["iqr"] == 0.0
