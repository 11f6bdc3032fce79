import corpus_pipeline

from lakescout.llm import near_dedup, quality, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_equal_their_parts(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    left = {r["doc_id"] for r in docs.collect()}
    for (name, stage), module in zip(corpus_pipeline.STAGES, (quality, toxicity, None, None), strict=True):
        out = stage(spark, docs, SF).cache()
        if module is not None:
            scored = module.score_documents(docs, module.fit_on(docs, labels)).collect()
            rejected = {r["doc_id"] for r in scored if r["predicted"] == (0 if module is quality else 1)}
            left -= rejected
        elif name == "near_dedup":
            left = {r["doc_id"] for r in near_dedup.near_duplicates(docs, near_dedup.FIVE_WORDS).collect() if r["kept"]}
        assert {r["doc_id"] for r in out.select("doc_id").collect()} == left
        if name != "packing":
            assert out.columns == docs.columns
        docs = out
    # Each document is whole in its pieces.
    for r in docs.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect():
        assert r[1] == r[2]


def test_run_is_registered(spark):
    import __spark_entry__ as entry

    queries = entry.queries()
    assert {f"op{n}_" for n in range(1, 11)} == {q.split("_")[0] + "_" for q in queries if q.startswith("op")} and "pipeline" in queries
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_stages_of_edge_cases(spark, documents, tmp_path):
    """Nulls in any column, repeated rows, empty and very long texts, clashing extra columns and empty tables."""
    long = " ".join(f"word{i % 977}" for i in range(20_000))
    rows = [(1, None), (None, "some words of a text"), (None, None), (2, ""), (3, long), (3, long), (4, long + " end"), (5, "a b c"), (5, "a b c"), (5, "d e f")]
    docs = documents(rows).selectExpr("doc_id", "text", "cast(null as string) lang", "source", "n_chars", "score", "1 label", "2 root", "3 mark")
    spark.createDataFrame([(1, None, 0), (None, 1, 1), (3, 1, 0), (3, 0, 1), (7, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, some, str(tmp_path))
            if name != "packing":
                assert out.columns == some.columns
            found = out.collect()
            if name == "near_dedup":
                kept = sorted((str(r["doc_id"]), (r["text"] or "")[:5]) for r in found)
                assert kept == (sorted([("1", ""), ("None", "some "), ("None", ""), ("2", ""), ("3", "word0"), ("5", "a b c"), ("5", "d e f")]) if some is docs else [])
            elif name == "packing":
                assert sum(r["length"] for r in found if r["doc_id"] == 4) == sum({r["doc_tokens"] for r in found if r["doc_id"] == 4})
