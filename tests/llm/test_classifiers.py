import tracemalloc
import zlib

import numpy as np

from lakescout.llm import common, quality, toxicity

SF = "/root/testdata/sf0.01"


def accuracy(spark, module, label):
    documents, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = module.fit_on(documents, labels)
    rows = module.score_documents(documents, model).join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    return float(np.mean([r["predicted"] == r[label] for r in rows])), model


def test_held_out_quality(spark):
    share, _ = accuracy(spark, quality, "quality")
    assert share > 0.95


def test_held_out_toxicity(spark):
    share, model = accuracy(spark, toxicity, "toxic")
    assert share > 0.9
    clean, foul = model.score(["the and of to is for that with are was", "the idiot and worthless scum of a pathetic moron is trash loser"])
    assert clean < 0.5 < foul


def edges(spark, documents, module, labels):
    rows = [(1, None), (2, ""), (3, "word " * 20_000), (None, "no id"), (3, "word " * 20_000), (4, "\x00é😀")]
    df = documents(rows)
    model = module.fit_on(df, labels)
    found = module.score_documents(df, model).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    assert {r["held_out"] for r in found if r["doc_id"] is None} == {None}
    assert {r["doc_id"]: r["held_out"] for r in found if r["doc_id"]} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in (1, 2, 3, 4)}
    assert module.score_documents(documents([]), model).count() == 0
    kept = module.keep_documents(df, model)
    assert kept.columns == df.columns and kept.count() <= len(rows)


def test_edges_without_labels(spark, documents):
    for module in (quality, toxicity):
        edges(spark, documents, module, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))


def test_edges_with_null_and_repeated_labels(spark, documents):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (3, None, None), (2, 0, 0), (4, 1, 0)], "doc_id bigint, quality int, toxic int")
    for module in (quality, toxicity):
        edges(spark, documents, module, labels)


def test_discriminant_equals_plain_densities():
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.normal(0, 1, (300, 4)), rng.normal(1, 2, (200, 4))))
    model = quality.fit(x, np.array([0] * 300 + [1] * 200))
    covariance = [np.linalg.inv(i) @ np.linalg.inv(i).T for i in model.inverse]
    plain = [-0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m) - 0.5 * np.linalg.slogdet(c)[1] for m, c in zip(model.means, covariance, strict=True)]
    assert np.allclose(model.difference(x), plain[1] - plain[0])


def test_a_small_toxic_class_beside_a_large_one():
    rng = np.random.default_rng(3)
    parts = {"en": "the and of to is for that with ing er ha en re st ou nt".split(), "fr": "le de é eau ment tion ç è que vi pa ch an ou en la sur par".split()}

    def text(language, extra=()):
        words = ["".join(rng.choice(parts[language], rng.integers(1, 4))) for _ in range(60)]
        for e in extra:
            words.insert(int(rng.integers(len(words))), e)
        return " ".join(words)

    foul = lambda: ["réeux" + str(rng.choice(parts["fr"])) for _ in range(4)]
    toxic = [text("en", ("trash", "worthless", "pathetic", "idiot")) for _ in range(250)] + [text("fr", foul()) for _ in range(30)]
    # Some ordinary French documents hold such a word too.
    ordinary = [text("en") for _ in range(900)] + [text("fr", foul()[:1] if i % 10 == 0 else ()) for i in range(300)]
    model = toxicity.fit(toxic, ordinary)
    assert "réeu".encode() in model.toxic[: -len(model.ordinary)]
    assert np.mean(model.score([text("fr", foul()) for _ in range(40)]) > 0.5) > 0.5
    assert np.mean(model.score([text("fr") for _ in range(40)] + [text("en") for _ in range(40)]) < 0.5) > 0.95


def test_holders_of_rare_words_take_no_bit_for_each_document():
    documents = [frozenset([f"w{i}x{j}" for j in range(10)] + ["all", *(["many"] if i % 100 == 0 else [])]) for i in range(4000)]
    tracemalloc.start()
    held = toxicity.holders_of_words(documents)
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert size < 6e6  # bits alone take about 14 MB
    assert toxicity.bits_of(held["w3999x0"]) == 1 << 3999
    assert toxicity.bits_of(held["all"]) == (1 << 4000) - 1
    assert toxicity.bits_of(held["many"]) == sum(1 << i for i in range(0, 4000, 100))
    assert toxicity.holders({k: held[k] for k in ("many", "all")}, {" all", "any "}, (4,)) == {" all": (1 << 4000) - 1, "any ": toxicity.bits_of(held["many"])}


def test_a_worker_gives_memory_back_after_a_task():
    resident = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096

    def run(batches):
        rows = [np.ones(8000) for _ in range(4000)]
        common.held(__name__, "last", lambda: rows[-1])  # keeps the C library from giving back what lies before it
        yield from batches

    before = resident()
    try:
        assert list(common.alone(run)(iter([1, 2]))) == [1, 2]
        assert resident() - before < 60e6  # the rows take 256 MB
    finally:
        common.HELD.clear()
