import math
from collections import Counter

import numpy as np

from lakescout.llm import ann_graph, hmm_lm, topk_search

DDL = "vec_id bigint, embedding array<float>, label int, score string"


def vectors(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 8)).astype(np.float32)
    x[50:60] = x[50]
    rows = [(i, v.tolist(), 0, "s") for i, v in enumerate(x)]
    rows += [(1000, None, 0, ""), (1050, [float("nan")] * 8, 0, ""), (1100, [0.0] * 8, 0, ""), (None, [1.0] * 8, 0, "")]
    return spark.createDataFrame(rows, DDL), x


def test_top_k_is_exact(spark):
    df, x = vectors(spark)
    whole, zero = np.floor(64 * x.astype(float)), np.zeros((1, 8))
    data, ids = np.concatenate((whole, zero)), [*range(len(x)), 1100]
    for block, part in ((8192, 1024), (64, 8)):
        found = {}
        for r in topk_search.top_k(df, 5, 20, block=block, query_block=part).collect():
            found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert set(found) == {i for i in ids if i % 20 == 0}
        for q, rows in found.items():
            scores = data @ data[ids.index(q)]
            best = sorted((-s, i) for s, i in zip(scores, ids, strict=True) if i != q)[:5]
            assert [(i, s) for _, i, s in sorted(rows)] == [(i, -s) for s, i in best]
    assert topk_search.top_k(df.limit(0)).count() == 0


def test_clusters_are_pruned_and_trees_cover(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((40, 16)) * 10
    x = np.floor(64 * (centres[rng.integers(0, 40, 6000)] + 0.05 * rng.standard_normal((6000, 16))))
    tree = topk_search.CoverTree(x, 32)
    below = {}

    def points(node):
        below[node] = tree.members[node] if not tree.children[node] else np.concatenate([points(c) for c in tree.children[node]])
        return below[node]

    assert sorted(points(tree.root).tolist()) == list(range(6000))
    for node, members in below.items():
        assert topk_search.distances(x[members], x[tree.centre[node]]).max() <= tree.radius[node] + 1e-9
        children = [tree.centre[c] for c in tree.children[node]]
        covers = max((tree.radius[c] for c in tree.children[node]), default=0)
        assert all(np.linalg.norm(x[a] - x[b]) >= covers - 1e-9 for a in children for b in children if a != b)
    own, scored = np.arange(0, 6000, 20), []
    score, name = topk_search.search(x[own], x, own, np.arange(6000), 5, None, scored)
    products = x[own] @ x.T
    products[np.arange(300), own] = -np.inf
    assert (score == -np.sort(-products, 1)[:, :5]).all() and sum(scored) < 0.2 * 300 * 6000
    # The whole query over several blocks, of which most pairs are never sent.
    df = spark.createDataFrame([(i, (v / 64).tolist(), 0, "s") for i, v in enumerate(x)], DDL.replace("float", "double"))
    found = {(r["query_id"], r["rank"]): r["score"] for r in topk_search.top_k(df, 5, 20, block=256, query_block=64).collect()}
    assert found == {(int(q), j + 1): int(score[i, j]) for i, q in enumerate(own) for j in range(5)}


def test_components_beyond_doubles(spark):
    rows = [(0, [1.7e308, 1.0], 0, "s"), (20, [1.0, 2.0], 0, "s"), (3, [-1.7e308, 0.0], 0, "s")]
    found = topk_search.top_k(spark.createDataFrame(rows, DDL.replace("float", "double"))).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == [(0, 1, 20, 2**63 - 1), (0, 2, 3, -(2**63)), (20, 1, 0, 2**63 - 1), (20, 2, 3, -(2**63))]


def test_large_components_stay_exact():
    big = np.array([[2.0**30, 1.0], [2.0**30, 2.0]])
    score, name = topk_search.search(big[:1], big, np.array([9]), np.array([1, 2]), 2)
    assert [int(s) for s in score[0]] == [2**60 + 2, 2**60 + 1] and name[0].tolist() == [2, 1]


def test_nearest_neighbours(spark):
    df, x = vectors(spark)
    unit = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    found, hits, total = {}, 0, 0
    for r in ann_graph.nearest(df, 5, 50).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 400, 50))
    for q, rows in found.items():
        assert [r[0] for r in sorted(rows)] == [1, 2, 3, 4, 5] and all(abs(s - unit[i] @ unit[q]) < 1e-6 for _, i, s in rows)
        best = sorted((-round(float(unit[i] @ unit[q]), 9), i) for i in range(400) if i != q)[:5]
        hits, total = hits + len({i for _, i in best} & {i for _, i, _ in rows}), total + 5
    assert hits / total >= 0.9
    assert [i for _, i, _ in sorted(found[50])] == [51, 52, 53, 54, 55]  # copies by id
    few = spark.createDataFrame([(0, [1.0, 0.0], 0, ""), (1, [1.0, 1.0], 0, "")], DDL)
    assert [tuple(r)[:3] for r in ann_graph.nearest(few).collect()] == [(0, 1, 1)]
    assert ann_graph.nearest(few.limit(0)).count() == 0


def test_forward_recursion_sums_over_all_paths():
    rng = np.random.default_rng(3)
    model = hmm_lm.Parameters(rng.dirichlet(np.ones(hmm_lm.STATES)), rng.dirichlet(np.ones(hmm_lm.STATES), hmm_lm.STATES), rng.dirichlet(np.ones(hmm_lm.CLASSES), hmm_lm.STATES).T)
    lengths = np.array([1, 2, 7, hmm_lm.SHORT, hmm_lm.SHORT + 1, 1500])
    classes = rng.integers(0, hmm_lm.CLASSES, lengths.sum()).astype(np.uint16)
    found, at = hmm_lm.log_likelihoods(classes, lengths, model), 0
    for n, value in zip(lengths, found, strict=True):
        alpha, total = model.start * model.emit[classes[at]], 0.0
        for c in classes[at + 1 : at + n]:
            total += math.log10(alpha.sum())
            alpha = (alpha / alpha.sum() @ model.move) * model.emit[c]
        assert abs(value - total - math.log10(alpha.sum())) < 1e-6 * n
        at += n


def test_expected_counts_add_up():
    rng = np.random.default_rng(4)
    model = hmm_lm.first_parameters([], np.ones(hmm_lm.CLASSES))
    lengths = np.array([5, 300, 1])
    classes = rng.integers(0, hmm_lm.CLASSES, 306).astype(np.uint16)
    starts, moves, emits = hmm_lm.expected_counts(classes, lengths, model)
    assert abs(starts.sum() - 3) < 1e-4 and abs(emits.sum() - 306) < 1e-3 and abs(moves.sum() - (306 - 3)) < 1e-3
    assert np.allclose(emits.sum(1), np.bincount(classes, minlength=hmm_lm.CLASSES), atol=1e-4)


def some_model(rng):
    return hmm_lm.Parameters(rng.dirichlet(np.ones(hmm_lm.STATES)), rng.dirichlet(np.ones(hmm_lm.STATES), hmm_lm.STATES), rng.dirichlet(np.ones(hmm_lm.CLASSES), hmm_lm.STATES).T)


def test_expected_counts_equal_brute_force():
    rng = np.random.default_rng(6)
    model, lengths = some_model(rng), np.array([1, 700, 9, 300])
    classes = rng.integers(0, 50, lengths.sum()).astype(np.uint16)
    want = [np.zeros(hmm_lm.STATES), np.zeros((hmm_lm.STATES, hmm_lm.STATES)), np.zeros((hmm_lm.CLASSES, hmm_lm.STATES))]
    for at, n in zip(np.cumsum(lengths) - lengths, lengths, strict=True):
        b = model.emit[classes[at : at + n]]
        alpha, beta = [model.start * b[0]], [np.ones(hmm_lm.STATES)]
        for x in b[1:]:
            alpha.append(alpha[-1] / alpha[-1].sum() @ model.move * x)
        for x in b[:0:-1]:
            beta.append(model.move @ (x * beta[-1] / beta[-1].sum()))
        beta = beta[::-1]
        for t in range(n):
            gamma = alpha[t] * beta[t]
            want[2][classes[at + t]] += gamma / gamma.sum()
            if t:
                both = alpha[t - 1][:, None] * model.move * (b[t] * beta[t])[None, :]
                want[1] += both / both.sum()
            else:
                want[0] += gamma / gamma.sum()
    for x, y in zip(hmm_lm.expected_counts(classes, lengths, model), want, strict=True):
        assert np.allclose(x, y, rtol=1e-3, atol=1e-3)


def test_scores_equal_brute_force(documents, monkeypatch):
    """Sums over state paths, one token after another, with the parameters and counts that the query came to."""
    import zlib

    seen, train = [], hmm_lm.train
    monkeypatch.setattr(hmm_lm, "train", lambda *a: seen.append((a[2], train(*a))) or seen[-1][1])
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"W{int(w)}" for w in rng.zipf(1.5, int(rng.integers(0, 700)))[:700])) for i in range(30)] + [(40, None), (41, "unseen words here"), (None, "w1 w2"), *((i, " ".join(f"u{j}" for j in range(9000))) for i in (60, 61))]
    found = {r["doc_id"]: r["score"] for r in hmm_lm.score(documents(rows)).collect()}
    vocabulary, model = seen[0]
    counts, classes = Counter(), hmm_lm.WordClasses(vocabulary.own)
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update([*hmm_lm.words_of(t), hmm_lm.END])
    for i, t in rows:
        alpha, total = None, 0.0
        for w in [*hmm_lm.words_of(t), hmm_lm.END]:
            c = classes[w]
            word = (counts[w] + 0.5) / (vocabulary.class_tokens[c] + 0.5 * (vocabulary.class_types[c] + 1)) if c > hmm_lm.OWN_CLASSES else 1.0
            alpha = (model.start if alpha is None else alpha @ model.move) * model.emit[c] * word
            total, alpha = total + math.log10(alpha.sum()), alpha / alpha.sum()
        assert abs(found[i] - total) < 1e-6 * max(1, abs(total))


def test_scores_of_edge_cases(documents):
    import zlib

    rows = [(i, f"the cat sat on mat number{i % 7}") for i in range(40)] + [(50, None), (51, ""), (52, "unknownword" * 40), (None, "the cat"), (53, "Cat " * 3000)]
    found = hmm_lm.score(documents(rows)).collect()
    known = Counter()
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            known.update([*(t or "").encode().lower().split(), hmm_lm.END])
    n, v = sum(known.values()), len(known)
    by_id = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows)
    for i, t in rows:
        tokens, r = [*(t or "").encode().lower().split(), hmm_lm.END], by_id[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(known[w] > 0 for w in tokens), n)
        assert abs(r["base_score"] - sum(math.log10((known[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)) < 1e-6 and r["score"] < 0
    assert by_id[None]["held_out"] is None
    assert hmm_lm.score(documents([])).count() == 0
    assert [r["base_score"] for r in hmm_lm.score(documents([(None, "a b")])).collect()] == [0.0]


def test_rounds_go_on_until_the_graph_settles(spark, monkeypatch):
    shares, share = [], ann_graph.new_share
    monkeypatch.setattr(ann_graph, "BLOCK_POINTS", 64)
    monkeypatch.setattr(ann_graph, "new_share", lambda *a: shares.append(share(*a)) or shares[-1])
    v = np.random.default_rng(5).standard_normal((1500, 32))
    ann_graph.nearest(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>"))
    assert len(shares) > 2 and shares[-1] <= ann_graph.SETTLED


def test_meetings_equal_brute_force():
    rng, width = np.random.default_rng(6), 8
    guests = np.zeros(300, ann_graph.guests_type(width))
    guests["at"], guests["other"], guests["new"] = np.arange(300) % 11, rng.permutation(300), rng.random(300) < 0.3
    guests["worst"], guests["code"] = rng.random(300) - 0.2, rng.integers(-127, 128, (300, width))
    want = set()
    for host in range(11):
        own = guests[guests["at"] == host]
        codes = ann_graph.unit(own["code"])
        for i, a in enumerate(own):
            met = sorted(((float(codes[i] @ codes[j]), b["other"]) for j, b in enumerate(own) if i != j and (a["new"] or b["new"])), reverse=True)
            want |= {(a["other"], q) for s, q in met[: ann_graph.MET] if s > a["worst"]}
    found = ann_graph.meetings_of(guests)
    assert {(m["at"], m["other"]) for m in found} == want and len(found) == len(want)


def test_top_of_holds_the_greatest():
    sims = np.random.default_rng(7).standard_normal((20, 2100)).astype(np.float32)
    row, column = ann_graph.top_of(sims, 40)
    for i in range(20):
        assert set(np.argsort(-sims[i])[:40]) <= set(column[row == i]) and (row == i).sum() < 120


def test_a_round_makes_no_row_for_each_edge(spark, monkeypatch):
    v = np.random.default_rng(8).integers(-127, 128, (600, 8)).astype(np.int8)
    monkeypatch.setattr(ann_graph, "BLOCK_POINTS", 64)
    points = spark.createDataFrame([(i, x.astype(float).tolist(), bytearray(x.tobytes())) for i, x in enumerate(v)], "p bigint, embedding array<double>, code binary")
    graph = ann_graph.durable(ann_graph.merged(ann_graph.bundled(points, 8, 1), ann_graph.first_neighbours(points, 8, 2), 8, 1))
    after = ann_graph.improved(graph, 8, 1)
    assert "Generate" not in after._jdf.queryExecution().executedPlan().toString()
    before, lists = (np.frombuffer(df.first()["data"], ann_graph.points_type(8)) for df in (graph, after))
    assert (before["p"] == np.arange(600)).all() and (lists["p"] == np.arange(600)).all()
    assert (lists["s"] >= before["s"]).all() and (lists["s"].sum(1) > before["s"].sum(1)).any()
    for a, b in zip(before["q"], lists, strict=True):
        assert set(b["q"][b["new"]]) == set(b["q"]) - set(a) - {-1} and len(set(b["q"])) == ann_graph.NEIGHBOURS
