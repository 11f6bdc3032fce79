import random

from lakescout.llm import near_dedup


def brute(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdef", k=3))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(60):
        text = list(base)
        for _ in range(rng.randint(0, 7)):
            text[rng.randrange(len(text))] = word()
        rows.append((i, " ".join(text).upper() if i % 5 == 0 else "\t".join(text)))
    passage = " ".join(word() for _ in range(60))
    rows += [(100 + i, passage + " " + " ".join(word() for _ in range(60))) for i in range(20)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, ""), (203, None), (204, "one"), (205, "one"), (206, "one two"), (207, " \n"), (208, "a b c d e f g h"), (209, "a b c d e f g h i")]
    return rows


def test_components_equal_brute_force(spark, documents):
    rows = corpus()
    for rule in (near_dedup.THREE_WORDS, near_dedup.FIVE_WORDS):
        want = brute(rows, rule.words, rule.percent)
        found = near_dedup.near_duplicates(documents(rows), rule).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_null_ids_repeated_rows_and_empty_tables(documents):
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (7, "a b c d")]
    found = near_dedup.near_duplicates(documents(rows)).collect()
    assert sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in found) == [("5", 5, True), ("5", 5, True), ("7", 5, False), ("None", None, True)]
    assert near_dedup.near_duplicates(documents([])).count() == 0
    kept = near_dedup.keep_documents(documents(rows))
    assert kept.columns[:2] == ["doc_id", "text"] and sorted(str(r["doc_id"]) for r in kept.collect()) == ["5", "None"]


def test_one_row_of_each_group_stays(spark, documents):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text), (3, "quite another text of seven words"), (3, text.upper()), (9, text), (None, text), (None, None), (11, ""), (11, ""), (12, " "), (13, text + " more")]
    kept = near_dedup.keep_documents(documents(rows).withColumnsRenamed({"lang": "_dropped", "source": "root", "score": "times"}).selectExpr("*", "1 stays", "2 mark", "3 node")).collect()
    assert sorted((str(r["doc_id"]), (r["text"] or "").lower()) for r in kept) == sorted([("3", text), ("3", "quite another text of seven words"), ("None", text), ("None", ""), ("11", ""), ("11", ""), ("12", " ")])
    assert near_dedup.keep_documents(documents([])).count() == 0


def test_sets_that_no_leader_links_are_found(spark, documents):
    # Two dense groups whose leaders aren't linked, and a chain between them that only full comparison finds.
    words = [f"v{i}" for i in range(200)]
    rows = [(i, " ".join(words[i * 4 : i * 4 + 120])) for i in range(20)]
    want = brute(rows, 3, 85)
    found = near_dedup.near_duplicates(documents(rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want and {c for _, c in want.values()} == {0}
