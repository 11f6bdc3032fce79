import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from lakescout.llm import bpe_tree, packing

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", None, "a", "  leading", "it's we'll\n\n x  \t y ", "中文字 é😀 　z", "word " * 3000, "x" * 9000, "12 345,67!! ...", "a\x1cb\x85c"]


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tree_equals_plain_encoding_at_any_leaf(plain):
    rng = random.Random(3)
    for leaf in (1, 2, 5, 40):
        tree = bpe_tree.TreeCodec(RANKS, leaf_chars=leaf, leaf_ids=3)
        for _ in range(400):
            text = "".join(rng.choices("ab' \n\t é'sll12.,!\x1c　中😀", k=rng.randint(0, 60)))
            ids = tree.encode(text)
            assert ids == plain.encode_ordinary(text)
            assert tree.decode(ids) == text.encode()


def test_digests_of_edge_cases(documents, plain):
    rows = list(enumerate(TEXTS)) + [(None, "no id"), (0, "again")]
    found = bpe_tree.round_trip_digests(documents(rows)).collect()
    assert len(found) == len(rows)
    want = sorted((str(i), len(ids := plain.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r[0]), *r[1:]) for r in found) == want
    assert bpe_tree.round_trip_digests(documents([])).count() == 0


def test_round_trip_of_texts(documents):
    rows = [(i, t) for i, t in enumerate(TEXTS) if t is not None]
    out = bpe_tree.decode_documents(bpe_tree.encode_documents(documents(rows))).collect()
    assert {r["doc_id"]: r["text"] for r in out} == dict(rows)


def test_packing_holds_every_id_once_without_padding(documents):
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    tokenizer.encode_special_tokens = True
    rows = list(enumerate(TEXTS))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(documents(rows), capacity=256).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, t in rows:
        ids, at = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256 and at & (at - 1) == 0
    assert packing.pack(documents([])).count() == 0
    with pytest.raises(ValueError):
        packing.pack(documents([]), capacity=100)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_are_encoded_as_whole_texts(name):
    path = P.path(name)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    known, rng = packing.TextIds(path), random.Random(5)
    letters = "".join(chr(c) for c in range(0xC0, 0x250))
    texts = ["".join(rng.choices("ab' \n\t é'SsllÉ12.,!İ\x1c\x85́　中😀Σς<|end", k=rng.randint(0, 50))) for _ in range(1500)]
    texts += ["".join(rng.choices(letters + "abcXYZ .,&&", k=rng.randint(0, 30))) for _ in range(1500)] + list(letters) + ["a" * 3000 + ", " + "B" * 48 + "! " + "c" * 49 + "?"]
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        ids, sizes = known.encode(pa.array([None, *some]))
        ends = np.cumsum(sizes)
        assert sizes[0] == 0
        for text, begin, end in zip(some, ends[:-1], ends[1:], strict=True):
            assert ids[begin:end].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    # What is kept is bounded in characters as well.
    assert all(len(part) <= packing.CACHE_CHARS for part in known.young) and known.by_word == (name == "word_bpe_49k.json")


def test_shares_hold_all_rows():
    texts = ["x" * n for n in (5, 0, 30, 2, 2, 2, 11)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["doc_id", "text"])
    assert [p.column(0).to_pylist() for p in packing.shares([batch, batch.slice(0, 0)], 10)] == [[0, 1], [2], [3, 4, 5], [6], [7]]
