"""Harmonic packing of token sequences into fixed-length training sequences.

Lengths fall into reciprocal-capacity classes: class k holds pieces of capacity / k tokens, and a bin of class
k takes exactly k of them, whatever the other classes do. Documents may be cut, so a document is cut into
pieces whose lengths are class lengths, largest first; with a capacity that is a power of two, the classes
k = 1, 2, 4, ... capacity need at most one piece of each class below k = 1, and every full bin is exactly full.

Workers fill bins on their own: a worker numbers its pieces of each class, and one small table of
(worker, class) counts tells each worker where its numbers start. The last bin of a class that lacks pieces is
dealt out as shorter sequences that each hold a power of two of pieces, which need no padding.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakescout.llm.common import arrow_schema, durable, held, map_batches, rows_to_batch

CAPACITY = 4096
END_ID = 2
#: Encoded parts of words that a worker keeps in each of its two generations, and characters of a kept one at most.
CACHE_PARTS, CACHE_CHARS = 500_000, 48
#: Characters of texts that a worker encodes at once, unless one text has more.
BATCH_CHARS = 6_000_000
#: Latin letters and punctuation behind them, which are matches of their own; but for U+0130, whose lower case ends in
#: a mark that would go with what follows.
LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]"
WORD = f"^(?P<stem>{LETTERS}{{1,{CACHE_CHARS}}})(?P<tail>[.,;:!?|*&%$#]*)$"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def gather(values: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of these numbers one after another, where runs of these sizes lie in values; and their sizes."""
    n, start = size[which], np.cumsum(size) - size
    return values[np.repeat(start[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


class TextIds:
    """Ids of texts, whose words are encoded once each.

    The tokenizer's pattern never matches across white space and its normaliser treats all of it alike, so the ids of
    a text are those of its words one after another, and those of Latin letters with punctuation behind them are the
    letters' and the punctuation's. Parts that were used lately are kept in two generations: the older one goes when
    the younger one is full. With a tokenizer whose normaliser or pattern is another, texts are encoded whole.
    """

    #: What the tokenizer's file says of its normaliser and pattern.
    NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
    PATTERN = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}

    def __init__(self, path: str):
        # A task has one core; the library's thread pool would take others'.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = letters.encode_special_tokens = True
        said = json.loads(self.tokenizer.to_str())
        self.by_word = said["normalizer"] == self.NORMALIZER and (said["pre_tokenizer"] or {}).get("pretokenizers", [None])[0] == self.PATTERN and said["model"]["end_of_word_suffix"] == "</w>"
        # Lower-case words of Latin letters are what the normaliser makes of them, and one match each.
        letters.normalizer = normalizers.Sequence([])
        letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        letters.model._resize_cache(0)
        self.letters = letters
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # The ids at which a match of the pattern ends.
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (null: none), and how many each has."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            found = [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, "<u4"), *found]), np.array([len(f) for f in found], np.int64)
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        split = pc.extract_regex(coded.dictionary, WORD)
        stems = pc.coalesce(pc.utf8_lower(pc.struct_field(split, 0)), coded.dictionary)
        parts = pa.concat_arrays([stems, pc.fill_null(pc.struct_field(split, 1), "")]).dictionary_encode()
        found = self.look_up(parts.dictionary.to_pylist())
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        both = np.asarray(parts.indices).reshape(2, -1).T.ravel()
        by_word, n = gather(np.frombuffer(b"".join(found), "<u4"), size, both)
        ids, n = gather(by_word, n.reshape(-1, 2).sum(1), np.asarray(coded.indices))
        ends = np.concatenate(([0], np.cumsum(n)))[np.asarray(words.offsets) - words.offsets[0].as_py()]
        return ids, np.diff(ends)

    def look_up(self, parts: list[str]) -> list[bytes]:
        found = list(map(self.young.get, parts))
        missing = [i for i, ids in enumerate(found) if ids is None]
        # Those of the old generation that are still in use grow young again; parts are distinct.
        names = [parts[i] for i in missing]
        fresh = dict(zip(names, map(self.old.get, names), strict=True))
        fresh |= self.learn([part for part, ids in fresh.items() if ids is None])
        for i, name in zip(missing, names, strict=True):
            found[i] = fresh[name]
        self.young.update(fresh if max(map(len, names), default=0) <= CACHE_CHARS else {part: ids for part, ids in fresh.items() if len(part) <= CACHE_CHARS})
        if len(self.young) > CACHE_PARTS:
            self.old, self.young = self.young, {}
        return found

    def learn(self, parts: list[str]) -> dict[str, bytes]:
        """Encode parts. Lower-case words of Latin letters go together in long strings and are told apart by the ids
        that end a match; unless there are other than one for each."""
        words, rest, out, lower = [], [], {}, re.compile(f"(?![A-Z]){LETTERS}+").fullmatch
        for part in parts:
            (words if lower(part) and part.islower() else rest).append(part)
        groups = [words[at : at + 256] for at in range(0, len(words), 256)]
        for group, found in zip(groups, self.letters.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.asarray(found.ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(group):
                rest += group
                continue
            raw, begin = ids.tobytes(), 0
            for word, stop in zip(group, (4 * stops).tolist(), strict=True):
                out[word] = raw[begin:stop]
                begin = stop
        for at in range(0, len(rest), 1024):
            some = rest[at : at + 1024]
            for part, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                out[part] = np.asarray(found.ids, dtype="<u4").tobytes()
        return out


def text_ids(path: str) -> TextIds:
    return held(__name__, path, lambda: TextIds(path))


def shares(batches, most: int = BATCH_CHARS):
    """Cut Arrow batches of (doc_id, text) into runs of rows with so many bytes of text at most, or one row."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0))
        begin = total = 0
        for at, size in enumerate(sizes.tolist()):
            if at > begin and total + size > most:
                yield batch.slice(begin, at - begin)
                begin, total = at, 0
            total += size
        if begin < batch.num_rows:
            yield batch.slice(begin)


def cut(tokens: int, capacity: int) -> list[int]:
    """The lengths that a document is cut into: whole capacities, then halves, quarters and so on."""
    whole, rest = divmod(tokens, capacity)
    pieces = [capacity] * whole
    while rest:
        piece = 1 << (rest.bit_length() - 1)
        pieces.append(piece)
        rest -= piece
    return pieces


def cut_documents(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Tokenize whole texts and cut them: a row for each piece, with the worker that cut it and its number there
    among the pieces of its length."""
    path, ddl = tokenizer or default_tokenizer(), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, worker int, number long"
    schema, end = arrow_schema(ddl), np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches):
        known, worker, numbers = text_ids(path), TaskContext.get().partitionId(), {}
        for part in shares(batches):
            out = [[] for _ in schema]
            ids, sizes = known.encode(part.column(1))
            ids, begin = memoryview(ids.tobytes()), 0
            for key, size in zip(part.column(0).to_pylist(), sizes.tolist(), strict=True):
                whole, start = memoryview(bytes(ids[4 * begin : 4 * (begin + size)]) + end), 0
                begin += size
                for length in cut(size + 1, capacity):
                    number = numbers.get(length, 0)
                    numbers[length] = number + 1
                    for column, value in zip(out, (key, start, length, zlib.crc32(whole[4 * start : 4 * (start + length)]), size + 1, worker, number), strict=True):
                        column.append(value)
                    start += length
            yield rows_to_batch(schema, out)
            pa.default_memory_pool().release_unused()  # Arrow keeps what a part took and takes more for the next one

    return map_batches(documents.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"), run, ddl)


def pack(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pack every whole text, followed by ``end_id``, into sequences of at most ``capacity`` tokens (a power of two).

    Returns (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece. A null or
    empty text is the end id alone. Repeated rows and null doc_ids are packed as documents of their own. Every
    sequence is full or holds a power of two of tokens, so none needs padding.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity has to be a power of two")
    pieces = durable(cut_documents(documents, capacity, tokenizer, end_id))
    # A row for each worker and class: where the worker's numbers start, and how many pieces the class has.
    counts = pieces.groupBy("length", "worker").agg(F.count(F.lit(1)).alias("n"))
    by_class = Window.partitionBy("length")
    starts = counts.select("length", "worker", (F.sum("n").over(by_class.orderBy("worker")) - F.col("n")).alias("first"), F.sum("n").over(by_class).alias("total"))
    # Fewer than 64 classes, and a row for each worker: the bound of this broadcast is the number of tasks.
    placed = pieces.join(F.broadcast(starts), ["length", "worker"]).withColumn("rank", F.col("first") + F.col("number"))
    per_bin = (F.lit(capacity) / F.col("length")).cast("long")
    full = F.floor(F.col("total") / per_bin).cast("long")
    rest, at = F.col("total") - full * per_bin, F.col("rank") - full * per_bin
    # In the rest of r pieces, piece i lies in the block of the highest bit in which i and r differ.
    bit = F.floor(F.log2((at.bitwiseXOR(rest)).cast("double"))).cast("int")
    begin = F.call_function("shiftright", rest, bit + 1)
    begin = (begin * F.pow(F.lit(2.0), bit + 1)).cast("long")
    in_full = F.col("rank") < full * per_bin
    bin_number = F.when(in_full, F.floor(F.col("rank") / per_bin).cast("long")).otherwise(full + bit)
    slot = F.when(in_full, F.col("rank") % per_bin).otherwise(at - begin)
    class_number = F.log2(F.col("length").cast("double")).cast("long")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (bin_number * 64 + class_number).alias("sequence_id"), (slot * F.col("length")).alias("offset"))
