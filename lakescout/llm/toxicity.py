"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text. Every text is cut into windows of
a few words, and each window is compressed with either dictionary; what the toxic one saves tells how close the
window is to toxic text. A document's distance adds up what its windows save from a calibrated saving on, and
its score is a calibrated logistic curve of that.

A toxic document is mostly ordinary text, and what sets it apart may be parts of words. So the toxic dictionary
is the ordinary one behind the fragments of toxic training documents whose character n-grams are in a far larger
share of toxic than of ordinary documents (by log likelihood), among all toxic documents and then among those
that hold none of the fragments so far. Ordinary text then lies at the same distance in
both dictionaries and costs the same with either, and a saving comes from toxic fragments alone.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescout.llm.common import arrow_schema, map_batches, remainder, rows_to_batch, slices
from lakescout.llm.quality import calibrate, pa_mask, sigmoid, training_rows

#: Labelled rows that the model is fitted on at most.
SAMPLE_ROWS = 6_000
#: Runs of 16 words of ordinary training texts that the ordinary dictionary is trained on at most, evenly spread.
TRAINING_RUNS = 60_000
WINDOW_WORDS = 8
ORDINARY_BYTES = 16_384
#: Lengths of n-grams in characters.
GRAMS = range(4, 11)
#: Least log-likelihood ratio of a telling n-gram.
LEAST = 24.0
#: Documents that hold a word which are listed by number at most.
FEW = 8
THRESHOLD = 0.5


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def word_sets(*classes: list[str | None]) -> list[set[frozenset]]:
    """The sets of words of each class of texts; copies count once. A word is one object, however many hold it."""
    one: dict[bytes, str] = {}
    return [{frozenset(one.get(w) or one.setdefault(w, w.decode()) for w in words_of(t)) for t in texts} for texts in classes]


def runs(texts: list[str | None], words: int = 16):
    """Runs of so many words of each text, one after the other."""
    for found in map(words_of, texts):
        for i in range(0, len(found), words):
            yield b" ".join(found[i : i + words])


def windows(text: str | None, words: int = WINDOW_WORDS) -> list[bytes]:
    """The whole text, A-Z lower-cased, as windows of a few words each joined by one space, with a space at either end."""
    found = words_of(text)
    return [b" " + b" ".join(found[i : i + words]) + b" " for i in range(0, len(found), words)]


@dataclass
class Dictionaries:
    """Both dictionaries, the saving from which on a window counts, and the calibration of distances."""

    toxic: bytes
    ordinary: bytes
    saving: int = 3
    slope: float = 0.0
    offset: float = 0.0

    def savings(self, parts: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves over the ordinary one, for each window."""
        if self.toxic == self.ordinary:
            return np.zeros(len(parts), np.int32)
        toxic, ordinary = compressor(self.toxic).compress, compressor(self.ordinary).compress
        return np.fromiter((len(ordinary(p)) - len(toxic(p)) for p in parts), np.int32, len(parts))

    def distance(self, saved: np.ndarray) -> float:
        return math.log1p(int(np.maximum(saved - self.saving + 1, 0).sum()))

    def score(self, texts: list[str | None]) -> np.ndarray:
        return sigmoid(self.slope * np.array([self.distance(self.savings(windows(t))) for t in texts], dtype=float) + self.offset)


@lru_cache(maxsize=8)
def compressor(dictionary: bytes) -> zstd.ZstdCompressor:
    # The window reaches all of either dictionary, and equal tables make equal text cost the same with both.
    parameters = zstd.ZstdCompressionParameters(window_log=17, hash_log=16, chain_log=16, search_log=5, min_match=4, target_length=32, strategy=zstd.STRATEGY_BTLAZY2, format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    data = zstd.ZstdCompressionDict(dictionary, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=parameters)
    return zstd.ZstdCompressor(dict_data=data, compression_params=parameters)


def train_ordinary(samples: list[bytes], size: int = ORDINARY_BYTES) -> bytes:
    """A trained zstandard dictionary; of the samples' text itself where they are too few to train on."""
    try:
        return zstd.train_dictionary(size, samples).as_bytes()
    except zstd.ZstdError:
        return (b"".join(samples) or b" ")[-size:]


def grams(word: str, lengths=GRAMS) -> set[str]:
    """Runs of characters of a word with a space at either end, of all the lengths."""
    w = f" {word} "
    return {w[i : i + k] for k in lengths for i in range(len(w) - k + 1)}


def unlike(documents: list[frozenset]) -> list[frozenset]:
    """The documents without near copies of others, of which at least half of all words of both are the same: a
    passage that was copied isn't found in several documents."""
    numbers: dict[str, int] = {}
    found: list[tuple[int, frozenset]] = []
    for document in sorted(documents, key=lambda d: (-len(d), sorted(d))):
        bits = 0
        for w in document:
            bits |= 1 << numbers.setdefault(w, len(numbers))
        if all(2 * (bits & other).bit_count() < (bits | other).bit_count() for other, _ in found):
            found.append((bits, document))
    return [document for _, document in found]


def holders_of_words(documents: list[frozenset]) -> dict[str, int | tuple[int, ...]]:
    """Which documents hold a word: their numbers, and above ``FEW`` of them the bits of a number. Most words are in
    one document or two, and the bits take as many as there are documents."""
    out: dict[str, int | tuple[int, ...]] = {}
    for number, document in enumerate(documents):
        own = (number,)
        for w in document:
            held = out.get(w)
            if held is None:
                out[w] = own
            elif isinstance(held, tuple) and len(held) < FEW:
                out[w] = (*held, number)
            else:
                out[w] = bits_of(held) | 1 << number
    return out


def bits_of(held: int | tuple[int, ...]) -> int:
    """The documents that hold a word, as the bits of a number."""
    if isinstance(held, int):
        return held
    bits = 0
    for number in held:
        bits |= 1 << number
    return bits


def holders(words: dict[str, int | tuple[int, ...]], wanted=None, lengths=GRAMS) -> dict[str, int]:
    """Which documents hold an n-gram of words; with ``wanted``, of those n-grams alone."""
    out: dict[str, int] = {}
    for w, held in words.items():
        bits = bits_of(held)
        for g in grams(w, lengths) if wanted is None else grams(w, lengths) & wanted:
            out[g] = out.get(g, 0) | bits
    return out


def likelihood_ratio(a: int, b: int, n: int, m: int) -> float:
    """Log-likelihood ratio of what a of n and b of m documents hold; 0 unless the first share is over four times the other."""
    if a < 3 or a * m <= 4 * b * n:
        return 0.0
    expected = (a + b) * n / (n + m)
    return 2 * (a * math.log(a / expected) + (b * math.log(b / (a + b - expected)) if b else 0))


def apart(candidates: set[str], toxic: dict[str, int], ordinary: dict[str, int | tuple[int, ...]], n: int, m: int) -> list[str]:
    """The candidates best first, each judged by the words that none before it is in."""
    index: dict[str, list[str]] = {}
    for w in toxic.keys() | ordinary.keys():
        for g in grams(w) & candidates:
            index.setdefault(g, []).append(w)
    used: set[str] = set()

    def judged(g: str) -> float:
        a = b = 0
        for w in index[g]:
            if w not in used:
                a, b = a | toxic.get(w, 0), b | bits_of(ordinary.get(w, 0))
        return likelihood_ratio(a.bit_count(), b.bit_count(), n, m)

    ratios, found = {g: judged(g) for g in index}, []
    while ratios:
        best = max(ratios, key=lambda g: (ratios[g], len(g), g))
        if ratios[best] < LEAST:
            break
        found.append(best)
        new = {w for w in index[best] if w not in used}
        used |= new
        for g in {g for w in new for g in grams(w)} & ratios.keys():
            ratios[g] = judged(g)
        ratios = {g: x for g, x in ratios.items() if x >= LEAST}
    return found


def telling_grams(toxic: list[frozenset], ordinary: list[frozenset]) -> list[str]:
    """Character n-grams of words that a far larger share of toxic than of ordinary documents holds, the best first.

    The bar is the same for all of them, and an n-gram counts in words that no better one is in. What they don't
    explain, the toxic documents that hold none, is compared to the ordinary documents again, until nothing is
    found: a small class isn't measured against a large one.
    """
    toxic = unlike(toxic)
    words, plain = holders_of_words(toxic), holders_of_words(ordinary)
    here: dict[str, int] = {}
    there: dict[str, int] = {}
    for k in GRAMS:  # one length at a time: most n-grams are in too few documents, and a bit for each document is large
        own = {g: bits for g, bits in holders(words, lengths=(k,)).items() if bits.bit_count() >= 3}
        there |= {g: bits.bit_count() for g, bits in holders(plain, own.keys(), (k,)).items()}
        here |= own
    left, m, found = (1 << len(toxic)) - 1, len(ordinary), []
    while left:
        n = left.bit_count()
        candidates = {g for g, bits in here.items() if likelihood_ratio((bits & left).bit_count(), there.get(g, 0), n, m) >= LEAST}
        new = apart(candidates, {w: bits for w, held in words.items() if (bits := bits_of(held) & left)}, plain, n, m)
        if not new:
            break
        found += new
        for g in new:
            left &= ~here[g]
    return found


def train_toxic(documents: list[frozenset], telling: list[str], whole_words: bool) -> bytes:
    """The telling n-grams, the best last; before them, if wanted, the words of more than one document that they are
    in, the most frequent last."""
    wanted = set(telling)
    words = {w: n for w, held in holders_of_words(documents).items() if (n := bits_of(held).bit_count()) > 1 and grams(w) & wanted}
    most = sorted(words if whole_words else (), key=lambda w: (words[w], w))
    return "".join([*(f" {w} " for w in most), *reversed(telling)]).encode()


def fit(toxic: list[str], ordinary: list[str]) -> Dictionaries:
    """Train both dictionaries and calibrate savings and distances on the training documents.

    With no document of a class, or nothing that tells them apart, every score is the smoothed share of toxic ones.
    """
    sets = [list(x) for x in word_sets(toxic, ordinary)]
    share = (len(toxic) + 0.5) / (len(toxic) + len(ordinary) + 1)
    flat = Dictionaries(b" ", b" ", 1, 0.0, math.log(share / (1 - share)))
    telling = telling_grams(*sets) if toxic and ordinary else []
    if not telling:
        return flat
    every = 1 + sum(1 for _ in runs(ordinary)) // TRAINING_RUNS
    base = train_ordinary(list(islice(runs(ordinary), 0, None, every)))
    y = np.array([1.0] * len(toxic) + [0.0] * len(ordinary))
    best, model = math.inf, flat
    # Whole words save more where a class forms them alike, and cost more where ordinary text has them too.
    for whole_words in (False, True):
        tried = Dictionaries(train_toxic(sets[0], telling, whole_words) + base, base)
        saved = [tried.savings(windows(t)) for t in (*toxic, *ordinary)]
        for saving in range(1, 9):
            x = np.array([Dictionaries(b"", b"", saving).distance(s) for s in saved])
            slope, offset = calibrate(x, y)
            p = np.clip(sigmoid(slope * x + offset), 1e-9, 1 - 1e-9)
            loss = float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
            if loss < best:
                best, model = loss, Dictionaries(tried.toxic, base, saving, slope, offset)
    return model


def fit_on(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Dictionaries:
    """Fit on at most so many labelled texts that aren't held out. A doc_id that comes repeatedly counts once.

    The bounded sample goes to one task, which trains; the driver gets the dictionaries alone.
    """
    sample = training_rows(documents, labels, "toxic", rows).groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text"))
    schema = arrow_schema("toxic binary,ordinary binary,saving int,slope double,offset double")

    def run(batches):
        found = sorted((row for _, *columns in slices(batches, "doc_id", "label", "text") for row in zip(*columns, strict=True)), key=lambda row: row[0])
        model = fit([t for _, y, t in found if y == 1], [t for _, y, t in found if y == 0])
        yield rows_to_batch(schema, [[model.toxic], [model.ordinary], [model.saving], [model.slope], [model.offset]])

    best = map_batches(sample.repartition(1), run, "toxic binary, ordinary binary, saving int, slope double, offset double").first()
    if best is None:  # no row, no task
        return fit([], [])
    return Dictionaries(bytes(best["toxic"]), bytes(best["ordinary"]), best["saving"], best["slope"], best["offset"])


def score_documents(documents: DataFrame, model: Dictionaries, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of documents. Null and empty texts have no window
    and so the distance 0; repeated rows are scored alike; held_out is null for a null doc_id."""
    ddl = "doc_id long, score double"
    schema = arrow_schema(ddl)

    def run(batches):
        for _, keys, texts in slices(batches, "doc_id", "text"):
            yield rows_to_batch(schema, [keys, model.score(texts)])

    scored = map_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, ddl)
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_documents(documents: DataFrame, model: Dictionaries, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents, with all their columns, whose score stays under the threshold; texts are read once."""

    def run(batches):
        for part, texts in slices(batches, "text"):
            yield part.filter(pa_mask(model.score(texts) < threshold))

    return map_batches(documents, run, documents.schema)
