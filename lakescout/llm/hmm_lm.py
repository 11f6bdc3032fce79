"""A hidden Markov language model, trained by Baum-Welch over partitions, that scores texts exactly.

A text is a sequence of tokens: its lower-cased words and one end. Tokens fall into classes: the end, each of the
most frequent training words on its own, and classes of the remaining words by their first and last bytes. Hidden
states emit classes, and a class emits its words by smoothed counts over all training text::

    P(tokens) = sum over state paths of  prod A[s', s] B[s, class] * prod (c + 0.5) / (N_class + 0.5 (V_class + 1))

so that every sequence of words, known or not, has a probability and the parameters of the states are of bounded
size. Expected counts come from forward and backward messages over each whole training text, are summed for each
class by Spark, and give the next parameters. A text's log likelihood is the scaled forward recursion over all of it; long texts are
cut into segments whose transfer matrices are multiplied, which is the same sum in another order.

Counts of rare words are never gathered in one place: batches of documents send the hashes of their words to
buckets of the vocabulary, whose number grows with the corpus, and get the counts back.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescout.llm.common import Scratch, arrow_schema, map_batches, remainder, rows_to_batch, ship, slices

STATES = 8
OWN_CLASSES, SHAPE_CLASSES = 8_192, 4_096
CLASSES = 1 + OWN_CLASSES + SHAPE_CLASSES
PASSES = 3
#: Training documents that the first parameters are drawn from, whole, in one task; those with the smallest hashes.
FIRST_DOCUMENTS, FIRST_PASSES = 600, 15
SEGMENT, SHORT = 128, 512
#: Words that a batch of documents holds at most, unless one document has more.
BATCH_WORDS = 1_200_000
#: Corpus tokens for each bucket of the vocabulary.
BUCKET_TOKENS = 6_000_000
COUNTER_WORDS = 400_000
END = b"\n"


def words_of(text: str | None) -> list[bytes]:
    """Words between white space, A-Z in lower case."""
    return (text or "").encode().lower().split()


def held_out(doc_id):
    return remainder(doc_id) == 1


def count_words(documents: DataFrame) -> DataFrame:
    """(word, count) over the training documents, ends included; those without a doc_id aren't learned from."""
    ddl = "word binary, count long"
    schema = arrow_schema(ddl)

    def run(batches):
        found: dict[bytes, int] = {}
        for (_, texts) in slices(batches, "text"):
            for text in texts:
                for word in words_of(text):
                    found[word] = found.get(word, 0) + 1
            found[END] = found.get(END, 0) + len(texts)
            if len(found) > COUNTER_WORDS:
                yield rows_to_batch(schema, [list(found), list(found.values())])
                found = {}
        yield rows_to_batch(schema, [list(found), list(found.values())])

    training = documents.where(remainder(F.col("doc_id").cast("long")) != 1).select(F.col("text").cast("string").alias("text"))
    return map_batches(training, run, ddl).groupBy("word").agg(F.sum("count").alias("count"))


def shape_class(word: bytes) -> int:
    return 1 + OWN_CLASSES + xxhash.xxh64_intdigest(word[:1] + b" " + word[-3:]) % SHAPE_CLASSES


class WordClasses(dict):
    """Class of a word, kept for words met lately."""

    def __init__(self, own: list[bytes]):
        super().__init__()
        self.own = {w: 1 + i for i, w in enumerate(own)} | {END: 0}

    def __missing__(self, word: bytes) -> int:
        if len(self) > COUNTER_WORDS:
            self.clear()
        found = self.own.get(word)
        self[word] = found = shape_class(word) if found is None else found
        return found


@dataclass
class Vocabulary:
    """What the driver knows of the training words: totals and what each class holds."""

    tokens: int
    types: int
    own: list[bytes]
    own_counts: np.ndarray
    class_tokens: np.ndarray
    class_types: np.ndarray


@dataclass
class Parameters:
    start: np.ndarray
    move: np.ndarray
    #: By class and state.
    emit: np.ndarray


def gather_vocabulary(counts: DataFrame) -> Vocabulary:
    """Totals over (word, count). The driver gets as many rows as there are classes, whatever the corpus."""
    total = counts.agg(F.sum("count"), F.count(F.lit(1))).first()
    top = counts.where(F.col("word") != F.lit(END)).orderBy(F.desc("count"), "word").limit(OWN_CLASSES).collect()
    own = [bytes(r["word"]) for r in top]
    ddl = "class int, count long"
    schema = arrow_schema(ddl)

    def run(batches):
        classes = WordClasses(own)
        for _, found, n in slices(batches, "word", "count"):
            yield rows_to_batch(schema, [[classes[bytes(w)] for w in found], n])

    tokens, types = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in map_batches(counts, run, ddl).groupBy("class").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        tokens[r["class"]], types[r["class"]] = r["n"], r["v"]
    return Vocabulary(int(total[0] or 0), int(total[1]), own, np.array([r["count"] for r in top], dtype=np.float64), tokens, types)


def batch_documents(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """A row for each batch of documents of a worker: ids, token counts, the classes of all tokens in order
    (uint16), for those of shared classes the position of their word in the batch's words (uint32), and the
    words' hashes (uint64)."""
    ddl = "batch long, doc_id array<long>, n array<long>, classes binary, rare binary, words binary"
    schema = arrow_schema(ddl)
    own = vocabulary.own

    def run(batches):
        classes, serial = WordClasses(own), 0
        ids, counts, kinds, rare, words, size = [], [], [], [], {}, 0

        def packed():
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
            return rows_to_batch(schema, [[(TaskContext.get().partitionId() << 32) + serial], [ids], [counts], [b"".join(kinds)], [b"".join(rare)], [hashes.tobytes()]])

        for _, keys, texts in slices(batches, "doc_id", "text"):
            for key, text in zip(keys, texts, strict=True):
                tokens = words_of(text)
                if size and size + len(tokens) > BATCH_WORDS:
                    yield packed()
                    serial, size = serial + 1, 0
                    ids, counts, kinds, rare, words = [], [], [], [], {}
                found = np.fromiter(map(classes.__getitem__, tokens), np.uint16, len(tokens))
                shared = np.flatnonzero(found >= 1 + OWN_CLASSES)
                rare.append(np.fromiter((words.setdefault(tokens[i], len(words)) for i in shared), np.uint32, len(shared)).tobytes())
                kinds.append(found.tobytes() + b"\0\0")
                ids.append(key)
                counts.append(len(tokens) + 1)
                size += len(tokens) + 1
        if ids:
            yield packed()

    return map_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, ddl)


def window_layout(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut sequences of these lengths into windows: where each starts in the flat tokens and its length; longest first."""
    pieces = -(-lengths // most)
    begin = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
    owner = np.repeat(np.arange(len(lengths)), pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = begin[owner] + number * most
    size = np.minimum(most, lengths[owner] - number * most)
    order = np.argsort(-size, kind="stable")
    return start[order], size[order]


def expected_counts(classes: np.ndarray, lengths: np.ndarray, model: Parameters):
    """Expected starts, moves and emissions of whole sequences, by scaled forward and backward messages."""
    order = np.argsort(-lengths, kind="stable")
    start, size = (np.cumsum(lengths) - lengths)[order], lengths[order]
    first, move, emit = (x.astype(np.float32) for x in (model.start, model.move, model.emit))
    steps = int(size.max(initial=0))
    active = np.searchsorted(-size, -np.arange(1, steps + 1), side="right")
    alphas, scales, kinds = [], [], []
    alpha = np.repeat(first[None, :], len(start), axis=0)
    for t in range(steps):
        k = active[t]
        kind = classes[start[:k] + t]
        alpha = (alpha[:k] if t == 0 else alpha[:k] @ move) * emit[kind]
        scale = alpha.sum(1, keepdims=True)
        alpha = alpha / scale
        alphas.append(alpha)
        scales.append(scale)
        kinds.append(kind)
    moves = np.zeros((STATES, STATES))
    beta, back = np.ones((0, STATES), np.float32), np.ascontiguousarray(move.T)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        if len(beta) < k:
            beta = np.concatenate((beta, np.ones((k - len(beta), STATES), np.float32)))
        if t:
            weighted = beta * emit[kinds[t]] / scales[t]
            moves += alphas[t - 1][:k].T @ weighted
        alphas[t] = alphas[t] * beta
        if t:
            beta = weighted @ back
    starts = alphas[0].sum(0, dtype=np.float64) if steps else np.zeros(STATES)
    gamma, kind = np.concatenate(alphas) if steps else np.zeros((0, STATES)), np.concatenate(kinds) if steps else np.zeros(0, int)
    emits = np.stack([np.bincount(kind, weights=gamma[:, s], minlength=CLASSES) for s in range(STATES)], axis=1)
    return starts, moves * model.move, emits


def maximised(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, class_tokens: np.ndarray) -> Parameters:
    """Parameters from expected counts; emissions are smoothed towards the classes' shares of the corpus."""
    share = (class_tokens + 0.5) / (class_tokens + 0.5).sum()
    emit = emits + 50.0 * share[:, None]
    return Parameters((starts + 1) / (starts + 1).sum(), (moves + 1) / (moves + 1).sum(1, keepdims=True), emit / emit.sum(0))


def first_parameters(documents: list[np.ndarray], class_tokens: np.ndarray) -> Parameters:
    """Parameters from a few documents: each state begins as another document's classes, then Baum-Welch."""
    random = np.random.default_rng(7)
    share = (class_tokens + 0.5) / (class_tokens + 0.5).sum()
    emit = np.repeat(share[:, None], STATES, axis=1)
    long = sorted(range(len(documents)), key=lambda i: -len(documents[i]))[: max(STATES, len(documents) // 2)]
    for s in range(STATES):
        if long:
            own = np.bincount(documents[random.choice(long)], minlength=CLASSES)
            emit[:, s] = 0.5 * share + 0.5 * own / own.sum()
    model = Parameters(np.full(STATES, 1 / STATES), np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES), emit / emit.sum(0))
    if documents:
        flat, lengths = np.concatenate(documents), np.array([len(d) for d in documents])
        for _ in range(FIRST_PASSES):
            starts, moves, emits = expected_counts(flat, lengths, model)
            model = maximised(starts, moves, emits, class_tokens)
    return model


def log_likelihoods(classes: np.ndarray, lengths: np.ndarray, model: Parameters) -> np.ndarray:
    """log10 probability of each class sequence (all of length 1 at least), by the scaled forward recursion."""
    out = np.zeros(len(lengths))
    begin = np.cumsum(lengths) - lengths
    short = np.flatnonzero(lengths <= SHORT)
    order = short[np.argsort(-lengths[short], kind="stable")]
    alpha = np.repeat(model.start[None, :], len(order), axis=0)
    sizes = lengths[order]
    for t in range(int(sizes.max(initial=0))):
        k = int(np.searchsorted(-sizes, -(t + 1), side="right"))
        alpha = (alpha[:k] if t == 0 else alpha[:k] @ model.move) * model.emit[classes[begin[order[:k]] + t]]
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        out[order[:k]] += np.log10(scale)
    long = np.flatnonzero(lengths > SHORT)
    if len(long):
        # The first token apart, then segments of the rest, each as a matrix that is scaled on the way.
        start, size = window_layout(lengths[long] - 1, SEGMENT)
        pieces = -(-(lengths[long] - 1) // SEGMENT)
        inner = np.cumsum(lengths[long] - 1) - (lengths[long] - 1)
        owner = np.searchsorted(inner, start, side="right") - 1
        where = begin[long][owner] + 1 + (start - inner[owner])
        matrices, logs = np.repeat(np.eye(STATES)[None], len(start), axis=0), np.zeros(len(start))
        for t in range(SEGMENT):
            k = int(np.searchsorted(-size, -(t + 1), side="right"))
            if not k:
                break
            step = (matrices[:k].reshape(-1, STATES) @ model.move).reshape(k, STATES, STATES) * model.emit[classes[where[:k] + t]][:, None, :]
            scale = step.sum((1, 2))
            matrices[:k] = step / scale[:, None, None]
            logs[:k] += np.log10(scale)
        slot = np.empty(len(start), int)
        slot[np.lexsort((start, owner))] = np.arange(len(start))
        ordered, in_order = np.empty_like(matrices), np.empty_like(logs)
        ordered[slot], in_order[slot] = matrices, logs
        at = np.cumsum(pieces) - pieces
        alpha = model.start * model.emit[classes[begin[long]]]
        scale = alpha.sum(1)
        alpha, total = alpha / scale[:, None], np.log10(scale)
        for j in range(int(pieces.max())):
            on = np.flatnonzero(pieces > j)
            moved = np.einsum("ns,nsr->nr", alpha[on], ordered[at[on] + j])
            scale = moved.sum(1)
            alpha[on] = moved / scale[:, None]
            total[on] += np.log10(scale) + in_order[at[on] + j]
        out[long] = total
    return out


def in_training(ids: list) -> np.ndarray:
    import zlib

    return np.array([i is not None and zlib.crc32(str(i).encode()) % 5 != 1 for i in ids], dtype=bool)


def flattened(model: Parameters) -> list[float]:
    return np.concatenate((model.start, model.move.ravel(), model.emit.ravel())).tolist()


def unflattened(numbers: list[float]) -> Parameters:
    start, move, emit = np.split(np.array(numbers), np.cumsum([STATES, STATES * STATES]))
    return Parameters(start, move.reshape(STATES, STATES), emit.reshape(CLASSES, STATES))


def begin(documents: DataFrame, vocabulary: Vocabulary) -> Parameters:
    """First parameters from a bounded sample of whole training documents, fitted in one task."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(remainder(F.col("doc_id")) != 1)
    chosen = texts.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIRST_DOCUMENTS)
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    own, class_tokens, schema = vocabulary.own, vocabulary.class_tokens, arrow_schema("model array<double>")

    def run(batches):
        classes, found = WordClasses(own), {}
        for _, keys, some in slices(batches, "doc_id", "text"):
            for key, text in zip(keys, some, strict=True):
                found[key] = np.array([*map(classes.__getitem__, words_of(text)), 0], np.uint16)
        yield rows_to_batch(schema, [[flattened(first_parameters([found[key] for key in sorted(found)], class_tokens))]])

    best = map_batches(sample.repartition(1), run, "model array<double>").first()
    return unflattened(best["model"]) if best else first_parameters([], class_tokens)


def train(documents: DataFrame, batches: DataFrame, vocabulary: Vocabulary, passes: int = PASSES) -> Parameters:
    """Baum-Welch over all training documents; Spark sums the expected counts by class."""
    ddl = "kind int, " + ", ".join(f"s{i} double" for i in range(STATES))
    schema = arrow_schema(ddl)

    def documents_of(row_ids, row_n, row_classes):
        lengths = np.array(row_n, dtype=np.int64)
        mask = in_training(row_ids)
        flat = np.frombuffer(row_classes, np.uint16)
        return flat[np.repeat(mask, lengths)], lengths[mask]

    model = begin(documents, vocabulary)
    own = batches.select("doc_id", "n", "classes")
    for _ in range(passes):

        def run(rows, model=model):
            starts, moves, emits = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES))
            for _, ids, n, classes in slices(rows, "doc_id", "n", "classes"):
                for parts in zip(ids, n, classes, strict=True):
                    a, b, c = expected_counts(*documents_of(*parts), model)
                    starts, moves, emits = starts + a, moves + b, emits + c
            kinds = np.flatnonzero(emits.any(1))
            table = np.concatenate((emits[kinds], moves, starts[None]))
            # After the classes: a row for each state that is left, and one for starts.
            yield rows_to_batch(schema, [np.concatenate((kinds, CLASSES + np.arange(STATES + 1))).astype(np.int32), *(table[:, s] for s in range(STATES))])

        summed = np.zeros((CLASSES + STATES + 1, STATES))
        for r in map_batches(own, run, ddl).groupBy("kind").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(STATES))).collect():
            summed[r[0]] = r[1:]
        model = maximised(summed[-1], summed[CLASSES:-1], summed[:CLASSES], vocabulary.class_tokens)
    return model


def look_up(batches: DataFrame, counts: DataFrame, buckets: int) -> DataFrame:
    """(batch, found): for each batch the (bucket, training counts of its words in that bucket) of all buckets."""
    ddl = "bucket int, batch long, words binary"
    schema = arrow_schema(ddl)

    def ask(rows):
        for _, numbers, words in slices(rows, "batch", "words"):
            for number, raw in zip(numbers, words, strict=True):
                hashes = np.frombuffer(raw, np.uint64)
                bucket = (hashes % np.uint64(buckets)).astype(np.int32)
                for b in np.unique(bucket).tolist():
                    yield rows_to_batch(schema, [[b], [number], [hashes[bucket == b].tobytes()]])

    known_ddl = "bucket int, hash long, count long"
    known_schema = arrow_schema(known_ddl)

    def hashed(rows):
        for _, words, n in slices(rows, "word", "count"):
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
            yield rows_to_batch(known_schema, [(hashes % np.uint64(buckets)).astype(np.int32), hashes.view(np.int64), n])

    def answer(asked, known):
        import pandas as pd

        order = np.argsort(known["hash"].to_numpy())
        hashes, n = known["hash"].to_numpy()[order], known["count"].to_numpy()[order]
        out = []
        for raw in asked["words"]:
            wanted = np.frombuffer(raw, np.int64)
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
                found = np.where(hashes[at] == wanted, n[at], 0)
            else:
                found = np.zeros(len(wanted), np.int64)
            out.append(found.astype(np.int64).tobytes())
        return pd.DataFrame({"batch": asked["batch"], "bucket": asked["bucket"], "found": out})

    asked = map_batches(batches.select("batch", "words"), ask, ddl)
    known = map_batches(counts, hashed, known_ddl)
    answers = asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInPandas(answer, "batch long, bucket int, found binary")
    return answers.groupBy("batch").agg(F.collect_list(F.struct("bucket", "found")).alias("found"))


def score(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of documents.

    A null or empty text is the end alone. Rows with a null doc_id are scored, not learned from, and their
    held_out is null. Repeated rows count as often as they come. With no training row, N = V = 0: the base score
    is 0 and states emit all classes alike.
    """
    spark = documents.sparkSession
    ship(spark)
    work = Scratch(spark, "hmm")
    counts = work.write(count_words(documents))
    vocabulary = gather_vocabulary(counts)
    batches = work.write(batch_documents(documents, vocabulary))
    model = train(documents, batches, vocabulary)
    buckets = 1 + vocabulary.tokens // BUCKET_TOKENS
    total, types = vocabulary.tokens, vocabulary.types
    base_of = np.log10((np.concatenate(([vocabulary.class_tokens[0]], vocabulary.own_counts)) + 0.5) / (total + 0.5 * (types + 1)))
    within = -np.log10(vocabulary.class_tokens + 0.5 * (vocabulary.class_types + 1))
    ddl = "doc_id long, n_tokens long, n_known long, base_score double, score double"
    schema = arrow_schema(ddl)
    no_end = vocabulary.class_tokens[0] == 0

    def run(rows):
        for _, ids, n, kinds, rare, words, found in slices(rows, "doc_id", "n", "classes", "rare", "words", "found"):
            for parts in zip(ids, n, kinds, rare, words, found, strict=True):
                keys, lengths = parts[0], np.array(parts[1], dtype=np.int64)
                classes, position, hashes = np.frombuffer(parts[2], np.uint16), np.frombuffer(parts[3], np.uint32), np.frombuffer(parts[4], np.uint64)
                count = np.zeros(len(hashes), np.int64)
                bucket = (hashes % np.uint64(buckets)).astype(np.int32)
                for answer in parts[5] or []:
                    count[bucket == answer["bucket"]] = np.frombuffer(answer["found"], np.int64)
                shared = classes > OWN_CLASSES
                base, part, known = np.empty(len(classes)), np.zeros(len(classes)), np.ones(len(classes), bool)
                base[~shared] = base_of[classes[~shared]]
                c = count[position]
                base[shared] = np.log10((c + 0.5) / (total + 0.5 * (types + 1)))
                part[shared] = np.log10(c + 0.5) + within[classes[shared]]
                known[shared] = c > 0
                if no_end:
                    known[classes == 0] = False
                begin = np.cumsum(lengths) - lengths
                likely = log_likelihoods(classes, lengths, model) + np.add.reduceat(part, begin)
                yield rows_to_batch(schema, [keys, lengths, np.add.reduceat(known.astype(np.int64), begin), np.add.reduceat(base, begin), likely])

    joined = batches.join(look_up(batches, counts, buckets), "batch", "left").select("doc_id", "n", "classes", "rare", "words", "found")
    scored = map_batches(joined, run, ddl)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
