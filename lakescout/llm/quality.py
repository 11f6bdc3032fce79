"""Document quality by regularised quadratic discriminant analysis over document statistics.

Each class has a mean and a covariance of transformed statistics; covariances are shrunk towards the pooled one
and that towards its diagonal. The score is the posterior from the difference of the two Mahalanobis log
densities, computed with cached Cholesky factors and calibrated on the training rows by one slope and offset.
Models are fitted on a bounded sample of labelled rows, chosen by a hash of the id; every row is scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescout.llm.common import arrow_schema, map_batches, remainder, rows_to_batch, slices

#: Labelled rows that a model is fitted on at most.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3

GROUPS = {
    "lower": list(range(97, 123)) + list(range(128, 256)),
    "upper": list(range(65, 91)),
    "digit": list(range(48, 58)),
    "blank": [32, 9],
    "line": [10, 13],
    "stop": [46, 63],
    "comma": [44, 59, 58],
    "shout": [33],
    "bar": [124],
    "mark": [35, 36, 37, 38, 42],
    "other": [i for i in range(33, 127) if chr(i) in "\"'()+-/<=>@[\\]^_`{}~"],
}
MEMBER = np.zeros((256, len(GROUPS)))
for _at, _bytes in enumerate(GROUPS.values()):
    MEMBER[_bytes, _at] = 1
N_STATISTICS = len(GROUPS) + 9


def statistics(text: str | None) -> np.ndarray:
    """Transformed statistics of one whole text (null: empty): logit-like shares of kinds of bytes, lengths of
    words and lines, and how much repeats."""
    raw = (text or "").encode()
    size = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ MEMBER
    words, lines = raw.split(), raw.split(b"\n")
    n_words, n_lines = len(words), len(lines)
    distinct = len(set(words))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    capital = sum(map(bytes.isupper, words))
    rare = [distinct / (n_words + 1), np.log1p(distinct) / np.log(n_words + 2)]
    out = np.empty(N_STATISTICS)
    out[: len(GROUPS)] = np.log((counts + 0.5) / (size + 1))
    out[len(GROUPS) :] = [
        np.log1p(size),
        np.log((size + 1) / (n_words + 1)),
        np.log((n_words + 1) / n_lines),
        *rare,
        np.log((same + 0.5) / (n_words + 1)),
        np.log((capital + 0.5) / (n_words + 1)),
        np.log(len(set(lines)) / n_lines),
        np.log((counts[5] + 1) / (n_words + 1)),
    ]
    return out


@dataclass
class Discriminant:
    """Two Gaussian classes with cached Cholesky factors, and the calibration of their log-density difference."""

    means: np.ndarray
    inverse: np.ndarray
    log_det: np.ndarray
    slope: float
    offset: float

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 less that of class 0."""
        density = []
        for mean, inverse, log_det in zip(self.means, self.inverse, self.log_det, strict=True):
            z = (x - mean) @ inverse.T
            density.append(-0.5 * (z * z).sum(1) - log_det)
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * squash(self.difference(x)) + self.offset)


def squash(x: np.ndarray) -> np.ndarray:
    """Far tails of a Gaussian say little; a signed logarithm keeps order and tames them."""
    return np.sign(x) * np.log1p(np.abs(x))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of a logistic curve, by damped Newton steps with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * x + b)
        w = p * (1 - p) + 1e-6
        g = np.array([((p - y) * x).sum() + 1e-3 * a, (p - y).sum() + 1e-3 * b])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 0.0), float(b)


def fit(x: np.ndarray, y: np.ndarray, shrink: float = 0.3, to_diagonal: float = 0.1) -> Discriminant:
    """Fit both classes. A class with fewer rows is shrunk more: by ``shrink`` and as if it had rows of the pool.
    With no rows of a class, every score is the (smoothed) share of the other."""
    n = N_STATISTICS if not len(x) else x.shape[1]
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Discriminant(np.zeros((2, n)), np.stack([np.eye(n)] * 2), np.zeros(2), 0.0, float(np.log(share / (1 - share))))
    means, scatter, counts = [], [], []
    for label in (0, 1):
        own = x[y == label]
        means.append(own.mean(0))
        scatter.append((own - means[-1]).T @ (own - means[-1]))
        counts.append(len(own))
    pooled = sum(scatter) / max(1, sum(counts) - 2)
    pooled = (1 - to_diagonal) * pooled + to_diagonal * np.diag(np.diag(pooled)) + 1e-4 * np.eye(n)
    inverse, log_det = [], []
    for own, count in zip(scatter, counts, strict=True):
        weight = max(shrink, n / (n + count))
        covariance = (1 - weight) * own / max(1, count - 1) + weight * pooled
        factor = np.linalg.cholesky(covariance)
        inverse.append(np.linalg.inv(factor))
        log_det.append(np.log(np.diag(factor)).sum())
    model = Discriminant(np.array(means), np.array(inverse), np.array(log_det), 1.0, 0.0)
    model.slope, model.offset = calibrate(squash(model.difference(x)), y.astype(float))
    return model


def training_rows(documents: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled texts that aren't held out, those whose ids have the smallest hashes. A doc_id
    with several labels counts once, with the largest; null labels and ids don't count. Repeated ids give a row each."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & (remainder(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("label").alias("label"))
    # TakeOrderedAndProject keeps the sample's ids; this bound makes the side of the join small.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")


def fit_on(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Discriminant:
    """Fit on the training rows. Workers compute the statistics, one task fits on the bounded sample, and the driver
    gets the parameters alone."""
    ddl = "doc_id long, label int, x array<double>"
    schema = arrow_schema(ddl)

    def describe(batches):
        for _, keys, marks, texts in slices(batches, "doc_id", "label", "text"):
            yield rows_to_batch(schema, [keys, marks, [statistics(t).tolist() for t in texts]])

    def learn(batches):
        found = sorted((row for _, *columns in slices(batches, "doc_id", "label", "x") for row in zip(*columns, strict=True)), key=lambda row: row[0])
        yield rows_to_batch(arrow_schema("model array<double>"), [[flattened(fit_rows(found))]])

    sample = map_batches(training_rows(documents, labels, "quality", rows).select("doc_id", "label", "text"), describe, ddl).groupBy("doc_id").agg(F.min("label").alias("label"), F.min("x").alias("x"))
    best = map_batches(sample.repartition(1), learn, "model array<double>").first()
    return unflattened(np.array(best["model"])) if best else fit_rows([])


def fit_rows(found: list) -> Discriminant:
    x = np.array([r[2] for r in found]) if found else np.zeros((0, N_STATISTICS))
    return fit(x, np.array([r[1] for r in found], dtype=int))


def flattened(model: Discriminant) -> list[float]:
    return np.concatenate((model.means.ravel(), model.inverse.ravel(), model.log_det, [model.slope, model.offset])).tolist()


def unflattened(numbers: np.ndarray) -> Discriminant:
    n = N_STATISTICS
    means, inverse, log_det, (slope, offset) = np.split(numbers, np.cumsum([2 * n, 2 * n * n, 2]))
    return Discriminant(means.reshape(2, n), inverse.reshape(2, n, n), log_det, float(slope), float(offset))


def score_documents(documents: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of documents: empty and null texts are scored as
    empty ones, repeated rows alike; held_out is null for a null doc_id."""
    ddl = "doc_id long, score double"
    schema = arrow_schema(ddl)

    def run(batches):
        for _, keys, texts in slices(batches, "doc_id", "text"):
            yield rows_to_batch(schema, [keys, model.score(np.array([statistics(t) for t in texts])) if texts else []])

    scored = map_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, ddl)
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_documents(documents: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents, with all their columns, whose score reaches the threshold; texts are read once."""
    schema = documents.schema

    def run(batches):
        for part, texts in slices(batches, "text"):
            if texts:
                yield part.filter(pa_mask(model.score(np.array([statistics(t) for t in texts])) >= threshold))

    return map_batches(documents, run, schema)


def pa_mask(keep: np.ndarray):
    import pyarrow as pa

    return pa.array(keep.tolist(), type=pa.bool_())
