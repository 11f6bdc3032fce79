"""Vector search by distance, with hash buckets as an option. Distances are column expressions."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def manhattan_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


DISTANCES = {"cosine": cosine_distance, "euclidean": euclidean_distance, "manhattan": manhattan_distance}


def measured(queries: DataFrame, data: DataFrame, distance: str) -> DataFrame:
    """(query_id, vec_id, distance) of a stated, small set of queries against all rows; the queries travel."""
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_q"))
    return data.join(F.broadcast(q), F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", F.round(DISTANCES[distance](F.col("_q"), F.col("embedding")), 6).alias("distance"))


def nearest(distances: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return distances.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def within(distances: DataFrame, limit: float) -> DataFrame:
    return distances.where(F.col("distance") < limit)


def hyperplanes(width: int, count: int, seed: int = 1) -> list[list[float]]:
    rng = random.Random(seed)
    return [[rng.choice((-1.0, 1.0)) for _ in range(width)] for _ in range(count)]


def sign_key(vector: Column, planes: list[list[float]]) -> Column:
    """One character for the side of each hyperplane."""
    return F.concat(*(F.when(dot(vector, F.array(*map(F.lit, p))) > 0, "1").otherwise("0") for p in planes))


def step_key(vector: Column, planes: list[list[float]], width: float) -> Column:
    return F.concat_ws("_", *(F.floor(dot(vector, F.array(*map(F.lit, p))) / width) for p in planes))


def principal_planes(data: DataFrame, count: int) -> list[list[float]]:
    """The first principal components of all vectors, whose largest entry is positive, as planes for keys. Sums of
    products are combined in the tasks; the driver gets one square matrix of the vectors' width."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    fitted = PCA(k=count, inputCol="v", outputCol="o").fit(data.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v")))
    planes = fitted.pc.toArray().T.tolist()
    return [p if max(p, key=abs) > 0 else [-x for x in p] for p in planes]


def buckets(data: DataFrame, planes: list[list[float]]) -> DataFrame:
    return data.select("vec_id", sign_key(F.col("embedding"), planes).alias("bucket"))


def longest_prefix(keys: DataFrame, queries: DataFrame, least: int) -> DataFrame:
    """(query_id, prefix, n): the longest prefix of a query's key that at least so many rows share."""
    length = F.length("bucket")
    prefixes = keys.select(F.explode(F.transform(F.sequence(F.lit(0), length), lambda i: F.substring("bucket", 1, i))).alias("prefix")).groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    own = queries.select(F.col("vec_id").alias("query_id"), F.explode(F.transform(F.sequence(F.lit(0), length), lambda i: F.substring("bucket", 1, i))).alias("prefix"))
    met = own.join(prefixes, "prefix")
    return met.groupBy("query_id").agg(F.max_by(F.struct("prefix", "n"), F.length("prefix")).alias("b")).select("query_id", "b.prefix", "b.n")


def hamming_nearest(keys: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("bucket").alias("_q"))
    differ = _sum(F.zip_with(F.split("_q", ""), F.split("bucket", ""), lambda x, y: (x != y).cast("double")))
    return nearest(keys.join(F.broadcast(q), F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", differ.cast("int").alias("distance")), n)


def recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """(recall, precision) of found (query_id, vec_id) pairs."""
    hits = exact.select("query_id", "vec_id").join(approximate.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").agg(F.count(F.lit(1)).alias("hit"))
    counts = exact.agg(F.count(F.lit(1)).alias("e")).join(approximate.agg(F.count(F.lit(1)).alias("a")), F.lit(True))
    return hits.join(counts, F.lit(True)).select((F.col("hit") / F.col("e")).alias("recall"), (F.col("hit") / F.col("a")).alias("precision"))
