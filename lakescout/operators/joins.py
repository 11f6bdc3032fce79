"""Joins that assemble views: keys compare as lower-case strings, right-hand duplicates get a suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakescout.functions.text import key_of

NO_KEYS = ["nan", "null", ""]


def join_on(a: DataFrame, b: DataFrame, a_key: str, b_key: str, suffix: str = "_x", drop_null_keys: bool = False) -> DataFrame:
    """Inner join; a key of the same name is kept once."""
    names = {c: c + suffix if c in a.columns and not (c == b_key and a_key == b_key) else c for c in b.columns}
    right = b.select(key_of(F.col(f"`{b_key}`")).alias("_k"), *(F.col(f"`{c}`").alias(n) for c, n in names.items() if not (c == b_key and a_key == b_key)))
    left = a.withColumn("_k", key_of(F.col(f"`{a_key}`")))
    if drop_null_keys:
        left, right = left.where(~F.col("_k").isin(NO_KEYS)), right.where(~F.col("_k").isin(NO_KEYS))
    return left.join(right, "_k").drop("_k")


def cell_filter(df: DataFrame, cells: dict[str, str]) -> DataFrame:
    """Rows that agree with all cells, trimmed and in lower case."""
    for c, value in cells.items():
        df = df.where(F.trim(key_of(F.col(f"`{c}`"))) == value.strip().lower())
    return df


def keys_of(df: DataFrame, key: str, attribute: str, value: str) -> DataFrame:
    return cell_filter(df, {attribute: value}).select(key)


def consistent_sample_join(a: DataFrame, b: DataFrame, a_key: str, b_key: str, n: int, suffix: str = "_x") -> DataFrame:
    """Join of the first row of each of the n last keys (as strings) of the side with more distinct keys."""
    ka, kb = a.select(key_of(F.col(a_key)).alias("k")).distinct(), b.select(key_of(F.col(b_key)).alias("k")).distinct()
    side = ka if ka.count() > kb.count() else kb
    # At most n keys.
    sample = F.broadcast(side.where("k is not null").orderBy(F.desc("k")).limit(n))

    def firsts(df, key):
        order = Window.partitionBy("_k").orderBy(*(F.col(f"`{c}`") for c in df.columns))
        kept = df.withColumn("_k", key_of(F.col(key))).join(sample.toDF("_k"), "_k", "left_semi")
        return kept.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_k")

    return join_on(firsts(a, a_key), firsts(b, b_key), a_key, b_key, suffix)


def fold(tables: dict[str, DataFrame], hops: list[tuple[str, str, str, str]]) -> DataFrame:
    """Left-deep chain of joins along hops (table, column, table, column) of a tree whose root is the first table."""
    out, seen, suffix = tables[hops[0][0]], {hops[0][0]}, ""
    for a, ca, b, cb in hops:
        if b in seen and a not in seen:
            a, ca, b, cb = b, cb, a, ca
        suffix += "_x"
        out = join_on(out, tables[b], ca, cb, suffix)
        seen.add(b)
    return out


def has_rows(df: DataFrame) -> bool:
    return not df.isEmpty()

#: Bytes of a value in an estimate: texts count as a reference to them.
VALUE_BYTES = 8


def join_estimate(a: DataFrame, b: DataFrame, limit_bytes: int) -> DataFrame:
    """(row_bytes, cartesian_rows, cartesian_bytes, fits): the size of a joined row and the most that a join can give."""
    width = VALUE_BYTES * (len(a.columns) + len(b.columns))
    rows = a.agg(F.count(F.lit(1)).alias("na")).join(F.broadcast(b.agg(F.count(F.lit(1)).alias("nb"))), F.lit(True))
    n = F.col("na") * F.col("nb")
    return rows.select(F.lit(width).cast("long").alias("row_bytes"), n.alias("cartesian_rows"), (n * width).alias("cartesian_bytes"), (n * width <= limit_bytes).alias("fits"))


def attributes_to_project(filters: list[tuple[str, str]], available: list[str]) -> list[str]:
    """The filters' attributes that a view has, in their order, once each; ``filters`` are (attribute, cell)."""
    return [c for c in dict.fromkeys(a for a, _ in filters) if c in available]
