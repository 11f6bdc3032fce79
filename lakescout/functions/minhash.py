"""MinHash signatures that any engine with md5 and 64-bit integers reproduces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = 2_147_483_647


def coefficients(count: int) -> list[tuple[int, int]]:
    """Multipliers and offsets below 2^31 from a linear congruential generator."""
    state, out = 12345, []
    for _ in range(count):
        pair = []
        for _ in range(2):
            state = (1103515245 * state + 12345) % (1 << 31)
            pair.append(1 + state % (PRIME - 1))
        out.append((pair[0], pair[1]))
    return out


def base_hash(token: Column) -> Column:
    """The first 32 bits of md5."""
    return F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("bigint")


def value_tokens(value: Column) -> Column:
    return F.filter(F.split(F.lower(value), r"[\s_\-]+"), lambda t: t != "")


def signatures(tokens: DataFrame, key: str, token: str, count: int) -> DataFrame:
    """(key, minhash): one aggregation with a minimum for each permutation, which Spark combines before it shuffles."""
    hashed = tokens.select(key, (base_hash(F.col(token)) % PRIME).alias("_h"))
    minima = [F.min((F.lit(a) * F.col("_h") + b) % PRIME).alias(f"_m{i}") for i, (a, b) in enumerate(coefficients(count))]
    return hashed.groupBy(key).agg(*minima).select(key, F.array(*(f"_m{i}" for i in range(count))).alias("minhash"))


def estimated_jaccard(a: Column, b: Column) -> Column:
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / F.size(a)
