"""Column profiles: one aggregation for each table, then one row for each of its columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakescout.functions import minhash as M

NUMBER = (T.NumericType, T.BooleanType)


def column_types(df: DataFrame, skip: tuple = ()) -> dict[str, str]:
    """'N' or 'T' by column; arrays, maps and structs aren't profiled."""
    return {f.name: "N" if isinstance(f.dataType, NUMBER) else "T" for f in df.schema.fields if f.name not in skip and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))}


STATISTICS = ("min_value", "max_value", "avg_value", "median", "iqr")


def estimated(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Statistics of all columns from one aggregation, with sketches."""
    aggregates = []
    for i, (c, kind) in enumerate(types.items()):
        col = F.col(f"`{c}`")
        aggregates += [F.count(col).alias(f"n{i}"), F.approx_count_distinct(col, 0.01).alias(f"u{i}")]
        if kind == "N":
            x = col.cast("double")
            finite = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
            aggregates += [F.min(finite).alias(f"lo{i}"), F.max(finite).alias(f"hi{i}"), (F.sum(F.round(finite, 4).cast("decimal(28,4)")).cast("double") / F.count(finite)).alias(f"av{i}"), F.percentile_approx(finite, [0.25, 0.5, 0.75], 10_000).alias(f"q{i}")]
        else:
            aggregates += [F.lit(None).cast("double").alias(f"{x}{i}") for x in ("lo", "hi", "av")] + [F.lit(None).cast("array<double>").alias(f"q{i}")]
    rows = F.array(*(F.struct(F.lit(i).alias("i"), *(F.col(f"{x}{i}").alias(x) for x in ("n", "u", "lo", "hi", "av", "q"))) for i in range(len(types))))
    return df.agg(*aggregates).select(F.inline(rows))


def counted(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """The same exactly. Each column's values are counted first, wherever they lie, so that a value is one row for what
    follows and no row is expanded once for each distinct count."""

    def cells(kind: str, *of) -> DataFrame:
        found = [F.struct(F.lit(i).alias("i"), *(f(c).alias(n) for n, f in of)) for i, (c, k) in enumerate(types.items()) if k == kind]
        return df.select(F.inline(F.array(*found))).where("x is not null").groupBy("i", *(n for n, _ in of)).agg(F.count(F.lit(1)).alias("c")) if found else None

    def number(c: str):
        return F.col(f"`{c}`").cast("double") + F.lit(0.0)

    def rest(c: str):
        # What a double of 53 bits doesn't hold of a value.
        kind = df.schema[c].dataType
        return F.xxhash64(F.col(f"`{c}`")) if isinstance(kind, (T.LongType, T.DecimalType)) else F.lit(0).cast("long")

    parts = []
    numbers = cells("N", ("x", number), ("rest", rest))
    if numbers is not None:
        finite = F.when(~F.isnan("x") & (F.abs("x") != float("inf")), F.col("x"))
        total = F.sum(F.round(finite, 4).cast("decimal(28,4)") * F.col("c").cast("decimal(10,0)")).cast("double") / F.sum(F.when(finite.isNotNull(), F.col("c")))
        quantiles = F.call_function("percentile", finite, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("c"))
        parts.append(numbers.groupBy("i").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("u"), F.min(finite).alias("lo"), F.max(finite).alias("hi"), total.alias("av"), quantiles.alias("q")))
    texts = cells("T", ("x", lambda c: F.col(f"`{c}`").cast("string")))
    if texts is not None:
        parts.append(texts.groupBy("i").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("u")).select("i", "n", "u", *(F.lit(None).cast("double").alias(x) for x in ("lo", "hi", "av")), F.lit(None).cast("array<double>").alias("q")))
    return union_all(parts)


def profile_table(df: DataFrame, source_name: str, db_name: str = "lake", path: str = "", exact: bool = False, columns: list[str] | None = None) -> DataFrame:
    """The profile rows of a table's columns.

    All columns are aggregated in one pass with partial aggregation. Distinct counts are HyperLogLog++ estimates and
    quantiles are approximate, unless ``exact`` asks for both in full. Non-finite numbers count as values but not in
    the statistics, which are 0 if no finite value is there.
    """
    types = {c: t for c, t in column_types(df).items() if columns is None or c in columns}
    named = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("column_name"), F.lit(kind).alias("data_type")) for i, (c, kind) in enumerate(types.items())))
    # A row for each column, empty ones as well.
    every = df.sparkSession.range(1).select(F.inline(named))
    found = every.join(F.broadcast((counted if exact else estimated)(df, types)), "i", "left")
    numbers = [F.col("lo"), F.col("hi"), F.col("av"), F.col("q")[1], F.col("q")[2] - F.col("q")[0]]
    statistics = [F.coalesce(x, F.lit(0.0)).alias(n) for x, n in zip(numbers, STATISTICS, strict=True)]
    counts = [F.coalesce(F.col(x), F.lit(0).cast("long")).alias(n) for x, n in (("n", "total_values"), ("u", "unique_values"))]
    return found.select(F.concat(F.lit(f"{source_name}."), "column_name").alias("nid"), F.lit(db_name).alias("db_name"), F.lit(path).alias("path"), F.lit(source_name).alias("source_name"), "column_name", "data_type", *counts, F.lit("").alias("entities"), *statistics)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def text_cells(df: DataFrame, source_name: str, columns: list[str]) -> DataFrame:
    """(nid, value): the non-null values of text columns as strings."""
    picked = df.select(*(F.col(f"`{c}`").cast("string").alias(f"{source_name}.{c}") for c in columns))
    return picked.unpivot([], [F.col(f"`{source_name}.{c}`") for c in columns], "nid", "value").where("value is not null")


def minhash_of_cells(cells: DataFrame, permutations: int) -> DataFrame:
    """(nid, minhash) over the tokens of distinct values."""
    tokens = cells.distinct().select("nid", F.explode(M.value_tokens(F.col("value"))).alias("token"))
    return M.signatures(tokens, "nid", "token", permutations)


def text_index(cells: DataFrame) -> DataFrame:
    """(nid, text): the distinct values of a column in order, joined by spaces."""
    return cells.distinct().groupBy("nid").agg(F.concat_ws(" ", F.array_sort(F.collect_list("value"))).alias("text"))


def type_votes(cells: DataFrame) -> DataFrame:
    """(nid, inferred): INT, FLOAT or STRING by what all values but '' and 'nan' look like."""
    v = F.col("value")
    counted = ~v.isin("", "nan")
    whole, number = v.rlike(r"^(\+|-)?\d+$"), v.rlike(r"^(\+|-)?\d+([\,]\d+)*([\.]\d+)?$")
    votes = cells.groupBy("nid").agg(F.count_if(counted).alias("n"), F.count_if(counted & ~number).alias("other"), F.count_if(counted & number & ~whole).alias("fractions"))
    return votes.select("nid", F.when((F.col("n") == 0) | (F.col("other") > 0), "STRING").when(F.col("fractions") > 0, "FLOAT").otherwise("INT").alias("inferred"))


def parsed_numbers(value):
    """Strings with thousands separators as doubles; null where they aren't numbers."""
    plain = F.regexp_replace(value, ",", "")
    return F.when(value.rlike(r"^(\+|-)?\d+([\,]\d+)*([\.]\d+)?$"), plain.try_cast("double"))


def signature_terms(cells: DataFrame, least: int = 3) -> DataFrame:
    """(nid, term, n): words of more than 3 letters without digits that come more than ``least`` times in a column."""
    found = cells.select("nid", F.explode(F.split(F.lower("value"), r"[^\p{L}\p{N}]+")).alias("term"))
    kept = found.where((F.length("term") > 3) & ~F.col("term").rlike("[0-9]"))
    return kept.groupBy("nid", "term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)


def one_permutation(cells: DataFrame, key: str, bins: int) -> DataFrame:
    """(nid, bin, least): the least hash in each bin of one permutation."""
    tokens = cells.distinct().select(key, F.explode(M.value_tokens(F.col("value"))).alias("token"))
    h = M.base_hash(F.col("token"))
    return tokens.select(key, (h % bins).alias("bin"), h.alias("h")).groupBy(key, "bin").agg(F.min("h").alias("least"))


def nodes_of(profile: DataFrame) -> DataFrame:
    """One node for each column; its cardinality is the share of distinct values."""
    share = F.when(F.col("total_values") > 0, F.col("unique_values") / F.col("total_values")).otherwise(F.lit(0.0))
    return profile.select("nid", "db_name", "source_name", F.col("column_name").alias("field_name"), "data_type", share.alias("cardinality"))


def latest_by_nid(profile: DataFrame, version: str) -> DataFrame:
    """Last writer wins: of several rows of a nid, the one with the largest version."""
    return profile.groupBy("nid").agg(F.max_by(F.struct(*profile.columns), version).alias("p")).select("p.*")


def describe(df: DataFrame) -> DataFrame:
    """(column_name, n, mean, std, least, q25, q50, q75, largest) of the numeric columns; quartiles are approximate."""
    numbers = [f.name for f in df.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")]
    cells = df.select(*(F.col(f"`{c}`").cast("double").alias(c) for c in numbers)).unpivot([], [F.col(f"`{c}`") for c in numbers], "column_name", "v")
    quartiles = F.percentile_approx("v", [0.25, 0.5, 0.75])
    out = cells.groupBy("column_name").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev("v").alias("std"), F.min("v").alias("least"), quartiles.alias("q"), F.max("v").alias("largest"))
    return out.select("column_name", "n", "mean", "std", "least", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "largest")
