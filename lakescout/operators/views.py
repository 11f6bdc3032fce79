"""Classes of views: equivalent, contained, complementary and contradictory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def uniqueness(df: DataFrame) -> DataFrame:
    """(column_name, uniqueness): distinct values per row; a null counts as a value. One pass over the view."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *((F.count_distinct(F.col(f"`{c}`")) + F.max(F.col(f"`{c}`").isNull().cast("int"))).alias(f"u{i}") for i, c in enumerate(df.columns)))
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), (F.col(f"u{i}") / F.col("n")).alias("uniqueness")) for i, c in enumerate(df.columns)))
    return row.select(F.explode(pairs).alias("p")).select("p.*")


def most_likely_key(df: DataFrame) -> DataFrame:
    return uniqueness(df).orderBy(F.desc("uniqueness"), "column_name").limit(1)


def curated(df: DataFrame) -> DataFrame:
    """Whole rows once each, columns in the order of their names."""
    return df.dropna().distinct().select(*sorted(df.columns))


def column_values(df: DataFrame) -> DataFrame:
    """(column_name, value, n) of lower-case values."""
    cast = df.select(*(F.lower(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns))
    return cast.unpivot([], [F.col(f"`{c}`") for c in df.columns], "column_name", "value").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def equivalent(a: DataFrame, b: DataFrame) -> DataFrame:
    """(equivalent, view_class) of two views, by rows, columns and each column's values."""
    if sorted(a.columns) != sorted(b.columns):
        return a.sparkSession.createDataFrame([(False, "DIF_SCHEMA")], "equivalent boolean, view_class string")
    x, y = column_values(a), column_values(b)
    diff = x.withColumn("s", F.lit(1)).union(y.withColumn("s", F.lit(-1))).groupBy("column_name", "value").agg(F.sum(F.col("n") * F.col("s")).alias("d"), F.sum(F.col("n") * F.col("s")).alias("rows"))
    by_column = diff.groupBy("column_name").agg(F.sum("d").alias("rows"), F.count_if(F.col("d") != 0).alias("values"))
    out = by_column.agg(F.max(F.abs("rows")).alias("rows"), F.sum("values").alias("values"))
    kind = F.when(F.col("rows") != 0, "DIF_CARDINALITY").when(F.col("values") > 0, "DIF_VALUES").otherwise("EQUIVALENT")
    return out.select((kind == "EQUIVALENT").alias("equivalent"), kind.alias("view_class"))


def missing_values(a: DataFrame, b: DataFrame) -> DataFrame:
    """(column_name, missing): how many distinct values of a's columns b lacks; contained where all are 0."""
    x, y = column_values(a).select("column_name", "value"), column_values(b).select("column_name", "value")
    lost = x.join(y, (x["column_name"] == y["column_name"]) & x["value"].eqNullSafe(y["value"]), "left_anti").groupBy("column_name").agg(F.count(F.lit(1)).alias("missing"))
    return x.select("column_name").distinct().join(lost, "column_name", "left").select("column_name", F.coalesce("missing", F.lit(0)).cast("bigint").alias("missing"))


def complementary_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of one view only."""
    x, y = a.select(F.col(key).alias("key")).distinct(), b.select(F.col(key).alias("key")).distinct()
    return x.join(y, "key", "left_anti").withColumn("side", F.lit("left")).union(y.join(x, "key", "left_anti").withColumn("side", F.lit("right")))


def row_digest(df: DataFrame, columns: list[str]):
    return F.md5(F.concat_ws("\x01", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x02")) for c in sorted(columns))).cast("binary"))


def key_groups(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, digest): a digest of the set of rows of each key, by sums that Spark combines before it shuffles."""
    part = F.conv(F.substring(row_digest(df, columns), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.select(*columns).distinct().groupBy(F.col(key).alias("key")).agg(F.concat_ws("|", F.count(F.lit(1)), F.sum(part)).alias("digest"))


def contradictory_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key): shared keys whose rows differ."""
    columns = sorted(set(a.columns) & set(b.columns))
    return key_groups(a, key, columns).join(key_groups(b, key, columns).toDF("key", "other"), "key").where("digest <> other").select("key")


def inconsistencies(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(kind, n): missing keys, keys that aren't unique, and conflicting values of shared keys."""
    columns = [c for c in a.columns if c in b.columns and c != key]
    ka, kb = a.groupBy(key).agg(F.count(F.lit(1)).alias("n")), b.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    missing = complementary_keys(a, b, key).agg(F.count(F.lit(1)).alias("n")).select(F.lit("missing").alias("kind"), "n")
    repeated = ka.where("n > 1").select(key).union(kb.where("n > 1").select(key)).distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit("not_unique"), "n")
    right = b.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in columns))
    differ = reduce(lambda x, y: x + y, [(~F.col(c).eqNullSafe(F.col(f"_{c}"))).cast("int") for c in columns])
    conflicts = a.join(right, key).agg(F.coalesce(F.sum(differ), F.lit(0)).alias("n")).select(F.lit("conflict"), F.col("n").cast("bigint"))
    return missing.union(repeated).union(conflicts)


def tagged_rows(views: dict[str, DataFrame], lower: bool = False) -> DataFrame:
    """(view_id, row_hash) of views with the same columns."""
    out = None
    for name, df in views.items():
        columns = sorted(df.columns)
        cast = df.select(*(F.lower(F.col(c).cast("string")).alias(c) for c in columns)) if lower else df
        rows = cast.select(F.lit(name).alias("view_id"), row_digest(cast, columns).alias("row_hash"))
        out = rows if out is None else out.union(rows)
    return out


def view_signatures(rows: DataFrame) -> DataFrame:
    """(view_id, n_rows, signature): equal for views with equal rows in any order."""
    part = F.conv(F.substring("row_hash", 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy("view_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(part).cast("string").alias("signature"))


def compatible(rows: DataFrame) -> DataFrame:
    """(view_id, representative): views with equal rows, by the first of each group."""
    s = view_signatures(rows)
    groups = s.groupBy("n_rows", "signature").agg(F.min("view_id").alias("representative"))
    return s.join(groups, ["n_rows", "signature"]).select("view_id", "representative")


def containment(rows: DataFrame) -> DataFrame:
    """(a, b, shared, only_a, only_b) of all pairs of views that share a row."""
    distinct = rows.distinct()
    sizes = distinct.groupBy("view_id").agg(F.count(F.lit(1)).alias("n"))
    shared = distinct.toDF("a", "row_hash").join(distinct.toDF("b", "row_hash"), "row_hash").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    out = shared.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    return out.select("a", "b", "shared", (F.col("na") - F.col("shared")).alias("only_a"), (F.col("nb") - F.col("shared")).alias("only_b"))


def schema_groups(views: dict[str, DataFrame]) -> dict[tuple[str, ...], list[str]]:
    """Names of views by the set of their column names."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for name, df in views.items():
        groups.setdefault(tuple(sorted(df.columns)), []).append(name)
    return groups


def key_of_pair(a: DataFrame, b: DataFrame) -> str:
    """One key for both views: of their most likely keys the one that comes last by name."""
    return max(most_likely_key(df).first()["column_name"] for df in (a, b))


def group_relations(views: dict[str, DataFrame], key: str) -> DataFrame:
    """(a, b, contradictory, only_a, only_b, relation) of all pairs a < b of views with the same columns, in one job.

    A key contradicts where its rows differ. Without such keys the views have equal keys ('compatible'), one holds the
    other ('contained'), or each has keys of its own ('complementary').
    """
    per = None
    for name, df in views.items():
        rows = key_groups(df, key, sorted(df.columns)).select(F.lit(name).alias("view"), "key", "digest")
        per = rows if per is None else per.union(rows)
    sizes = per.groupBy("view").agg(F.count(F.lit(1)).alias("n"))
    met = per.toDF("a", "key", "x").join(per.toDF("b", "key2", "y"), F.col("key").eqNullSafe(F.col("key2"))).where("a < b")
    shared = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.count_if(F.col("x") != F.col("y")).alias("contradictory"))
    names = sorted(views)
    pairs = per.sparkSession.createDataFrame([(x, y) for i, x in enumerate(names) for y in names[i + 1 :]], "a string, b string")
    out = pairs.join(shared, ["a", "b"], "left").join(sizes.toDF("a", "na"), "a", "left").join(sizes.toDF("b", "nb"), "b", "left").na.fill(0, ["shared", "contradictory", "na", "nb"])
    out = out.select("a", "b", "contradictory", (F.col("na") - F.col("shared")).alias("only_a"), (F.col("nb") - F.col("shared")).alias("only_b"))
    kind = F.when(F.col("contradictory") > 0, "contradictory").when((F.col("only_a") == 0) & (F.col("only_b") == 0), "compatible").when((F.col("only_a") == 0) | (F.col("only_b") == 0), "contained").otherwise("complementary")
    return out.withColumn("relation", kind)


def summary(relations: DataFrame) -> DataFrame:
    """(relation, n): how many choices a user has: groups, not pairs. Complementary pairs count by their first view,
    and of containers only those count that no other view holds."""
    from lakescout.operators.lineage import cut

    # A row for each pair of views, made once from their data.
    relations = cut(relations)
    holders = outer_containers(relations).select("holder").distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit("contained").alias("relation"), "n")
    first = relations.where("relation = 'complementary'").select("a").distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit("complementary"), "n")
    rest = [relations.where(F.col("relation") == kind).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind), "n") for kind in ("compatible", "contradictory")]
    return holders.union(first).union(rest[0]).union(rest[1])


def outer_containers(relations: DataFrame) -> DataFrame:
    """(holder, held): views that no other holds, with all they hold, through others too."""
    from lakescout.operators.lineage import cut

    holds = relations.where("relation = 'contained'").select(F.when(F.col("only_a") == 0, F.col("b")).otherwise(F.col("a")).alias("holder"), F.when(F.col("only_a") == 0, F.col("a")).otherwise(F.col("b")).alias("held"))
    every = frontier = cut(holds.distinct())
    while not frontier.isEmpty():
        step = frontier.join(holds.toDF("held", "further"), "held").select("holder", F.col("further").alias("held")).where("holder <> held").distinct()
        frontier = cut(step.join(every, ["holder", "held"], "left_anti"))
        every = every.union(frontier)
    return every.join(holds.select(F.col("held").alias("holder")), "holder", "left_anti")
