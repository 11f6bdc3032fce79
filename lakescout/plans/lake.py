"""The lake of the driver's tables: profiles, nodes and edges, and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakescout.operators import edges as E
from lakescout.operators import profile as P
from lakescout.operators.lineage import cut

NUMERIC = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey", "n_regionkey"],
    "customer": ["c_custkey", "c_nationkey", "c_acctbal"],
    "supplier": ["s_suppkey", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_totalprice"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"],
    "events": ["event_id", "user_id"],
}
TEXT = {
    "region": ["r_name"],
    "nation": ["n_name"],
    "customer": ["c_name", "c_mktsegment"],
    "supplier": ["s_name"],
    "part": ["p_name", "p_brand", "p_type"],
    "orders": ["o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_returnflag", "l_linestatus"],
    "events": ["event_type"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Profiles that this process has written, by session, folder, kind and when the tables were changed last.
WRITTEN: dict[tuple, DataFrame] = {}


def profile(spark: SparkSession, sf_dir: str, exact: bool = True) -> DataFrame:
    """The profile of the lake, a row for each of its columns, written once and read by every query that needs it."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    times = [path(f"{sf_dir}/{t}.parquet").getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path(f"{sf_dir}/{t}.parquet")).getModificationTime() for t in NUMERIC]
    key = (spark.sparkContext.applicationId, sf_dir, exact, *times)
    if key not in WRITTEN:
        for old in [k for k in WRITTEN if k[:3] == key[:3] or k[0] != key[0]]:
            del WRITTEN[old]
        WRITTEN[key] = cut(P.union_all([P.profile_table(table(spark, sf_dir, t), t, exact=exact, columns=NUMERIC[t] + TEXT[t]) for t in NUMERIC]), 1)
    return WRITTEN[key]


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(P.nodes_of(profile(spark, sf_dir)), 1)


def cells(spark: SparkSession, sf_dir: str, columns: dict[str, list[str]] | None = None) -> DataFrame:
    return P.union_all([P.text_cells(table(spark, sf_dir, t), t, c) for t, c in (columns or TEXT).items()])


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges by numeric content, inclusion, islands and keys. The profile has a row for each column."""
    found = profile(spark, sf_dir)
    n = P.nodes_of(found)
    basic = cut(E.numeric_content(found).unionByName(E.inclusion(found)).unionByName(E.zero_iqr(found)), 1)
    return n, cut(basic.unionByName(E.pkfk(basic, n)), 1)


def _column(t: str, c: str, kind: str) -> str:
    stats = f"min({c})::DOUBLE, max({c})::DOUBLE, sum(round({c}, 4)::DECIMAL(28,4))::DOUBLE / count({c}), quantile_cont({c}::DOUBLE, 0.5), quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25)" if kind == "N" else "0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE"
    return f"SELECT '{t}.{c}', '{t}', '{c}', '{kind}', count({c}), count(DISTINCT {c}), {stats} FROM {t}"


PROFILE_SQL = "prof(nid, source_name, column_name, data_type, total_values, unique_values, min_value, max_value, avg_value, median, iqr) AS MATERIALIZED (" + " UNION ALL ".join([_column(t, c, "N") for t, cs in NUMERIC.items() for c in cs] + [_column(t, c, "T") for t, cs in TEXT.items() for c in cs]) + ")"
NODES_SQL = "nodes AS (SELECT nid, 'lake' AS db_name, source_name, column_name AS field_name, data_type, unique_values / total_values AS cardinality FROM prof)"
EDGES_SQL = """
iv AS (SELECT nid, median - iqr AS l, median + iqr AS r, (median + iqr) - (median - iqr) AS domain, min_value, max_value FROM prof WHERE data_type = 'N'),
pairs AS (
  SELECT a.nid, b.nid AS c_nid, a.domain, (least(a.r, b.r) - greatest(a.l, b.l)) / a.domain AS overlap, b.domain / a.domain AS ratio,
         a.min_value AS lo, a.max_value AS hi, b.min_value AS c_lo, b.max_value AS c_hi
  FROM iv a JOIN iv b ON a.nid <> b.nid WHERE a.domain > 0 AND b.domain > 0),
content AS (
  SELECT least(nid, c_nid) AS src_nid, greatest(nid, c_nid) AS dst_nid, 'CONTENT_SIM' AS relation, round(overlap, 4) AS score
  FROM pairs WHERE ratio >= 0.85 AND overlap >= 0.85
  QUALIFY row_number() OVER (PARTITION BY least(nid, c_nid), greatest(nid, c_nid) ORDER BY domain, nid DESC) = 1),
inclusion AS (
  SELECT DISTINCT least(nid, c_nid) AS src_nid, greatest(nid, c_nid) AS dst_nid, 'INCLUSION_DEPENDENCY' AS relation, 1.0::DOUBLE AS score
  FROM pairs WHERE ratio >= 0.3 AND overlap >= 0.3 AND c_lo >= lo AND c_hi <= hi AND c_lo >= 0),
gaps AS (SELECT nid, l AS m, CASE WHEN l - lag(l) OVER (ORDER BY l, nid) > 0.1 THEN 1 ELSE 0 END AS gap FROM iv WHERE domain = 0),
islands AS (SELECT nid, m, sum(gap) OVER (ORDER BY m, nid) AS island FROM gaps),
zero_iqr AS (
  SELECT a.nid AS src_nid, b.nid AS dst_nid, 'CONTENT_SIM' AS relation,
         round(greatest(0.85, least(1.0, CASE WHEN a.m = b.m THEN 1.0::DOUBLE ELSE 1.0 - (abs(a.m - b.m) / 0.1) * (1.0 - 0.85::DOUBLE) END)), 4) AS score
  FROM islands a JOIN islands b ON a.island = b.island AND a.nid < b.nid),
basic AS (SELECT * FROM content UNION ALL SELECT * FROM inclusion UNION ALL SELECT * FROM zero_iqr),
basic_sym AS (SELECT * FROM basic UNION ALL SELECT dst_nid, src_nid, relation, score FROM basic),
pkfk AS (
  SELECT DISTINCT least(src_nid, dst_nid) AS src_nid, greatest(src_nid, dst_nid) AS dst_nid, 'PKFK' AS relation, greatest(n.cardinality, o.cardinality) AS score
  FROM basic_sym JOIN nodes n ON n.nid = src_nid JOIN nodes o ON o.nid = dst_nid
  WHERE n.cardinality > 0.7 AND ((n.data_type = 'N' AND relation = 'INCLUSION_DEPENDENCY') OR (n.data_type = 'T' AND relation = 'CONTENT_SIM'))),
edges AS (SELECT * FROM basic UNION ALL SELECT * FROM pkfk),
sym AS (SELECT * FROM edges UNION ALL SELECT dst_nid, src_nid, relation, score FROM edges)"""
PREFIX = f"{PROFILE_SQL}, {NODES_SQL}, {EDGES_SQL}"


def cells_sql(columns: dict[str, list[str]] | None = None) -> str:
    return "cells(nid, value) AS (" + " UNION ALL ".join(f"SELECT '{t}.{c}', {c}::VARCHAR FROM {t} WHERE {c} IS NOT NULL" for t, cs in (columns or TEXT).items() for c in cs) + ")"
