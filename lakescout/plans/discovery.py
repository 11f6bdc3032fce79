"""Queries of join graphs, result sets with provenance, searches for agents and groups of views, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakescout.functions import text as TX
from lakescout.operators import dod
from lakescout.operators import edges as E
from lakescout.operators import joingraphs as JG
from lakescout.operators import joins as J
from lakescout.operators import profile as P
from lakescout.operators import results as RS
from lakescout.operators import search as S
from lakescout.operators import vectors as V
from lakescout.operators import views as W
from lakescout.plans import lake as L

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Register a function under its name, with its DuckDB SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- join graphs ----------------------------------------------------------------------------------------------------

_GROUP = ["customer", "nation", "orders"]
_IN_GROUP = "['customer', 'nation', 'orders']"
_PATHS = f"""{L.PREFIX},
hop AS MATERIALIZED (SELECT DISTINCT a.source_name AS f, b.source_name AS t, s.src_nid || '>' || s.dst_nid AS hop FROM sym s JOIN nodes a ON a.nid = s.src_nid JOIN nodes b ON b.nid = s.dst_nid WHERE s.relation = 'PKFK' AND a.source_name <> b.source_name),
one AS (SELECT f, t, [f, t] AS tables, [hop] AS hops FROM hop WHERE list_contains({_IN_GROUP}, f)),
two AS (SELECT one.f, h.t, list_append(one.tables, h.t) AS tables, list_append(one.hops, h.hop) AS hops FROM one JOIN hop h ON h.f = one.t WHERE NOT list_contains(one.tables, h.t)),
paths AS MATERIALIZED (SELECT f AS source, t AS target, hops, tables FROM (SELECT * FROM one UNION ALL SELECT * FROM two) WHERE list_contains({_IN_GROUP}, t) AND f < t)"""
_GRAPHS = f"""{_PATHS},
cov AS (SELECT *, list_sort(list_intersect(tables, {_IN_GROUP})) AS cover FROM paths),
whole AS (
  SELECT hops FROM cov WHERE len(cover) = 3
  UNION ALL
  SELECT list_concat(a.hops, b.hops) FROM cov a JOIN cov b ON (a.source < b.source OR (a.source = b.source AND a.target < b.target))
  WHERE len(a.cover) < 3 AND len(b.cover) < 3 AND list_has_any(a.cover, b.cover) AND len(list_distinct(list_concat(a.cover, b.cover))) = 3),
ids AS (SELECT hops, len(hops) AS n_hops, array_to_string(list_sort(list_distinct(string_split(array_to_string(hops, '>'), '>'))), '|') AS graph_id FROM whole),
graphs AS MATERIALIZED (SELECT graph_id, n_hops, array_to_string(hops, ' ') AS hops, hops AS hop_list FROM ids QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY n_hops, hops) = 1)"""


def _graphs(spark, d):
    nodes, edges = L.graph(spark, d)
    return nodes, JG.join_graphs(JG.pair_paths(edges, nodes, _GROUP), _GROUP)


@query(f"WITH {_PATHS} SELECT source, target, array_to_string(hops, ' ') AS hops FROM paths")
def dod_pair_paths(spark, d):
    nodes, edges = L.graph(spark, d)
    return JG.pair_paths(edges, nodes, _GROUP).select("source", "target", F.array_join("hops", " ").alias("hops"))


@query(f"WITH {_GRAPHS} SELECT graph_id, hops, n_hops::INTEGER AS n_hops FROM graphs")
def dod_join_graphs(spark, d):
    return _graphs(spark, d)[1].select("graph_id", F.array_join("hops", " ").alias("hops"), "n_hops")


@query(f"""WITH {_GRAPHS}, l AS (SELECT graph_id, string_split(unnest(hop_list), '>')[1] AS nid FROM graphs)
SELECT graph_id, round(avg(cardinality), 9) AS score, round(product(cardinality), 9) AS product FROM l JOIN nodes USING (nid) GROUP BY graph_id""")
def dod_rank_join_graphs(spark, d):
    nodes, graphs = _graphs(spark, d)
    found = JG.ranked(graphs, nodes.select("nid", F.col("cardinality").alias("uniqueness")))
    return found.select("graph_id", F.round("score", 9).alias("score"), F.round("product", 9).alias("product"))


def _bm25(name: str, docs: str, terms: list[str], n: int) -> str:
    """Common table expressions that end in ``name`` (nid, score): the n best of docs (nid, text)."""
    wanted = ", ".join(f"'{t}'" for t in terms)
    return f"""{name}_docs AS ({docs}), {name}_tok AS (SELECT nid, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM {name}_docs), {name}_st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM {name}_tok),
{name}_tf AS (SELECT nid, len(w) AS dl, term, len(list_filter(w, lambda x: x = term)) AS tf FROM {name}_tok, (SELECT unnest([{wanted}]) AS term)), {name}_df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM {name}_tf GROUP BY term),
{name} AS (SELECT nid, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM {name}_tf JOIN {name}_df USING (term), {name}_st GROUP BY nid HAVING max(tf) > 0 ORDER BY score DESC, nid LIMIT {n})"""


_VALUES = {"nation": ["n_name"], "region": ["r_name"], "part": ["p_name", "p_brand", "p_type"], "customer": ["c_mktsegment"], "orders": ["o_orderpriority"]}
_VALUE_TEXTS = "SELECT nid, string_agg(DISTINCT value, ' ' ORDER BY value) AS text FROM cells GROUP BY nid"


def _value_texts(spark, d):
    return P.text_index(L.cells(spark, d, _VALUES))


@query(f"WITH {L.PROFILE_SQL}, {L.cells_sql(_VALUES)}, {_bm25('cell', _VALUE_TEXTS, ['building'], 200)} SELECT CASE column_name WHEN 'c_mktsegment' THEN 0 ELSE 1 END AS filter_id, 'ATTR' AS kind, nid, 1.0::DOUBLE AS score FROM prof WHERE column_name IN ('c_mktsegment', 'n_name') UNION ALL SELECT 2, 'CELL', nid, score FROM cell")
def dod_individual_filters(spark, d):
    names = L.nodes(spark, d).select("nid", F.col("field_name").alias("text"))
    return dod.individual_filters(names, _value_texts(spark, d), [dod.Filter(0, "c_mktsegment", "BUILDING"), dod.Filter(1, "n_name")])


@query("SELECT 48::BIGINT AS row_bytes, n AS cartesian_rows, 48 * n AS cartesian_bytes, 48 * n <= 1000000000 AS fits FROM (SELECT (SELECT count(*) FROM orders) * (SELECT count(*) FROM customer) AS n)")
def join_size_estimate(spark, d):
    return J.join_estimate(L.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), L.table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), 1_000_000_000)


# --- searches -------------------------------------------------------------------------------------------------------


def _names(spark, d):
    return L.nodes(spark, d).select("nid", F.col("field_name").alias("text"))


_SIMILAR = """tok AS (SELECT nid, unnest(list_filter(string_split(translate(lower(column_name), '_-', '  '), ' '), lambda x: x <> '')) AS term FROM prof), tf AS (SELECT nid, term, count(*) AS tf FROM tok GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM prof)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term), w AS (SELECT nid, term, tf * idf AS w FROM tf JOIN idf USING (term)), norm AS (SELECT nid, sqrt(sum(w * w)) AS n FROM w GROUP BY nid),
q AS (SELECT term, idf AS q FROM idf WHERE term IN ('o', 'custkey')), near_names AS (SELECT nid, round(sum(w * q) / (any_value(n) * (SELECT sqrt(sum(q * q)) FROM q)), 6) AS cosine FROM w JOIN q USING (term) JOIN norm USING (nid) GROUP BY nid ORDER BY cosine DESC, nid LIMIT 10)"""


@query(f"WITH {L.PROFILE_SQL}, {_SIMILAR} SELECT nid, cosine FROM near_names")
def kw_schema_similar(spark, d):
    return S.similar_names(_names(spark, d), "o_custkey", 10, TX.name_tokens)


def _field(name: str, column: str, n: int) -> str:
    return f"""{_bm25(name, f"SELECT nid, {column} AS text FROM prof", ['custkey'], n)}, {name}_all AS (SELECT nid, score, branch FROM (SELECT nid, score, 0 AS branch FROM {name} UNION ALL SELECT nid, 0.5::DOUBLE, 1 FROM {name}_docs WHERE text ILIKE '%custkey%' AND nid NOT IN (SELECT nid FROM {name})) ORDER BY branch, score DESC, nid LIMIT {n})"""


@query(f"""WITH {L.PROFILE_SQL}, {_field('attr', 'column_name', 8)}, {_field('tab', 'source_name', 8)}, {_SIMILAR},
found AS (SELECT nid, round(score, 4) AS score, 0 AS place FROM attr_all UNION ALL SELECT nid, round(score, 4), 1 FROM tab_all UNION ALL SELECT nid, 0.0::DOUBLE, 2 FROM near_names),
firsts AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY nid ORDER BY place, score DESC) = 1)
SELECT nid, source_name AS "table", column_name AS "column", score FROM firsts JOIN prof USING (nid) ORDER BY score DESC, place, nid LIMIT 8""")
def agent_search_field(spark, d):
    names, nodes = _names(spark, d), L.nodes(spark, d)
    tables = nodes.select("nid", F.col("source_name").alias("text"))
    near = S.similar_names(names, "o custkey", 10, TX.name_tokens).select("nid", F.lit(0.0).alias("score"))
    return RS.search_results([S.field_search(names, "custkey", 8), S.field_search(tables, "custkey", 8), near], nodes, 8)


@query(f"""WITH {L.PROFILE_SQL}, {L.cells_sql(_VALUES)}, {_bm25('cell', _VALUE_TEXTS, ['building', 'steel', 'asia'], 10)},
best AS (SELECT nid, round(score, 4) AS score, source_name, column_name FROM cell JOIN prof USING (nid) QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY round(score, 4) DESC, nid) = 1)
SELECT nid, source_name AS "table", column_name AS "column", score FROM best ORDER BY score DESC, nid LIMIT 10""")
def agent_search_value(spark, d):
    return RS.search_results([S.bm25(_value_texts(spark, d), "building steel asia", 10)], L.nodes(spark, d), 10, dedup_tables=True)


@query(f"WITH {L.PROFILE_SQL} SELECT nid, 1::INTEGER AS edits, 0.5::DOUBLE AS score FROM prof WHERE false UNION ALL SELECT nid, e::INTEGER, 1.0::DOUBLE / (1 + e) FROM (SELECT nid, levenshtein(lower(column_name), 'p_size1') AS e FROM prof) WHERE e <= 2 ORDER BY edits, nid LIMIT 20")
def kw_fuzzy_auto(spark, d):
    return S.fuzzy_auto(_names(spark, d), "p_size1", 20)


@query(f"WITH {L.PROFILE_SQL} SELECT nid, 'lake' AS db_name, source_name, column_name AS field_name FROM prof WHERE nid IN ('nation.n_name', 'orders.o_custkey')")
def nid_reverse_lookup(spark, d):
    return S.by_nid(L.nodes(spark, d), ["nation.n_name", "orders.o_custkey", "no.such"])


# --- result sets ----------------------------------------------------------------------------------------------------


def _lookup(spark, d, word):
    hits = L.nodes(spark, d).where(F.col("field_name").contains(word)).select("nid", "source_name", F.lit(1.0).alias("score"))
    return RS.from_operation(hits, "KW_LOOKUP", word)


def _around(spark, d):
    """What lies next to orders.o_custkey over keys, as a result set led to by a lookup of 'custkey'."""
    nodes, edges = L.graph(spark, d)
    hits = E.symmetric(edges).where("relation = 'PKFK' and src_nid = 'orders.o_custkey'").groupBy(F.col("dst_nid").alias("nid")).agg(F.max("score").alias("score"))
    found = RS.from_operation(hits.join(nodes.select("nid", "source_name"), "nid"), "PKFK", "orders.o_custkey", 1.0)
    return found.absorb_provenance(_lookup(spark, d, "custkey"))


_A = "a AS (SELECT nid, source_name FROM prof WHERE contains(column_name, 'key')), b AS (SELECT nid, source_name FROM prof WHERE contains(column_name, 'part'))"
_EDGES = "e AS (SELECT 'synthetic_origin:key' AS src_nid, nid AS dst_nid FROM a UNION ALL SELECT 'synthetic_origin:part', nid FROM b)"


@query(f"WITH {L.PROFILE_SQL}, {_A}, {_EDGES} SELECT src_nid, dst_nid, 'KW_LOOKUP' AS op, CASE WHEN dst_nid IN (SELECT nid FROM a) AND dst_nid IN (SELECT nid FROM b) THEN 'AND' END AS mark FROM e")
def prov_from_operators(spark, d):
    return _lookup(spark, d, "key").intersection(_lookup(spark, d, "part")).edges


@query(f"WITH {L.PROFILE_SQL}, {_A}, {_EDGES} SELECT dst_nid AS nid, count(DISTINCT src_nid) / 2 AS coverage FROM e GROUP BY dst_nid")
def rank_coverage_of_union(spark, d):
    return _lookup(spark, d, "key").union(_lookup(spark, d, "part")).ranked_by_coverage()


@query(f"""WITH {L.PREFIX}, h AS (SELECT dst_nid AS nid, max(score) AS score FROM sym WHERE relation = 'PKFK' AND src_nid = 'orders.o_custkey' GROUP BY dst_nid)
SELECT nid, greatest(round(score + 1, 6), CASE WHEN contains(nid, 'custkey') THEN round(score, 6) ELSE 0.0::DOUBLE END) AS certainty FROM h""")
def rank_certainty_of_lookup(spark, d):
    # The lookup's origin scores -1, which counts as 0 on the way.
    return _around(spark, d).ranked_by_certainty().select("nid", F.round("certainty", 6).alias("certainty"))


@query(f"WITH {L.PROFILE_SQL}, {_A}, {_EDGES} SELECT source_name, count(DISTINCT dst_nid)::DOUBLE AS certainty, count(DISTINCT src_nid) / 2 AS coverage FROM e JOIN prof ON nid = dst_nid GROUP BY source_name")
def rank_tables_of_union(spark, d):
    return _lookup(spark, d, "key").union(_lookup(spark, d, "part")).table_scores()


@query(f"WITH {L.PROFILE_SQL} SELECT nid, source_name, CASE WHEN contains(column_name, 'size') THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM prof WHERE source_name IN (SELECT source_name FROM prof WHERE contains(column_name, 'size'))")
def drs_expand_to_table(spark, d):
    return RS.expand_to_tables(_lookup(spark, d, "size").hits, L.nodes(spark, d))


@query(f"WITH {L.PROFILE_SQL} SELECT nid, source_name, 0.0::DOUBLE AS score FROM prof WHERE source_name = 'nation' OR nid IN ('orders.o_custkey', 'part.p_size')")
def drs_make(spark, d):
    return RS.result_set(L.nodes(spark, d), ["nation", "orders.o_custkey", ("lake", "part", "p_size"), None]).hits


# --- views and statistics -------------------------------------------------------------------------------------------

_DESCRIBED = ["c_custkey", "c_nationkey", "c_acctbal"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}::DOUBLE), 6) AS mean, round(stddev({c}::DOUBLE), 6) AS std, min({c})::DOUBLE AS least, max({c})::DOUBLE AS largest FROM customer" for c in _DESCRIBED))
def view_describe(spark, d):
    return P.describe(L.table(spark, d, "customer").select("c_name", *_DESCRIBED)).select("column_name", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "least", "largest")


@query("""WITH v AS (SELECT c_acctbal AS x, 1 AS a, 0 AS b FROM customer UNION ALL SELECT s_acctbal, 0, 1 FROM supplier), c AS (SELECT x, sum(a) AS a, sum(b) AS b FROM v WHERE x IS NOT NULL GROUP BY x),
g AS (SELECT abs(sum(a) OVER (ORDER BY x) / (SELECT sum(a) FROM c) - sum(b) OVER (ORDER BY x) / (SELECT sum(b) FROM c)) AS g FROM c), n AS (SELECT sqrt(sum(a) * sum(b) / (sum(a) + sum(b))) AS n FROM c), s AS (SELECT max(g) AS d, any_value(n) AS n FROM g, n),
t AS (SELECT d, (n + 0.12 + 0.11 / n) * d AS t FROM s), r AS (SELECT d, CASE WHEN t < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END) * exp(-2 * k * k * t * t))))) END AS p FROM t)
SELECT round(d, 6) AS d, round(p, 6)::DOUBLE AS p, d < 0.1 AND p > 0.05 AS similar FROM r""")
def ks_decision(spark, d):
    out = E.ks_similar(L.table(spark, d, "customer").select("c_acctbal"), L.table(spark, d, "supplier").select("s_acctbal"))
    return out.select(F.round("d", 6).alias("d"), F.round("p", 6).alias("p"), "similar")


@query(f"""WITH {L.cells_sql(_VALUES)}, tf AS (SELECT nid, term, count(*) AS tf FROM (SELECT nid, unnest(regexp_extract_all(lower(value), '\\b\\w\\w+\\b')) AS term FROM cells) GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(DISTINCT nid) FROM tf)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term), w AS (SELECT nid, term, tf * idf AS w FROM tf JOIN idf USING (term)), norm AS (SELECT nid, sqrt(sum(w * w)) AS n FROM w GROUP BY nid)
SELECT a.nid AS src_nid, b.nid AS dst_nid, 'CONTENT_SIM' AS relation, round(sum(a.w * b.w) / (any_value(na.n) * any_value(nb.n)), 6) AS score FROM w a JOIN w b ON a.term = b.term AND a.nid < b.nid JOIN norm na ON na.nid = a.nid JOIN norm nb ON nb.nid = b.nid GROUP BY a.nid, b.nid HAVING score > 0""")
def edges_content_tfidf(spark, d):
    return E.text_tfidf(L.cells(spark, d, _VALUES), TX.terms(F.col("value")))


def _views(spark, d):
    v = L.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    changed = v.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 10 == 0, "changed").otherwise(F.col("o_orderpriority")))
    return {"v1": v, "v2": v.select(*v.columns), "v3": v.where("o_orderstatus = 'F'"), "v4": v.where("o_orderstatus = 'F' and o_orderkey % 2 = 0"), "v5": v.where("o_orderstatus = 'F' and o_orderkey % 2 = 1"), "v6": changed}


_ROWS = """base AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p FROM orders),
r AS (SELECT 'v1' AS v, * FROM base UNION ALL SELECT 'v2', * FROM base UNION ALL SELECT 'v3', * FROM base WHERE s = 'F' UNION ALL SELECT 'v4', * FROM base WHERE s = 'F' AND k % 2 = 0 UNION ALL SELECT 'v5', * FROM base WHERE s = 'F' AND k % 2 = 1 UNION ALL SELECT 'v6', k, s, CASE WHEN k % 10 = 0 THEN 'changed' ELSE p END FROM base),
sizes AS (SELECT v, count(*) AS n FROM r GROUP BY v), met AS (SELECT a.v AS a, b.v AS b, count(*) AS shared, count(*) FILTER (a.s <> b.s OR a.p <> b.p) AS contradictory FROM r a JOIN r b ON a.k = b.k AND a.v < b.v GROUP BY ALL),
rel AS (SELECT x.v AS a, y.v AS b, coalesce(contradictory, 0) AS contradictory, x.n - coalesce(shared, 0) AS only_a, y.n - coalesce(shared, 0) AS only_b FROM sizes x JOIN sizes y ON x.v < y.v LEFT JOIN met ON met.a = x.v AND met.b = y.v),
kinds AS (SELECT *, CASE WHEN contradictory > 0 THEN 'contradictory' WHEN only_a = 0 AND only_b = 0 THEN 'compatible' WHEN only_a = 0 OR only_b = 0 THEN 'contained' ELSE 'complementary' END AS relation FROM rel)"""


@query(f"WITH {_ROWS} SELECT * FROM kinds")
def fourc_group_relations(spark, d):
    return W.group_relations(_views(spark, d), "o_orderkey")


@query(f"""WITH {_ROWS}, holds AS (SELECT CASE WHEN only_a = 0 THEN b ELSE a END AS holder, CASE WHEN only_a = 0 THEN a ELSE b END AS held FROM kinds WHERE relation = 'contained')
SELECT 'contained' AS relation, (SELECT count(DISTINCT holder) FROM holds WHERE holder NOT IN (SELECT held FROM holds)) AS n UNION ALL SELECT 'complementary', (SELECT count(DISTINCT a) FROM kinds WHERE relation = 'complementary') UNION ALL SELECT 'compatible', (SELECT count(*) FROM kinds WHERE relation = 'compatible') UNION ALL SELECT 'contradictory', (SELECT count(*) FROM kinds WHERE relation = 'contradictory')""")
def fourc_summary(spark, d):
    return W.summary(W.group_relations(_views(spark, d), "o_orderkey"))


# --- buckets of vectors ---------------------------------------------------------------------------------------------

_PLANES = V.hyperplanes(64, 4)
_STEPS = " || '_' || ".join(f"floor(list_dot_product(embedding::DOUBLE[], {p}::DOUBLE[]) / 2)::BIGINT" for p in _PLANES)
_SIGNS = " || ".join(f"CASE WHEN list_dot_product(embedding::DOUBLE[], {p}::DOUBLE[]) > 0 THEN '1' ELSE '0' END" for p in V.hyperplanes(64, 12))


@query(f"SELECT vec_id, {_STEPS} AS bucket FROM embeddings")
def ann_step_buckets(spark, d):
    return L.table(spark, d, "embeddings").select("vec_id", V.step_key(F.col("embedding"), _PLANES, 2.0).alias("bucket"))


@query(f"""WITH k AS (SELECT vec_id, {_SIGNS} AS bucket FROM embeddings), h AS (SELECT a.vec_id AS query_id, b.vec_id, hamming(a.bucket, b.bucket)::INTEGER AS distance FROM k a JOIN k b ON a.vec_id <> b.vec_id WHERE a.vec_id IN (0, 7, 14, 21, 28))
SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank FROM h QUALIFY rank <= 10""")
def ann_hamming_topk(spark, d):
    keys = V.buckets(L.table(spark, d, "embeddings"), V.hyperplanes(64, 12))
    return V.hamming_nearest(keys, keys.where("vec_id in (0, 7, 14, 21, 28)"), 10)


@query(None)
def ann_pca_buckets(spark, d):
    """Signs along the first eight principal components; tests compare those with numpy's."""
    data = L.table(spark, d, "embeddings")
    return V.buckets(data, V.principal_planes(data, 8))
