"""The queries of the library by name, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakescout.functions import minhash as M
from lakescout.functions import text as TX
from lakescout.operators import annotations as AN
from lakescout.operators import dod, drift, drs
from lakescout.operators import edges as E
from lakescout.operators import graph as G
from lakescout.operators import joins as J
from lakescout.operators import ontology as O
from lakescout.operators import profile as P
from lakescout.operators import search as S
from lakescout.operators import vectors as V
from lakescout.operators import views as W
from lakescout.plans import lake as L
from lakescout.sources import readers as R

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its DuckDB SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def ids(spark, *nids: str):
    return spark.createDataFrame([(n,) for n in nids], "nid string")


# --- profiles -------------------------------------------------------------------------------------------------------


@query(f"WITH {L.PROFILE_SQL} SELECT nid, total_values, unique_values, min_value, max_value, round(avg_value, 3) AS avg_value, median, iqr FROM prof WHERE data_type = 'N'")
def profile_numeric(spark, d):
    return L.profile(spark, d).where("data_type = 'N'").select("nid", "total_values", "unique_values", "min_value", "max_value", F.round("avg_value", 3).alias("avg_value"), "median", "iqr")


@query(f"WITH {L.PROFILE_SQL} SELECT nid, total_values, unique_values FROM prof WHERE data_type = 'T'")
def profile_text_counts(spark, d):
    return L.profile(spark, d).where("data_type = 'T'").select("nid", "total_values", "unique_values")


VOTED = {"lineitem": ["l_orderkey", "l_linenumber", "l_returnflag"], "part": ["p_brand", "p_size"], "nation": ["n_name", "n_nationkey"]}


@query(f"""WITH {L.cells_sql(VOTED)}, v AS (SELECT nid, value, value NOT IN ('', 'nan') AS counted, regexp_full_match(value, '(\\+|-)?\\d+') AS whole, regexp_full_match(value, '(\\+|-)?\\d+([\\,]\\d+)*([\\.]\\d+)?') AS number FROM cells)
SELECT nid, CASE WHEN count(*) FILTER (counted) = 0 OR count(*) FILTER (counted AND NOT number) > 0 THEN 'STRING' WHEN count(*) FILTER (counted AND number AND NOT whole) > 0 THEN 'FLOAT' ELSE 'INT' END AS inferred FROM v GROUP BY nid""")
def profile_type_vote(spark, d):
    return P.type_votes(L.cells(spark, d, VOTED))


_MINIMA = ", ".join(f"min(({a} * h + {b}) % {M.PRIME})" for a, b in M.coefficients(16))
_TOKENS_SQL = f"{L.cells_sql()}, tokens AS (SELECT DISTINCT nid, token FROM (SELECT nid, unnest(regexp_split_to_array(lower(value), '[\\s_\\-]+')) AS token FROM (SELECT DISTINCT nid, value FROM cells)) WHERE token <> ''), hashed AS (SELECT nid, token, ('0x' || substr(md5(token), 1, 8))::BIGINT AS h0, ('0x' || substr(md5(token), 1, 8))::BIGINT % {M.PRIME} AS h FROM tokens), sigs AS (SELECT nid, [{_MINIMA}] AS minhash FROM hashed GROUP BY nid)"


@query(f"WITH {_TOKENS_SQL} SELECT nid, array_to_string(minhash, ',') AS minhash FROM sigs")
def profile_minhash16(spark, d):
    return P.minhash_of_cells(L.cells(spark, d), 16).select("nid", F.concat_ws(",", F.transform("minhash", lambda x: x.cast("string"))).alias("minhash"))


@query("SELECT 'lineitem.l_quantity' AS nid, count(l_quantity) AS n, round(stddev_pop(l_quantity), 6) AS deviation, quantile_cont(abs(trunc(l_quantity))::DOUBLE, 0.5) AS median FROM lineitem")
def profile_range(spark, d):
    x = F.col("l_quantity")
    return L.table(spark, d, "lineitem").agg(F.count(x).alias("n"), F.round(F.stddev_pop(x), 6).alias("deviation"), F.call_function("percentile", F.abs(x.cast("bigint")), F.lit(0.5)).alias("median")).select(F.lit("lineitem.l_quantity").alias("nid"), "n", "deviation", "median")


@query(f"WITH {_TOKENS_SQL} SELECT nid, h0 % 8 AS bin, min(h0) AS least FROM hashed GROUP BY ALL")
def profile_one_permutation(spark, d):
    return P.one_permutation(L.cells(spark, d), "nid", 8)


SHORT = {"nation": ["n_name"], "region": ["r_name"], "orders": ["o_orderstatus", "o_orderpriority"], "part": ["p_brand", "p_type"]}


@query(f"WITH {L.cells_sql(SHORT)} SELECT nid, string_agg(value, ' ' ORDER BY value) AS text FROM (SELECT DISTINCT nid, value FROM cells) GROUP BY nid")
def text_index_build(spark, d):
    return P.text_index(L.cells(spark, d, SHORT))


@query(f"WITH {L.cells_sql({'part': ['p_name', 'p_type'], 'events': ['event_type']})} SELECT nid, term, count(*) AS n FROM (SELECT nid, unnest(regexp_split_to_array(lower(value), '[^a-z0-9]+')) AS term FROM cells) WHERE length(term) > 3 AND NOT regexp_matches(term, '[0-9]') GROUP BY ALL HAVING count(*) > 3")
def text_signature_terms(spark, d):
    return P.signature_terms(L.cells(spark, d, {"part": ["p_name", "p_type"], "events": ["event_type"]}))


@query(f"WITH {L.PROFILE_SQL}, {L.NODES_SQL} SELECT nid, source_name, field_name, data_type, cardinality FROM nodes")
def nodes_cardinality(spark, d):
    return L.nodes(spark, d).select("nid", "source_name", "field_name", "data_type", "cardinality")


# --- edges ----------------------------------------------------------------------------------------------------------


@query(f"WITH {L.PROFILE_SQL} SELECT a.nid AS src_nid, b.nid AS dst_nid, 'SCHEMA' AS relation, 1.0::DOUBLE AS score FROM prof a JOIN prof b ON a.source_name = b.source_name AND a.nid < b.nid")
def edges_schema_same_table(spark, d):
    return E.same_table(L.nodes(spark, d))


_NAME_TOKENS = "list_filter(string_split(translate(lower(column_name), '_-', '  '), ' '), lambda x: x <> '')"


@query(f"""WITH {L.PROFILE_SQL}, tf AS (SELECT nid AS key, term, count(*) AS tf FROM (SELECT nid, unnest({_NAME_TOKENS}) AS term FROM prof) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), raw AS (SELECT key, term, (ln((1 + n) / (1 + df)) + 1) * tf AS w FROM tf JOIN df USING (term), (SELECT count(*)::DOUBLE AS n FROM prof)),
vec AS (SELECT key, term, w / sqrt(sum(w * w) OVER (PARTITION BY key)) AS w FROM raw),
cos AS (SELECT a.key AS a, b.key AS b, round(sum(a.w * b.w), 6) AS cosine FROM vec a JOIN vec b ON a.term = b.term AND a.key <> b.key GROUP BY ALL),
best AS (SELECT * FROM cos WHERE cosine > 0 QUALIFY row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) <= 9)
SELECT DISTINCT least(a, b) AS src_nid, greatest(a, b) AS dst_nid, 'SCHEMA_SIM' AS relation, 1.0::DOUBLE AS score, cosine FROM best""")
def edges_schema_sim_exact(spark, d):
    return E.schema_sim(L.nodes(spark, d), TX.name_tokens(F.col("field_name")))


@query(f"""WITH {_TOKENS_SQL}, p AS (SELECT a.nid AS a, b.nid AS b, list_sum(list_transform(list_zip(a.minhash, b.minhash), lambda z: CASE WHEN z[1] = z[2] THEN 1 ELSE 0 END)) / 16.0::DOUBLE AS j FROM sigs a JOIN sigs b ON a.nid < b.nid)
SELECT a AS src_nid, b AS dst_nid, 'CONTENT_SIM' AS relation, round(j, 4) AS score FROM p WHERE j >= 0.7""")
def edges_content_text_minhash16(spark, d):
    return E.text_content(P.minhash_of_cells(L.cells(spark, d), 16), bands=16, rows=1)


@query(f"""WITH {_TOKENS_SQL}, n AS (SELECT nid, count(*) AS n FROM tokens GROUP BY nid), c AS (SELECT a.nid AS a, b.nid AS b, count(*) AS c FROM tokens a JOIN tokens b ON a.token = b.token AND a.nid < b.nid GROUP BY ALL)
SELECT a, b, c / (x.n + y.n - c) AS jaccard FROM c JOIN n x ON x.nid = a JOIN n y ON y.nid = b WHERE c / (x.n + y.n - c) >= 0.05""")
def edges_content_text_jaccard(spark, d):
    tokens = L.cells(spark, d).distinct().select(F.col("nid").alias("key"), F.explode(M.value_tokens(F.col("value"))).alias("token")).distinct()
    return E.exact_jaccard(tokens, 0.05)


@query(f"WITH {L.PREFIX} SELECT * FROM content")
def edges_content_num_overlap(spark, d):
    return E.numeric_content(L.profile(spark, d))


@query(f"WITH {L.PREFIX} SELECT * FROM inclusion")
def edges_inclusion_dep(spark, d):
    return E.inclusion(L.profile(spark, d))


_POINTS = "points(nid, m) AS (SELECT 'orders.' || (o_orderkey % 40), 1.0::DOUBLE * (o_orderkey % 40) / 12 FROM orders GROUP BY o_orderkey % 40)"


@query(f"""WITH {_POINTS}, gaps AS (SELECT nid, m, CASE WHEN m - lag(m) OVER (ORDER BY m, nid) > 0.1 THEN 1 ELSE 0 END AS gap FROM points), islands AS (SELECT nid, m, sum(gap) OVER (ORDER BY m, nid) AS island FROM gaps)
SELECT a.nid AS src_nid, b.nid AS dst_nid, 'CONTENT_SIM' AS relation, round(greatest(0.85, least(1.0, 1.0 - (abs(a.m - b.m) / 0.1) * (1.0 - 0.85::DOUBLE))), 4) AS score FROM islands a JOIN islands b ON a.island = b.island AND a.nid < b.nid""")
def edges_zero_iqr_islands(spark, d):
    k = F.col("o_orderkey") % 40
    points = L.table(spark, d, "orders").select(k.alias("k")).distinct().select(F.concat(F.lit("orders."), F.col("k")).alias("nid"), F.lit("N").alias("data_type"), (F.lit(1.0) * F.col("k") / 12).alias("median"), F.lit(0.0).alias("iqr"), F.lit(0.0).alias("min_value"), F.lit(0.0).alias("max_value"))
    return E.zero_iqr(points)


@query(f"WITH {L.PREFIX} SELECT * FROM pkfk")
def edges_pkfk(spark, d):
    nodes, edges = L.graph(spark, d)
    return edges.where("relation = 'PKFK'")


@query(f"WITH {L.PREFIX} SELECT relation, count(*) AS n FROM edges GROUP BY relation")
def edge_counts_by_relation(spark, d):
    return G.relation_counts(L.graph(spark, d)[1])


@query(f"WITH {L.PREFIX} SELECT src_nid AS nid, count(*) AS degree FROM sym GROUP BY src_nid ORDER BY degree DESC, nid LIMIT 10")
def hub_columns_topk(spark, d):
    return G.degrees(L.graph(spark, d)[1], 10)


@query(f"WITH {L.PREFIX} SELECT least(a.source_name, b.source_name) AS table_a, greatest(a.source_name, b.source_name) AS table_b, relation, max(score) AS score FROM edges JOIN nodes a ON a.nid = src_nid JOIN nodes b ON b.nid = dst_nid WHERE a.source_name <> b.source_name GROUP BY ALL")
def table_pair_max_score(spark, d):
    nodes, edges = L.graph(spark, d)
    return G.table_scores(edges, nodes)


@query(f"WITH {L.PREFIX} SELECT src_nid, dst_nid, bit_or(CASE relation WHEN 'CONTENT_SIM' THEN 1 WHEN 'INCLUSION_DEPENDENCY' THEN 2 ELSE 4 END) AS types FROM edges GROUP BY ALL")
def edge_type_bits(spark, d):
    return G.edge_type_bits(L.graph(spark, d)[1], {"CONTENT_SIM": 0, "INCLUSION_DEPENDENCY": 1, "PKFK": 2})


@query("""WITH a AS (SELECT DISTINCT o_custkey AS v FROM orders WHERE o_custkey IS NOT NULL), b AS (SELECT DISTINCT c_custkey AS v FROM customer WHERE c_custkey IS NOT NULL), c AS (SELECT count(*) AS shared FROM a JOIN b USING (v)), na AS (SELECT count(*) AS n_a FROM a), nb AS (SELECT count(*) AS n_b FROM b)
SELECT n_a, n_b, shared, shared > 0.4 * (n_a + n_b) AS overlaps FROM na, nb, c""")
def overlap_of_columns(spark, d):
    return E.value_overlap(L.table(spark, d, "orders").select("o_custkey"), L.table(spark, d, "customer").select("c_custkey"))


@query("""WITH c AS (SELECT l_partkey AS x, count(*) FILTER (l_linenumber <= 3) AS ca, count(*) AS cb FROM lineitem GROUP BY x), t AS (SELECT sum(ca) AS na, sum(cb) AS nb FROM c)
SELECT round(max(abs(fa / na - fb / nb)), 9) AS d, max(na)::BIGINT AS n_a, max(nb)::BIGINT AS n_b FROM (SELECT sum(ca) OVER (ORDER BY x) AS fa, sum(cb) OVER (ORDER BY x) AS fb FROM c), t""")
def ks_statistic(spark, d):
    x = L.table(spark, d, "lineitem")
    out = E.ks_statistic(x.where("l_linenumber <= 3").select("l_partkey"), x.select("l_partkey"))
    return out.select(F.round("d", 9).alias("d"), F.col("n_a").cast("bigint").alias("n_a"), F.col("n_b").cast("bigint").alias("n_b"))


@query("""WITH docs AS (SELECT item_id AS key, list_filter(regexp_extract_all(lower(text), '[a-z0-9_]{2,}'), lambda x: true) AS terms FROM benchmark),
tf AS (SELECT key, term, count(*) AS tf FROM (SELECT key, unnest(terms) AS term FROM docs) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT key, term, (ln((1 + n) / (1 + df)) + 1) * (1 + ln(tf)) AS w FROM tf JOIN df USING (term), (SELECT count(*)::DOUBLE AS n FROM docs)), vec AS (SELECT key, term, w / sqrt(sum(w * w) OVER (PARTITION BY key)) AS w FROM raw)
SELECT a.key AS a, b.key AS b, round(sum(a.w * b.w), 5) AS cosine FROM vec a JOIN vec b ON a.term = b.term AND a.key < b.key GROUP BY ALL""")
def text_pair_cosine(spark, d):
    terms = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]{2,}"), F.lit(0))
    docs = L.table(spark, d, "benchmark").select(F.col("item_id").alias("key"), terms.alias("terms"))
    return E.cosine_pairs(E.tfidf(docs, sublinear=True)).select("a", "b", F.round("cosine", 5).alias("cosine"))


# --- text and names -------------------------------------------------------------------------------------------------

_CAMEL = "regexp_replace(p_name || 'MyField' || p_size || 'Name', '(.)([A-Z][a-z]+)', '\\1_\\2', 'g')"
_SNAKE = f"lower(regexp_replace({_CAMEL}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'))"


def _camel():
    return F.concat("p_name", F.lit("MyField"), F.col("p_size").cast("string"), F.lit("Name"))


@query(f"SELECT p_partkey, {_SNAKE} AS name FROM part")
def str_snake(spark, d):
    return L.table(spark, d, "part").select("p_partkey", TX.snake(_camel()).alias("name"))


@query(f"SELECT p_partkey, array_to_string(list_filter(string_split(translate({_SNAKE}, '_-', '  '), ' '), lambda x: x <> ''), '|') AS tokens FROM part")
def str_tokenize(spark, d):
    return L.table(spark, d, "part").select("p_partkey", F.array_join(TX.name_tokens(_camel()), "|").alias("tokens"))


_STOP = ", ".join(f"'{w}'" for w in TX.STOP_WORDS)


@query(f"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(string_split(lower(text), ' '), lambda x: length(x) > 1 AND x NOT IN ({_STOP})))), '|') AS tokens FROM benchmark")
def str_curate(spark, d):
    return L.table(spark, d, "benchmark").select("item_id", F.array_join(TX.curated_tokens(F.split("text", " ")), "|").alias("tokens"))


@query(f"""WITH t AS (SELECT item_id, w.token AS token, w.pos AS pos FROM (SELECT item_id, unnest(list_transform(list_zip(x, range(len(x))), lambda z: {{'token': z[1], 'pos': z[2]}})) AS w FROM (SELECT item_id, list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-zA-Z]{{4,}}')) AS x FROM benchmark)) WHERE lower(w.token) NOT IN ({_STOP}))
SELECT item_id, arg_min(token, pos) AS token FROM t GROUP BY item_id, lower(token)""")
def text_tokens_first_seen(spark, d):
    return R.text_tokens(L.table(spark, d, "benchmark"), "item_id", "text", 20_000)


_URI = "'s3://lake/' || c_mktsegment || '/files/' || CASE c_custkey % 5 WHEN 0 THEN 'readme' WHEN 1 THEN c_custkey::VARCHAR WHEN 2 THEN 'tsqz-67gi' WHEN 3 THEN lower(c_mktsegment) ELSE 'sales_' || c_custkey END || '.csv'"


def _uri():
    k = F.col("c_custkey") % 5
    stem = F.when(k == 0, "readme").when(k == 1, F.col("c_custkey").cast("string")).when(k == 2, "tsqz-67gi").when(k == 3, F.lower("c_mktsegment")).otherwise(F.concat(F.lit("sales_"), F.col("c_custkey").cast("string")))
    return F.concat(F.lit("s3://lake/"), F.col("c_mktsegment"), F.lit("/files/"), stem, F.lit(".csv"))


_STEMS = "'cc-zero', 'cc-by', 'legalcode', 'open-licenses', 'government-works', 'odc-odbl', 'license', 'index', 'metadata', 'catalog', 'dcat-us', 'iso', 'edit', 'search', 'contact', 'resolve', 'request', 'wmsserver', 'policyinformation', 'gmxcodelists', 'gmi', 'readme', 'headers', 'signed-metadata', 'bios', 'hires', 'cwhr', 'v1', 'v2'"


@query(f"""WITH u AS (SELECT c_custkey, {_URI} AS uri FROM customer), s AS (SELECT c_custkey, lower(regexp_replace(string_split(uri, '/')[-1], '\\.[^.]*$', '')) AS stem, string_split(uri, '/') AS p, list_position(string_split(uri, '/'), 'files') AS place FROM u),
w AS (SELECT c_custkey, stem, CASE WHEN place > 0 THEN lower(p[CASE WHEN place > 1 THEN place - 1 ELSE -1 END]) ELSE '' END AS slug FROM s)
SELECT c_custkey, stem IN ({_STEMS}) OR regexp_full_match(stem, '[a-z0-9]{{4}}-[a-z0-9]{{4}}') OR regexp_full_match(stem, '\\d+(-\\d+)?') OR regexp_full_match(stem, 'index-[A-Za-z0-9]{{6}}') OR regexp_full_match(stem, 'doi-[a-z0-9]+') OR regexp_full_match(stem, 'www_[a-z0-9_]+') OR (slug <> '' AND stem = slug) AS is_metadata FROM w""")
def uri_is_metadata(spark, d):
    return L.table(spark, d, "customer").select("c_custkey", TX.is_metadata_uri(_uri()).alias("is_metadata"))


@query(f"WITH u AS (SELECT c_custkey, list_filter(string_split({_URI}, '/'), lambda x: x <> '') AS p FROM customer) SELECT c_custkey, p[list_position(p, 'files') - 1] || '/' || regexp_replace(p[-1], '\\.[^.]*$', '') AS table_name FROM u")
def table_name_from_path(spark, d):
    return L.table(spark, d, "customer").select("c_custkey", TX.table_name_of(_uri()).alias("table_name"))


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> ''))"


@query(f"""WITH w AS (SELECT item_id, {_WORDS} AS t, ['the', 'of', 'thing'] AS q FROM benchmark)
SELECT item_id, round(CASE WHEN len(t) = 0 THEN 0.0::DOUBLE ELSE 0.8::DOUBLE * len(list_intersect(q, t)) / 3 + 0.2::DOUBLE * len(list_intersect(q, t)) / len(t) END, 9) AS score FROM w""")
def keyword_coverage_score(spark, d):
    return L.table(spark, d, "benchmark").select("item_id", F.round(TX.keyword_score(F.lit("the of thing"), F.col("text")), 9).alias("score"))


_WIDTHS = "list_filter(list_transform(head, lambda x: len(regexp_replace(x, '\"[^\"]*\"', '', 'g')) - len(replace(regexp_replace(x, '\"[^\"]*\"', '', 'g'), {mark}, ''))), lambda n: n > 0)[1:3]"
_EVEN = " OR ".join(f"(len({_WIDTHS.format(mark=m)}) = 3 AND len(list_distinct({_WIDTHS.format(mark=m)})) = 1)" for m in ("','", "chr(9)", "'|'", "';'"))


@query(f"""WITH l AS (SELECT item_id, list_filter(list_transform(string_split(concat_ws(chr(10), text, text), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS lines FROM benchmark), h AS (SELECT item_id, lines, lines[1:5] AS head FROM l)
SELECT item_id, len(lines) >= 3 AND (len(list_filter(head, lambda x: starts_with(x, '{{') AND ends_with(x, '}}'))) >= 3 OR (lines[1][1] NOT IN ('{{', '[') AND ({_EVEN}))) AS is_table FROM h""")
def table_by_peek(spark, d):
    return L.table(spark, d, "benchmark").select("item_id", TX.looks_like_table(F.concat_ws("\n", "text", "text")).alias("is_table"))


# --- search ---------------------------------------------------------------------------------------------------------


def _bm25_sql(docs: str, terms: list[str], n: int) -> str:
    wanted = ", ".join(f"'{t}'" for t in terms)
    return f"""{docs}, tok AS (SELECT nid, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM docs), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
tf AS (SELECT nid, len(w) AS dl, term, len(list_filter(w, lambda x: x = term)) AS tf FROM tok, (SELECT unnest([{wanted}]) AS term)), df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY term),
bm AS (SELECT nid, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM tf JOIN df USING (term), st GROUP BY nid HAVING max(tf) > 0 ORDER BY score DESC, nid LIMIT {n})"""


_CONV = "docs AS (SELECT conv_id::VARCHAR || '.' || turn AS nid, text FROM conversations WHERE text IS NOT NULL)"


def _conversations(spark, d):
    return L.table(spark, d, "conversations").where("text is not null").select(F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("nid"), "text")


@query(f"WITH {_bm25_sql(_CONV, ['thing', 'tion'], 20)} SELECT nid, score FROM bm")
def kw_content_bm25(spark, d):
    return S.bm25(_conversations(spark, d), "tion thing", 20)


_NAMES = L.PROFILE_SQL + ", docs AS (SELECT nid, column_name AS text FROM prof)"


def _names(spark, d):
    return L.nodes(spark, d).select("nid", F.col("field_name").alias("text"))


@query(f"WITH {_bm25_sql(_NAMES, ['custkey'], 5)}, fill AS (SELECT nid, 0.5::DOUBLE AS score, 1 AS branch FROM docs WHERE text ILIKE '%custkey%' AND nid NOT IN (SELECT nid FROM bm)) SELECT nid, score FROM (SELECT nid, score, 0 AS branch FROM bm UNION ALL SELECT * FROM fill) ORDER BY branch, score DESC, nid LIMIT 5")
def kw_schema_bm25_ilike(spark, d):
    return S.field_search(_names(spark, d), "custkey", 5)


_TABLES = L.PROFILE_SQL + ", docs AS (SELECT nid, source_name AS text FROM prof)"


@query(f"WITH {_bm25_sql(_TABLES, ['orders'], 5)}, fill AS (SELECT nid, 0.5::DOUBLE AS score, 1 AS branch FROM docs WHERE text ILIKE '%orders%' AND nid NOT IN (SELECT nid FROM bm)) SELECT nid, score FROM (SELECT nid, score, 0 AS branch FROM bm UNION ALL SELECT * FROM fill) ORDER BY branch, score DESC, nid LIMIT 5")
def kw_table_bm25_ilike(spark, d):
    return S.field_search(L.nodes(spark, d).select("nid", F.col("source_name").alias("text")), "orders", 5)


@query(f"WITH {_CONV} SELECT nid, 1.0::DOUBLE AS score FROM docs WHERE regexp_matches(text, '\\bthe\\b') ORDER BY nid LIMIT 50")
def kw_exact_content(spark, d):
    return S.exact_content(_conversations(spark, d), "the", 50)


@query(f"WITH {_NAMES} SELECT nid, 1.0::DOUBLE AS score FROM docs WHERE text = 'o_custkey'")
def kw_exact_schema(spark, d):
    return S.exact_name(_names(spark, d), "o_custkey", 50)


@query(f"WITH {_TABLES} SELECT nid, 1.0::DOUBLE AS score FROM docs WHERE text = 'orders'")
def kw_exact_table(spark, d):
    return S.exact_name(L.nodes(spark, d).select("nid", F.col("source_name").alias("text")), "orders", 50)


@query(f"WITH {_CONV}, t AS (SELECT nid, levenshtein(unnest(string_split(lower(text), ' ')), 'thing') AS e FROM docs) SELECT nid, min(e)::INTEGER AS edits, 1.0::DOUBLE / (1 + min(e)) AS score FROM t WHERE e <= 2 GROUP BY nid ORDER BY edits, nid LIMIT 30")
def kw_fuzzy(spark, d):
    return S.fuzzy(_conversations(spark, d), "thing", 2, 30)


@query(f"WITH {_NAMES} SELECT DISTINCT text AS name, levenshtein(lower(substr(text, 1, 5)), 'o_ord')::INTEGER AS edits FROM docs WHERE levenshtein(lower(substr(text, 1, 5)), 'o_ord') <= 3 ORDER BY edits, name LIMIT 10")
def kw_suggest_prefix(spark, d):
    return S.suggest(_names(spark, d), "o_ord", 3, 10)


@query(f"WITH {_NAMES} SELECT nid, 1.0::DOUBLE AS score FROM docs WHERE text ILIKE '%key%' OR text = 'n_name'")
def kw_multi_context(spark, d):
    names = _names(spark, d)
    return S.any_of([S.like_name(names, "key", 1000), S.exact_name(names, "n_name", 1000)])


@query(f"WITH {L.PROFILE_SQL} SELECT nid, source_name, median, iqr FROM prof WHERE data_type = 'N'")
def enumerate_numeric(spark, d):
    return L.profile(spark, d).where("data_type = 'N'").select("nid", "source_name", "median", "iqr")


# --- navigation -----------------------------------------------------------------------------------------------------


def _nbr_sql(nid: str, relation: str) -> str:
    return f"WITH {L.PREFIX} SELECT dst_nid AS nid, max(score) AS score, n.db_name, n.source_name, n.field_name FROM sym JOIN nodes n ON n.nid = dst_nid WHERE src_nid = '{nid}' AND relation = '{relation}' GROUP BY ALL"


def _nbr(spark, d, nid, relation):
    nodes, edges = L.graph(spark, d)
    return G.neighbours(edges, nodes, ids(spark, nid), relation)


@query(_nbr_sql("orders.o_custkey", "PKFK"))
def nbr_pkfk(spark, d):
    return _nbr(spark, d, "orders.o_custkey", "PKFK")


@query(_nbr_sql("orders.o_custkey", "CONTENT_SIM"))
def nbr_content(spark, d):
    return _nbr(spark, d, "orders.o_custkey", "CONTENT_SIM")


@query(_nbr_sql("orders.o_custkey", "INCLUSION_DEPENDENCY"))
def nbr_inclusion(spark, d):
    return _nbr(spark, d, "orders.o_custkey", "INCLUSION_DEPENDENCY")


@query(f"WITH {L.PROFILE_SQL} SELECT nid, source_name FROM prof WHERE source_name = (SELECT source_name FROM prof WHERE nid = 'orders.o_custkey') AND nid <> 'orders.o_custkey'")
def nbr_schema(spark, d):
    n = L.nodes(spark, d)
    return n.join(n.where("nid = 'orders.o_custkey'").select("source_name"), "source_name", "left_semi").where("nid <> 'orders.o_custkey'").select("nid", "source_name")


_REACH = "RECURSIVE"
_BFS = "bfs(nid, depth) AS (SELECT 'orders.o_custkey', 0 UNION SELECT dst_nid, depth + 1 FROM bfs JOIN sym ON src_nid = bfs.nid WHERE depth < {hops} {relation})"


@query(f"WITH RECURSIVE {L.PREFIX}, {_BFS.format(hops=2, relation=chr(65) + 'ND relation = ' + chr(39) + 'PKFK' + chr(39))} SELECT nid, min(depth)::INTEGER AS depth FROM bfs GROUP BY nid")
def traverse_hops2(spark, d):
    return G.traverse(L.graph(spark, d)[1], ids(spark, "orders.o_custkey"), "PKFK", 2)


@query(f"WITH RECURSIVE {L.PREFIX}, {_BFS.format(hops=12, relation='')} SELECT nid, min(depth)::INTEGER AS depth FROM bfs GROUP BY nid")
def recursive_closure(spark, d):
    return G.closure(L.graph(spark, d)[1], ids(spark, "orders.o_custkey"))


_PATHS = f"WITH RECURSIVE {L.PREFIX}, e AS (SELECT DISTINCT src_nid, dst_nid FROM sym WHERE relation = 'PKFK'), walk(cur, path) AS (SELECT 'orders.o_custkey', ['orders.o_custkey'] UNION ALL SELECT dst_nid, list_append(path, dst_nid) FROM walk JOIN e ON src_nid = cur WHERE len(path) <= 3 AND NOT list_contains(path, dst_nid)), hit AS (SELECT cur, path, len(path) - 1 AS hops FROM walk WHERE cur IN ('nation.n_nationkey', 'lineitem.l_suppkey')), least_hops AS (SELECT cur, min(hops) AS m FROM hit GROUP BY cur)"


@query(f"{_PATHS} SELECT 'orders.o_custkey' AS source, hit.cur AS target, hops::INTEGER AS hops, min(array_to_string(path, '>')) AS path FROM hit JOIN least_hops l ON l.cur = hit.cur AND hops = m GROUP BY ALL")
def path_field_shortest(spark, d):
    out = G.shortest_paths(L.graph(spark, d)[1], ids(spark, "orders.o_custkey"), ids(spark, "nation.n_nationkey", "lineitem.l_suppkey"), "PKFK", 3)
    return out.select("source", "target", "hops", F.concat_ws(">", "path").alias("path"))


@query(f"{_PATHS} SELECT 'orders.o_custkey' AS source, hit.cur AS target, hops::INTEGER AS hops, array_to_string(path, '>') AS path FROM hit JOIN least_hops l ON l.cur = hit.cur AND hops = m")
def all_shortest_paths(spark, d):
    out = G.shortest_paths(L.graph(spark, d)[1], ids(spark, "orders.o_custkey"), ids(spark, "nation.n_nationkey", "lineitem.l_suppkey"), "PKFK", 3, every=True)
    return out.select("source", "target", "hops", F.concat_ws(">", "path").alias("path"))


@query(f"""WITH RECURSIVE {L.PREFIX}, hops AS (SELECT DISTINCT a.source_name AS s, b.source_name AS t, src_nid || '>' || dst_nid AS hop FROM sym JOIN nodes a ON a.nid = src_nid JOIN nodes b ON b.nid = dst_nid WHERE relation = 'PKFK' AND a.source_name <> b.source_name),
walk(cur, tables, path) AS (SELECT 'orders', ['orders'], []::VARCHAR[] UNION ALL SELECT t, list_append(tables, t), list_append(path, hop) FROM walk JOIN hops ON s = cur WHERE cur <> 'region' AND len(path) < 2 AND NOT list_contains(tables, t))
SELECT len(path)::INTEGER AS hops, array_to_string(path, '|') AS path FROM walk WHERE cur = 'region'""")
def path_table_all(spark, d):
    nodes, edges = L.graph(spark, d)
    return G.table_paths(edges, nodes, "orders", "region", "PKFK", 2)


@query(f"WITH {L.PREFIX}, h AS (SELECT dst_nid AS nid, max(score) AS score, n.db_name, n.source_name, n.field_name FROM sym JOIN nodes n ON n.nid = dst_nid WHERE src_nid = 'orders.o_custkey' AND relation = 'PKFK' AND n.source_name <> 'orders' GROUP BY ALL) SELECT * REPLACE (round(score, 4) AS score) FROM h QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY h.score DESC, nid) = 1")
def agent_neighbor_cross_table(spark, d):
    return G.cross_table(_nbr(spark, d, "orders.o_custkey", "PKFK"), "orders", 100)


# --- result sets and provenance -------------------------------------------------------------------------------------


def _hits(spark, d, words):
    return L.nodes(spark, d).where(F.col("field_name").contains(words)).select("nid", "source_name", F.lit(1.0).alias("score"))


_AB = f"{L.PROFILE_SQL}, a AS (SELECT nid, source_name, 1.0::DOUBLE AS score FROM prof WHERE contains(column_name, 'key')), b AS (SELECT nid, source_name, 1.0::DOUBLE AS score FROM prof WHERE contains(column_name, 'part'))"


@query(f"WITH {_AB} SELECT nid, source_name, max(score) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL")
def drs_union(spark, d):
    return drs.union(_hits(spark, d, "key"), _hits(spark, d, "part"))


@query(f"WITH {_AB} SELECT * FROM a WHERE nid IN (SELECT nid FROM b)")
def drs_intersection_fields(spark, d):
    return drs.intersection(_hits(spark, d, "key"), _hits(spark, d, "part"))


@query(f"WITH {_AB} SELECT DISTINCT nid, source_name, score FROM (SELECT * FROM a WHERE source_name IN (SELECT source_name FROM b) UNION ALL SELECT * FROM b WHERE source_name IN (SELECT source_name FROM a))")
def drs_intersection_tables(spark, d):
    return drs.intersection_by_table(_hits(spark, d, "key"), _hits(spark, d, "part"))


@query(f"WITH {_AB} SELECT * FROM a WHERE nid NOT IN (SELECT nid FROM b)")
def drs_difference(spark, d):
    return drs.difference(_hits(spark, d, "key"), _hits(spark, d, "part"))


def _provenance(spark, d):
    """A made-up provenance over nations: each leads to its region, and regions to two results."""
    n = L.table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src_nid"), F.concat(F.lit("r"), "n_regionkey").alias("dst_nid"), F.lit("KW_LOOKUP").alias("op"))
    r = L.table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("src_nid"), F.concat(F.lit("t"), F.col("r_regionkey") % 2).alias("dst_nid"), F.lit("PKFK").alias("op"))
    return n.union(r)


_PROV = "prov AS (SELECT 'n' || n_nationkey AS src_nid, 'r' || n_regionkey AS dst_nid, 'KW_LOOKUP' AS op FROM nation UNION ALL SELECT 'r' || r_regionkey, 't' || (r_regionkey % 2), 'PKFK' FROM region)"
_PROV_PATHS = f"{_PROV}, leaf AS (SELECT DISTINCT src_nid AS nid FROM prov WHERE src_nid NOT IN (SELECT dst_nid FROM prov)), walk(origin, nid, path, expl) AS (SELECT nid, nid, [nid], nid FROM leaf UNION ALL SELECT origin, dst_nid, list_append(path, dst_nid), expl || ' --[' || op || ']--> ' || dst_nid FROM walk JOIN prov ON src_nid = walk.nid WHERE len(path) <= 4)"


@query(f"WITH {_PROV} SELECT DISTINCT src_nid AS nid, 'leaf' AS kind FROM prov WHERE src_nid NOT IN (SELECT dst_nid FROM prov) UNION ALL SELECT DISTINCT dst_nid, 'head' FROM prov WHERE dst_nid NOT IN (SELECT src_nid FROM prov)")
def prov_leafs_heads(spark, d):
    return drs.ends(_provenance(spark, d))


@query(f"WITH RECURSIVE {_PROV_PATHS} SELECT origin, nid, array_to_string(path, '>') AS path FROM walk")
def prov_paths(spark, d):
    return drs.paths(_provenance(spark, d), 4).select("origin", "nid", F.concat_ws(">", "path").alias("path"))


@query(f"WITH RECURSIVE {_PROV_PATHS} SELECT DISTINCT nid, origin FROM walk WHERE len(path) > 1")
def prov_why(spark, d):
    return drs.why(drs.paths(_provenance(spark, d), 4))


@query(f"WITH RECURSIVE {_PROV_PATHS} SELECT nid, expl AS explanation FROM walk WHERE len(path) > 1")
def prov_how(spark, d):
    return drs.how(drs.paths(_provenance(spark, d), 4))


_SCORE = "(ascii(substr(x, 1, 1)) % 7) / 4.0::DOUBLE"


@query(f"WITH RECURSIVE {_PROV_PATHS}, s AS (SELECT nid, list_sum(list_transform(path, lambda x: {_SCORE})) AS c FROM walk) SELECT nid, max(c) AS certainty FROM s GROUP BY nid")
def rank_certainty(spark, d):
    paths = drs.paths(_provenance(spark, d), 4)
    scores = paths.select("nid").distinct().select("nid", ((F.ascii("nid") % 7) / F.lit(4.0)).alias("score"))
    return drs.certainty(paths, scores)


@query(f"WITH RECURSIVE {_PROV_PATHS} SELECT nid, count(DISTINCT origin) / (SELECT count(*) FROM leaf) AS coverage FROM walk WHERE len(path) > 1 GROUP BY nid")
def rank_coverage(spark, d):
    return drs.coverage(drs.paths(_provenance(spark, d), 4))


@query(f"WITH {L.PREFIX} SELECT n.source_name, sum(round(score, 4)::DECIMAL(18,4))::DOUBLE AS certainty FROM sym JOIN nodes n ON n.nid = dst_nid WHERE src_nid = 'orders.o_custkey' GROUP BY n.source_name")
def rank_table_scores(spark, d):
    nodes, edges = L.graph(spark, d)
    met = G.of_relation(edges, None).where("src_nid = 'orders.o_custkey'").join(nodes.select(F.col("nid").alias("dst_nid"), "source_name"), "dst_nid")
    return met.groupBy("source_name").agg(F.sum(F.round("score", 4).cast("decimal(18,4)")).cast("double").alias("certainty"))


# --- joins ----------------------------------------------------------------------------------------------------------


@query("SELECT o.o_orderkey, o.o_custkey, c.c_custkey, c.c_name, c.c_mktsegment FROM orders o JOIN customer c ON lower(o.o_custkey::VARCHAR) = lower(c.c_custkey::VARCHAR)")
def join_normalized_key(spark, d):
    return J.join_on(L.table(spark, d, "orders").select("o_orderkey", "o_custkey"), L.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "o_custkey", "c_custkey")


@query("WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'NULL' WHEN o_orderkey % 3 = 1 THEN NULL ELSE o_custkey::VARCHAR END AS k FROM orders), b AS (SELECT c_custkey::VARCHAR AS k2, c_name FROM customer UNION ALL SELECT 'null', 'nobody') SELECT o_orderkey, k, k2, c_name FROM a JOIN b ON lower(k) = lower(k2) WHERE lower(k) NOT IN ('nan', 'null', '')")
def join_null_key_drop(spark, d):
    k = F.col("o_orderkey") % 3
    a = L.table(spark, d, "orders").select("o_orderkey", F.when(k == 0, "NULL").when(k == 1, F.lit(None)).otherwise(F.col("o_custkey").cast("string")).alias("k"))
    b = L.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("k2"), "c_name").union(spark.createDataFrame([("null", "nobody")], "k2 string, c_name string"))
    return J.join_on(a, b, "k", "k2", drop_null_keys=True)


@query("""WITH a AS (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders), b AS (SELECT c_custkey, c_name FROM customer), keys AS (SELECT DISTINCT c_custkey::VARCHAR AS k FROM b ORDER BY k DESC LIMIT 100),
fa AS (SELECT *, o_custkey::VARCHAR AS k FROM a WHERE o_custkey::VARCHAR IN (SELECT k FROM keys) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_custkey, o_orderkey, o_orderstatus) = 1)
SELECT o_custkey, o_orderkey, o_orderstatus, c_custkey, c_name FROM fa JOIN b ON b.c_custkey::VARCHAR = fa.k WHERE fa.k IN (SELECT k FROM keys)""")
def join_consistent_sample(spark, d):
    return J.consistent_sample_join(L.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), L.table(spark, d, "customer").select("c_custkey", "c_name"), "o_custkey", "c_custkey", 100)


_HOPS = [("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey")]


def _tables(spark, d):
    return {"orders": L.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "customer": L.table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), "nation": L.table(spark, d, "nation"), "region": L.table(spark, d, "region")}


_FOLD = "orders o JOIN customer c ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey"


@query(f"SELECT o_orderkey, o_custkey, o_orderpriority, c_custkey, c_name, c_nationkey, n_nationkey, n_name, n_regionkey, r_regionkey, r_name FROM {_FOLD}")
def join_tree_fold(spark, d):
    return J.fold(_tables(spark, d), _HOPS)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE lower(trim(n_regionkey::VARCHAR)) = '1'")
def filter_cell(spark, d):
    return J.cell_filter(L.table(spark, d, "nation"), {"n_regionkey": " 1 "})


@query("SELECT c_custkey FROM customer WHERE lower(trim(c_mktsegment)) = 'building'")
def find_key_for(spark, d):
    return J.keys_of(L.table(spark, d, "customer"), "c_custkey", "c_mktsegment", "Building")


# --- view search ----------------------------------------------------------------------------------------------------

_FILTERS = [dod.Filter(0, "c_name"), dod.Filter(1, "n_name"), dod.Filter(2, "o_orderpriority")]


@query(f"WITH {L.PROFILE_SQL} SELECT CASE column_name WHEN 'c_name' THEN 0 WHEN 'n_name' THEN 1 ELSE 2 END AS filter_id, nid, source_name FROM prof WHERE column_name IN ('c_name', 'n_name', 'o_orderpriority')")
def dod_joint_filters(spark, d):
    return dod.joint_filters(L.nodes(spark, d), L.cells(spark, d, {"nation": ["n_name"]}), _FILTERS)


@query("SELECT * FROM (VALUES ('customer', '0', 1), ('nation', '1', 1), ('orders', '2', 1)) t(source_name, filters, n)")
def dod_table_filter_cover(spark, d):
    found = dod.joint_filters(L.nodes(spark, d), L.cells(spark, d, {"nation": ["n_name"]}), _FILTERS)
    return dod.covering_tables(found).select("source_name", F.array_join("filters", ",").alias("filters"), "n")


@query(f"SELECT count(*) > 0 AS joins FROM {_FOLD} WHERE lower(trim(r_regionkey::VARCHAR)) = '2'")
def dod_join_graph_probe(spark, d):
    ok = dod.can_materialise(_tables(spark, d), _HOPS, {"region": {"r_regionkey": "2"}})
    return spark.createDataFrame([(ok,)], "joins boolean")


@query("SELECT c_name, n_name, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def dod_view_end_to_end(spark, d):
    tables = _tables(spark, d)
    return next(dod.search(tables, L.nodes(spark, d), L.cells(spark, d, {"nation": ["n_name"]}), lambda group: [_HOPS[:2]], _FILTERS))[1]


# --- views ----------------------------------------------------------------------------------------------------------


def _views(spark, d):
    v = L.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    changed = v.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 10 == 0, "changed").otherwise(F.col("o_orderpriority")))
    return {"v1": v, "v2": v.orderBy(F.desc("o_orderkey")), "v3": v.where("o_orderstatus = 'F'"), "v4": v.where("o_orderkey % 2 = 0"), "v5": v.where("o_orderkey % 2 = 1"), "v6": changed}


_V = "v1 AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders), v3 AS (SELECT * FROM v1 WHERE o_orderstatus = 'F'), v4 AS (SELECT * FROM v1 WHERE o_orderkey % 2 = 0), v5 AS (SELECT * FROM v1 WHERE o_orderkey % 2 = 1), v6 AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 10 = 0 THEN 'changed' ELSE o_orderpriority END AS o_orderpriority FROM v1)"


def _uniq_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, (count(DISTINCT {c}) + max(({c} IS NULL)::INTEGER)) / count(*) AS uniqueness FROM {table}" for c in columns)


@query(_uniq_sql("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]))
def view_uniqueness(spark, d):
    return W.uniqueness(L.table(spark, d, "customer"))


@query(f"SELECT * FROM ({_uniq_sql('customer', ['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment'])}) ORDER BY uniqueness DESC, column_name LIMIT 1")
def view_most_likely_key(spark, d):
    return W.most_likely_key(L.table(spark, d, "customer"))


@query("SELECT DISTINCT l_linestatus, l_returnflag, l_suppkey FROM lineitem WHERE l_linestatus IS NOT NULL AND l_returnflag IS NOT NULL AND l_suppkey IS NOT NULL")
def view_curate(spark, d):
    return W.curated(L.table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_suppkey"))


@query("SELECT * FROM (VALUES ('v1~v2', true, 'EQUIVALENT'), ('v1~v3', false, 'DIF_CARDINALITY'), ('v1~v6', false, 'DIF_VALUES')) t(pair, equivalent, view_class)")
def view_equivalent(spark, d):
    v = _views(spark, d)
    out = [W.equivalent(v["v1"], v[o]).withColumn("pair", F.lit(f"v1~{o}")) for o in ("v2", "v3", "v6")]
    return P.union_all(out)


@query(f"WITH {_V} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, (SELECT count(DISTINCT lower({c}::VARCHAR)) FROM v1 WHERE lower({c}::VARCHAR) NOT IN (SELECT lower({c}::VARCHAR) FROM v3)) AS missing" for c in ("o_orderkey", "o_orderstatus", "o_orderpriority")))
def view_contained(spark, d):
    v = _views(spark, d)
    return W.missing_values(v["v1"], v["v3"])


@query(f"WITH {_V} SELECT o_orderkey AS key, 'left' AS side FROM v4 WHERE o_orderkey NOT IN (SELECT o_orderkey FROM v5) UNION ALL SELECT o_orderkey, 'right' FROM v5 WHERE o_orderkey NOT IN (SELECT o_orderkey FROM v4)")
def view_complementary(spark, d):
    v = _views(spark, d)
    return W.complementary_keys(v["v4"], v["v5"], "o_orderkey")


@query(f"WITH {_V} SELECT DISTINCT v1.o_orderkey AS key FROM v1 JOIN v6 USING (o_orderkey) WHERE v1.o_orderpriority <> v6.o_orderpriority")
def view_contradictory(spark, d):
    v = _views(spark, d)
    return W.contradictory_keys(v["v1"], v["v6"], "o_orderkey")


@query(f"WITH {_V} SELECT 'missing' AS kind, 0::BIGINT AS n UNION ALL SELECT 'not_unique', 0 UNION ALL SELECT 'conflict', count(*) FROM v1 WHERE o_orderkey % 10 = 0")
def view_inconsistent_on_key(spark, d):
    v = _views(spark, d)
    return W.inconsistencies(v["v1"], v["v6"], "o_orderkey")


@query("SELECT * FROM (VALUES ('v1', 'v1'), ('v2', 'v1'), ('v3', 'v3'), ('v4', 'v4'), ('v5', 'v5'), ('v6', 'v6')) t(view_id, representative)")
def fourc_compatible(spark, d):
    return W.compatible(W.tagged_rows(_views(spark, d)))


_PAIR = "SELECT '{a}' AS a, '{b}' AS b, (SELECT count(*) FROM (SELECT * FROM {a} INTERSECT SELECT * FROM {b})) AS shared, (SELECT count(*) FROM (SELECT * FROM {a} EXCEPT SELECT * FROM {b})) AS only_a, (SELECT count(*) FROM (SELECT * FROM {b} EXCEPT SELECT * FROM {a})) AS only_b"


@query(f"WITH {_V} SELECT * FROM (" + " UNION ALL ".join(_PAIR.format(a=a, b=b) for a, b in (("v1", "v3"), ("v1", "v4"), ("v1", "v5"), ("v3", "v4"), ("v3", "v5"), ("v1", "v6"), ("v3", "v6"), ("v4", "v6"), ("v5", "v6"))) + ") WHERE shared > 0")
def fourc_contained(spark, d):
    v = _views(spark, d)
    return W.containment(W.tagged_rows({k: x for k, x in v.items() if k != "v2"}))


@query(f"WITH {_V} SELECT count(*) AS shared_keys, count(*) FILTER (v1.o_orderpriority <> v6.o_orderpriority) AS contradictory FROM v1 JOIN v6 USING (o_orderkey)")
def fourc_complementary_contradictory(spark, d):
    v = _views(spark, d)
    shared = v["v1"].select("o_orderkey").join(v["v6"].select("o_orderkey"), "o_orderkey").agg(F.count(F.lit(1)).alias("shared_keys"))
    wrong = W.contradictory_keys(v["v1"], v["v6"], "o_orderkey").agg(F.count(F.lit(1)).alias("contradictory"))
    return shared.join(wrong, F.lit(True))


# --- vectors --------------------------------------------------------------------------------------------------------


def _queries(spark, d):
    """Five stated queries."""
    return L.table(spark, d, "embeddings").where("vec_id in (0, 7, 14, 21, 28)")


_DIST = {"cosine": "1.0::DOUBLE - list_dot_product(q::DOUBLE[], e::DOUBLE[]) / (sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[])) * sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[])))", "euclidean": "sqrt(list_sum(list_transform(list_zip(q, e), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))))", "manhattan": "list_sum(list_transform(list_zip(q, e), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE)))"}


def _dist_sql(kind: str) -> str:
    return f"dist AS (SELECT query_id, vec_id, round({_DIST[kind]}, 6) AS distance FROM (SELECT a.vec_id AS query_id, a.embedding AS q, b.vec_id, b.embedding AS e FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id IN (0, 7, 14, 21, 28)))"


def _topk_sql(kind: str) -> str:
    return f"WITH {_dist_sql(kind)} SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank FROM dist QUALIFY rank <= 10"


@query(_topk_sql("cosine"))
def ann_cosine_topk(spark, d):
    return V.nearest(V.measured(_queries(spark, d), L.table(spark, d, "embeddings"), "cosine"), 10)


@query(_topk_sql("euclidean"))
def ann_euclidean_topk(spark, d):
    return V.nearest(V.measured(_queries(spark, d), L.table(spark, d, "embeddings"), "euclidean"), 10)


@query(_topk_sql("manhattan"))
def ann_manhattan_topk(spark, d):
    return V.nearest(V.measured(_queries(spark, d), L.table(spark, d, "embeddings"), "manhattan"), 10)


@query(f"WITH {_dist_sql('cosine')} SELECT query_id, vec_id, distance FROM dist WHERE distance < 0.8")
def ann_threshold(spark, d):
    return V.within(V.measured(_queries(spark, d), L.table(spark, d, "embeddings"), "cosine"), 0.8)


_PLANES = V.hyperplanes(64, 6)
_SIGNS = " || ".join(f"CASE WHEN list_dot_product(embedding::DOUBLE[], {p}::DOUBLE[]) > 0 THEN '1' ELSE '0' END" for p in _PLANES)


@query(f"SELECT vec_id, {_SIGNS} AS bucket FROM embeddings")
def ann_hyperplane_buckets(spark, d):
    return V.buckets(L.table(spark, d, "embeddings"), _PLANES)


@query(f"WITH k AS (SELECT vec_id, {_SIGNS} AS bucket FROM embeddings), p AS (SELECT substr(bucket, 1, n::INTEGER) AS prefix, count(*) AS n FROM k, range(7) r(n) GROUP BY 1 HAVING count(*) >= 20) SELECT vec_id AS query_id, prefix, n FROM k JOIN p ON starts_with(bucket, prefix) WHERE vec_id IN (0, 7, 14, 21, 28) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY length(prefix) DESC) = 1")
def ann_prefix_tree(spark, d):
    keys = V.buckets(L.table(spark, d, "embeddings"), _PLANES)
    return V.longest_prefix(keys, keys.where("vec_id in (0, 7, 14, 21, 28)"), 20)


@query(f"WITH k AS (SELECT vec_id, {_SIGNS} AS bucket FROM embeddings), {_dist_sql('cosine')}, ex AS (SELECT query_id, vec_id FROM dist QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 10), ap AS (SELECT dist.query_id, dist.vec_id FROM dist JOIN k a ON a.vec_id = dist.query_id JOIN k b ON b.vec_id = dist.vec_id AND a.bucket = b.bucket QUALIFY row_number() OVER (PARTITION BY dist.query_id ORDER BY distance, dist.vec_id) <= 10), h AS (SELECT count(*) AS hit FROM ex JOIN ap USING (query_id, vec_id)) SELECT hit / (SELECT count(*) FROM ex) AS recall, hit / (SELECT count(*) FROM ap) AS precision FROM h")
def ann_recall_precision(spark, d):
    data = L.table(spark, d, "embeddings")
    keys = V.buckets(data, _PLANES)
    measured = V.measured(_queries(spark, d), data, "cosine")
    met = measured.join(keys.select(F.col("vec_id").alias("query_id"), F.col("bucket").alias("b")), "query_id").join(keys, "vec_id").where("b = bucket").select("query_id", "vec_id", "distance")
    return V.recall(V.nearest(measured, 10), V.nearest(met, 10))


# --- drift, annotations, ontology -----------------------------------------------------------------------------------


def _snapshots(spark, d):
    x = L.table(spark, d, "lineitem")
    return [P.text_cells(f, "lineitem", ["l_partkey", "l_suppkey", "l_quantity"]) for f in (x.where("l_linenumber <= 3"), x)]


_DRIFT = "x AS (" + " UNION ALL ".join(f"SELECT 'lineitem.{c}' AS nid, {c} AS value, bool_or(l_linenumber <= 3) AS old FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("l_partkey", "l_suppkey", "l_quantity")) + ") SELECT nid, count(*) FILTER (old) AS a, count(*) AS b FROM x GROUP BY nid"


@query(f"SELECT nid, a / b AS jaccard FROM (WITH {_DRIFT})")
def drift_jaccard(spark, d):
    return drift.column_change(*_snapshots(spark, d)).select("nid", "jaccard")


@query(f"SELECT nid, round(1 - least(1.0::DOUBLE, (a / b) * (b / a)), 9) AS change FROM (WITH {_DRIFT})")
def drift_scaled_change(spark, d):
    return drift.column_change(*_snapshots(spark, d)).select("nid", F.round("change", 9).alias("change"))


@query(f"WITH {L.PROFILE_SQL} SELECT 'nation.n_name' AS source, nid AS target, 'SUBCLASS' AS relation FROM prof WHERE source_name = 'region'")
def md_search_relation(spark, d):
    nodes = L.nodes(spark, d)
    rows = AN.annotate(nodes.where("source_name = 'region'").select("nid"), ids(spark, "nation.n_name"), "me", "INSIGHT", "a part of", "SUPERCLASS")
    return AN.search(rows, ids(spark, "nation.n_name"), "SUBCLASS").select("source", "target", "relation")


def _classes(spark, d):
    """Nations as classes whose parents are regions."""
    n = L.table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("c_"), F.lower("n_name")).alias("name"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    return n.union(L.table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey"), F.concat(F.lit("custkey_"), F.lower("r_name")), F.lit(None).cast("string")))


_CLS = "cls AS (SELECT 'n' || n_nationkey AS id, 'c_' || lower(n_name) AS name, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'r' || r_regionkey, 'custkey_' || lower(r_name), NULL FROM region)"
_MATCH = f"{L.PROFILE_SQL}, {_CLS}, ct AS (SELECT id, list_distinct(list_filter(string_split(translate(name, '_-', '  '), ' '), lambda x: x <> '')) AS t FROM cls), nt AS (SELECT nid, list_distinct({_NAME_TOKENS}) AS t FROM prof), m AS (SELECT id AS class_id, nid, len(list_intersect(ct.t, nt.t)) / (len(ct.t) + len(nt.t) - len(list_intersect(ct.t, nt.t))) AS jaccard FROM ct, nt WHERE list_has_any(ct.t, nt.t))"


@query(f"WITH {_MATCH} SELECT class_id, nid, jaccard FROM m WHERE jaccard >= 0.2")
def onto_name_jaccard(spark, d):
    return O.name_matches(_classes(spark, d), L.nodes(spark, d), 0.2)


@query(f"WITH {_MATCH} SELECT DISTINCT a.nid, b.nid AS other FROM m a JOIN cls ON cls.id = a.class_id JOIN m b ON b.class_id = cls.parent WHERE a.nid <> b.nid AND a.jaccard >= 0.2 AND b.jaccard >= 0.2")
def onto_is_a_links(spark, d):
    classes = _classes(spark, d)
    return O.is_a_links(O.name_matches(classes, L.nodes(spark, d), 0.2), classes)


@query(f"WITH {_MATCH} SELECT class_id, round(avg(jaccard), 9) AS mean, max(jaccard) AS largest, min(jaccard) AS least, quantile_cont(jaccard, 0.5) AS median FROM m WHERE jaccard >= 0.2 GROUP BY class_id")
def onto_similarity_aggregates(spark, d):
    out = O.aggregates(O.name_matches(_classes(spark, d), L.nodes(spark, d), 0.2), "class_id", "jaccard")
    return out.withColumn("mean", F.round("mean", 9))
