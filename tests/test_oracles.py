"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from lakescout.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One of each kind; the rest run in the driver's comparison at a larger scale.
NAMES = ["profile_type_vote", "profile_minhash16", "text_index_build", "edges_zero_iqr_islands", "edges_content_text_jaccard", "overlap_of_columns", "ks_statistic", "text_pair_cosine", "str_snake", "str_tokenize", "str_curate", "text_tokens_first_seen", "uri_is_metadata", "table_name_from_path", "kw_content_bm25", "kw_fuzzy", "prov_paths", "prov_why", "rank_certainty", "rank_coverage", "join_normalized_key", "join_null_key_drop", "join_consistent_sample", "join_tree_fold", "view_uniqueness", "view_contained", "view_contradictory", "fourc_contained", "ann_cosine_topk", "ann_prefix_tree", "drift_jaccard", "nbr_pkfk"]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, duck, name):
    found = registry.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    result = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    expected = sorted(repr(tuple(row[names.index(c)] for c in columns)) for row in result.fetchall())
    assert sorted(repr(tuple(row[c] for c in columns)) for row in found.collect()) == expected


def test_every_query_has_a_name_and_columns():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
