"""The queries of this subpackage by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from lakescout.llm import ann_graph, hmm_lm, html_extraction, license_scan, near_dedup, quality, topk_search, toxicity
from lakescout.llm.bpe_tree import round_trip_digests
from lakescout.llm.common import table
from lakescout.llm.packing import pack


def op1_html_extraction(spark, sf_dir):
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op2_toxicity(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return toxicity.score_documents(documents, toxicity.fit_on(documents, table(spark, sf_dir, "labels")))


def op3_nn_descent(spark, sf_dir):
    return ann_graph.nearest(table(spark, sf_dir, "embeddings"))


def op4_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark, sf_dir):
    return round_trip_digests(table(spark, sf_dir, "documents"))


def op6_harmonic_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_cover_tree_topk(spark, sf_dir):
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


def op9_hmm_scoring(spark, sf_dir):
    return hmm_lm.score(table(spark, sf_dir, "documents"))


def op10_quality(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return quality.score_documents(documents, quality.fit_on(documents, table(spark, sf_dir, "labels")))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_toxicity": op2_toxicity,
    "op3_nn_descent": op3_nn_descent,
    "op4_license_scan": op4_license_scan,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_harmonic_packing": op6_harmonic_packing,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_cover_tree_topk": op8_cover_tree_topk,
    "op9_hmm_scoring": op9_hmm_scoring,
    "op10_quality": op10_quality,
}

ORACLES: dict[str, str] = {"op4_license_scan": license_scan.oracle()}
