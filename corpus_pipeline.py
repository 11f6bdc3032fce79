"""A training corpus from documents: quality, toxicity, near-dedup and packing, each stage on all that is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakescout.llm import near_dedup, packing, quality, toxicity
from lakescout.llm.common import Scratch, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, doesn't reject."""
    return quality.keep_documents(docs, quality.fit_on(docs, table(spark, sf_dir, "labels")))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, fitted on the labelled ones among them, doesn't reject."""
    return toxicity.keep_documents(docs, toxicity.fit_on(docs, table(spark, sf_dir, "labels")))


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near-duplicates: five-word shingles, similarity 0.8."""
    return near_dedup.keep_documents(docs, near_dedup.FIVE_WORDS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in training sequences."""
    return packing.pack(docs)


STAGES = [("quality", good_quality), ("toxicity", not_toxic), ("near_dedup", no_near_copies), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each written as Parquet and read again as the next one's documents. What a
    stage read goes once it has been written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        written = Scratch(spark, f"corpus-{name}")
        docs = written.write(stage(spark, docs, sf_dir))
        if before is not None:
            before.clear()
        before = written
    return docs


#: The classifiers, MinHash and the tokenizer aren't expressible in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None
