"""The corpus pipeline: five operators in a row, each on what the one before kept.

All stages read whole texts of any length, take any further columns, and give no rows for none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, minhash, mixing, packing, toxicity
from tessera.llm._common import materialise, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels table.

    Null and empty texts get the score of no features; rows that repeat stay or go together. A document
    at the threshold (a tie) goes. Empty tables: nothing is rejected."""
    return toxicity.reject(docs, read(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the smallest doc_id stays, once. Null counts as the empty text; a null id loses to any."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more: one row of each group stays, that with the smallest
    doc_id (nulls last), then text hash. Rows are told apart by id and text, so an unrelated text under an
    id that goes stays. Texts without words are in no group and all stay."""
    return minhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Texts without words are never taken; null is a source of
    its own, the last; rows that agree in id, source and text take turns."""
    return mixing.sample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences of 1024 tokens. A null or empty text is its end token; rows that
    repeat are packed one by one, which mixing relies on."""
    return packing.pack(docs).drop("key")


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("minhash", drop_near_copies), ("mixing", mix_sources), ("packing", pack)]

#: A trained classifier, hashes and a packing plan: no SQL. tests/llm/test_pipeline.py holds every stage
#: against plain Python, and the whole run against the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
