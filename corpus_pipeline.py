"""A training-data pipeline over ``documents``: quality classifier, quality rules,
near-duplicates, mixing to target weights, packing.

Each stage takes the session, the documents its predecessor kept and the table folder;
``run`` applies all of them, writing and rereading each stage's result; the folders go
with ``session.release_tables``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dockledger.llm import mixing, near_dedup, packing, quality_classifier, quality_rules
from dockledger.llm.common import table
from dockledger.session import cut_lineage


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_classifier.keep_documents(docs, table(spark, sf_dir, "labels"))


def check_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules of the production policy reject go."""
    return quality_rules.keep_documents(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dedup.keep_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, stop short or go, as their source's target says."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", classify),
    ("quality rules", check_rules),
    ("MinHash near-dedup", drop_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

# Token ids cannot be said in SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
