"""The registered queries of the corpus operators: each applies one operator, with its
production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockledger.llm import divergence, hilbert_ann, license_scan, merkle, mixing, near_dedup, packing, quality_classifier, quality_rules, samples, sharding, simhash, token_counts, toxicity
from dockledger.llm.common import table
from dockledger.session import cut_lineage, scratch_path

Plan = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted; one in ten is deleted and one in ten revised to lower
    case; the second batch is delivered twice and counts once."""
    docs = table(spark, sf_dir, "documents")
    part = F.pmod(F.col("doc_id"), F.lit(10))
    counts = cut_lineage(token_counts.count_tokens(docs))
    lowered = token_counts.count_tokens(docs.filter(part == 1).withColumn("text", F.lower("text")))
    changes = token_counts.signed(counts.filter(part == 0), -1).unionByName(token_counts.revised(counts.filter(part == 1), lowered))
    ledger = token_counts.Ledger(spark, scratch_path(spark))
    ledger.commit("inserts", token_counts.signed(counts, 1))
    ledger.commit("changes", changes)
    ledger.commit("changes", changes)
    return ledger.totals()


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = near_dedup.Similarity(shingle=2, percent=80)
    return near_dedup.components(table(spark, sf_dir, "documents"), how).select("doc_id", "n_shingles", "component_id", "kept")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_sainte_lague_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(mixing.sized(table(spark, sf_dir, "documents"))).drop("source")


def op9_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", samples.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Plan] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_quality_rules,
        op3_license_scan,
        op4_hilbert_neighbours,
        op5_extendible_sharding,
        op6_minhash_near_dedup,
        op7_best_fit_packing,
        op8_sainte_lague_mixing,
        op9_ordinal_toxicity,
        op10_neighbour_quality,
        op11_merkle_manifest,
        op12_simhash_near_dedup,
        op13_source_divergence,
    )
}
ORACLE_SQL: dict[str, str] = {"op2_quality_rules": quality_rules.SQL, "op5_extendible_sharding": sharding.SQL, "op11_merkle_manifest": merkle.SQL, "op13_source_divergence": divergence.SQL}
