"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """One document in five is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, target: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled texts (``doc_id``, ``text``, ``label``), held-out ones
    left out. They are the labelled ids with the smallest hash, so the same tables give
    the same sample. Null ids and labels are no labels; an id with several labels has the
    smallest; an id with several texts gives one of them.

    The ids chosen are at most ``rows`` numbers, which bounds the broadcast."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IS NOT NULL")
    chosen = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    met = texts.join(F.broadcast(chosen), "doc_id")
    return met.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
