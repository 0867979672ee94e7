"""Token totals by source, language and tokenizer version, maintained by deltas.

A batch of changes holds signed rows: +1 inserts a document, -1 deletes it; a revised
document is its old row with -1 and its new one with +1. Each row has its token count
under each tokenizer version. A batch is summed to one row per source, language and
version and committed to the ledger folder under its id; totals are sums over the
committed batches. Sums are combined before the shuffle, so a hot source is one row
per task.

Commits are idempotent: a batch is written to a folder of its own attempt, whose name
becomes the batch's in one step at the end. A batch that is there is never written again,
of two that commit one id at a time only one gets the name, and what a lost attempt left
is not read. Compaction puts the totals and the ids of all batches behind them into one
batch, so a compacted ledger still refuses what it has counted.

Defined results: null and empty texts count 0 tokens; null sources and languages are
groups of their own; repeated rows count each; an empty batch commits no rows; groups
whose documents are all deleted stay with zeros until ``compact``; columns other than
those named are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockledger.llm.common import words
from dockledger.llm.tokens import default_path, encoder

KEYS = ("source", "lang", "tokenizer")
BPE, WORDS = "byte_bpe_50k", "words/1"


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``source``, ``lang``, ``tokenizer``, ``n_tokens``: a row for each
    document and tokenizer version."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            counts = pa.array([len(enc.encode(t.as_py())) for t in batch.column(4)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], counts], names=["doc_id", "source", "lang", "n_words", "n_bpe"])

    text = F.col("text").cast("string")
    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.size(words(text)).cast("long").alias("n_words"), text.alias("text")
    )
    counted = given.mapInArrow(run, "doc_id long, source string, lang string, n_words long, n_bpe long")
    both = F.array(F.struct(F.lit(BPE).alias("tokenizer"), F.col("n_bpe").alias("n")), F.struct(F.lit(WORDS).alias("tokenizer"), F.col("n_words").alias("n")))
    return counted.select("doc_id", "source", "lang", F.explode(both).alias("c")).select("doc_id", "source", "lang", "c.tokenizer", F.col("c.n").alias("n_tokens"))


def signed(counts: DataFrame, sign: int) -> DataFrame:
    return counts.withColumn("sign", F.lit(sign))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes that replace old counts by new ones."""
    return signed(old, -1).unionByName(signed(new, 1))


def deltas(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("n_tokens"))


class Ledger:
    """Committed batches in a shared folder, one subfolder each."""

    SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _file(self, path: str):
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _batch(self, batch_id: str) -> str:
        if not batch_id.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"batch id {batch_id!r}: letters, digits, - and _ only")
        return f"{self.folder}/batch-{batch_id}"

    def _compacted_ids(self) -> list[str]:
        return [f"{p}/_batches" for p in self.batches() if p.rsplit("/", 1)[1].startswith("batch-compacted")]

    def committed(self, batch_id: str) -> bool:
        fs, place = self._file(self._batch(batch_id))
        if fs.exists(place):
            return True
        behind = self._compacted_ids()
        return bool(behind) and not self.spark.read.text(behind).filter(F.col("value") == batch_id).isEmpty()

    def _publish(self, attempt: str, batch_id: str) -> bool:
        """Gives an attempt its name unless another one has it."""
        jvm = self.spark._jvm
        fs, made = self._file(attempt)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(made, self._file(self._batch(batch_id))[1], plain)
        except Exception:
            fs.delete(made, True)
            if not self.committed(batch_id):
                raise
            return False
        return True

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds a batch once; whether this call did it."""
        self._batch(batch_id)
        if self.committed(batch_id):
            return False
        attempt = f"{self.folder}/attempt-{uuid.uuid4().hex}"
        deltas(changes).write.parquet(attempt)
        return self._publish(attempt, batch_id)

    def batches(self) -> list[str]:
        fs, top = self._file(self.folder)
        if not fs.exists(top):
            return []
        found = [s.getPath().toString() for s in fs.listStatus(top) if s.isDirectory()]
        return sorted(p for p in found if p.rsplit("/", 1)[1].startswith("batch-"))

    def totals(self) -> DataFrame:
        paths = self.batches()
        if not paths:
            return self.spark.createDataFrame([], self.SCHEMA)
        rows = self.spark.read.schema(self.SCHEMA).parquet(*paths)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def compact(self, folder: str) -> "Ledger":
        """A new ledger with the totals as one batch, empty groups left out, that knows
        every batch counted here."""
        other = Ledger(self.spark, folder)
        name = f"compacted-{uuid.uuid4().hex}"
        attempt = f"{other.folder}/attempt-{uuid.uuid4().hex}"
        own = [p.rsplit("/batch-", 1)[1] for p in self.batches()]
        ids = self.spark.createDataFrame([(i,) for i in own], "value string")
        for p in self._compacted_ids():
            ids = ids.unionByName(self.spark.read.text(p))
        self.totals().filter("n_docs <> 0 OR n_tokens <> 0").write.parquet(attempt)
        ids.distinct().write.text(f"{attempt}/_batches")
        other._publish(attempt, name)
        return other
