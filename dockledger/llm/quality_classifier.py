"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is the weighted counts of its byte trigrams, hashed to ``features`` columns,
and of four marks of style: words that repeat the word before, upper-case letters,
symbols, exclamation marks (sqrt of the count times inverse document frequency, unit
length). The labelled sample
gives the frequencies and the leading right singular vectors; a projected text of unit
length is its latent vector. The labelled latent vectors, at most ``sample_rows`` x
``dims`` numbers, and the projection are broadcast. Every document's cosine products
with all of them are exact, computed in blocks; the ``neighbours`` largest vote with
their similarity as weight.

The sample of labelled rows that the model is fitted on is bounded by ``sample_rows``;
everything else covers all documents, in one pass without a shuffle.

Defined results: a null, empty or shorter than three bytes text, or one without any
trigram of the sample, gets the sample's share of label 1; ties of similarity go to
the earlier sample row; without any labelled row every score is 0.5; repeated rows are
scored each; an empty table gives no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockledger.llm.samples import labelled


@dataclass(frozen=True)
class Voting:
    sample_rows: int = 6000
    features: int = 2048
    dims: int = 48
    neighbours: int = 15
    threshold: float = 0.3


STYLE = 4  # columns after the hashed ones
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])


def text_counts(text: str | None, features: int) -> np.ndarray:
    encoded = (text or "").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(encoded, dtype=np.uint8)
    out = np.zeros(features + STYLE, dtype=np.float32)
    if len(raw) < 3:
        return out
    wide = raw.astype(np.uint32)
    code = (((wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]) * np.uint32(2654435761)) >> np.uint32(16)
    out[:features] = np.bincount(code % np.uint32(features), minlength=features)
    words = encoded.split()
    each = np.bincount(raw, minlength=256)
    out[features:] = sum(map(eq, words, words[1:])) * 4, each[_UPPER].sum(), each[_SYMBOL].sum(), each[ord("!")]
    return out


def packed(counts: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs."""
    most = counts.max()
    return counts.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{len(raw) // n}").astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest values of each row; ties go to the earlier column."""
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(cosine, near, axis=1).min(axis=1, keepdims=True)
    for row in np.flatnonzero((cosine >= least).sum(axis=1) > k):
        reach = np.flatnonzero(cosine[row] >= least[row])
        near[row] = reach[np.argsort(-cosine[row, reach], kind="stable")[:k]]
    return near


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    how: Voting

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return unit(unit(np.sqrt(counts) * self.idf) @ self.basis)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        if not len(self.labels):
            return np.full(len(counts), prior)
        cosine = self.latent(counts) @ self.vectors.T
        k = min(self.how.neighbours, cosine.shape[1])
        near = nearest(cosine, k)
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0.0).astype(np.float64)
        total = weight.sum(axis=1)
        vote = (weight * self.labels[near]).sum(axis=1)
        return np.where(total > 0, vote / np.where(total > 0, total, 1.0), prior)


def fit(docs: DataFrame, labels: DataFrame, how: Voting = Voting(), target: str = "quality") -> Model:
    """The sample comes to the driver as counts of at most ``sample_rows`` texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [packed(text_counts(t.as_py(), how.features)) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.binary())], schema=schema)

    sample = labelled(docs, labels, target, how.sample_rows).select("doc_id", "label", "text")
    got = sorted(sample.mapInArrow(count, "doc_id long, label int, counts binary").collect())
    if not got:
        return Model(np.ones(how.features + STYLE, np.float32), np.zeros((how.features + STYLE, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), how)
    y = np.array([r.label for r in got], dtype=np.float64)
    raw = [r.counts for r in got]
    del got

    def blocks() -> Iterator[np.ndarray]:
        """The sample in parts, so that the driver never holds it as floats."""
        for i in range(0, len(raw), BLOCK):
            yield np.stack([unpacked(c, how.features + STYLE) for c in raw[i : i + BLOCK]])

    found = sum((b > 0).sum(axis=0) for b in blocks())
    idf = np.log((1 + len(raw)) / (1 + found)).astype(np.float32) + 1.0
    gram = np.zeros((len(idf), len(idf)))
    for b in blocks():
        x = unit(np.sqrt(b) * idf)
        gram += x.T @ x
    _, basis = np.linalg.eigh(gram)
    model = Model(idf, np.ascontiguousarray(basis[:, ::-1][:, : how.dims]).astype(np.float32), np.zeros((0, 1), np.float32), y, how)
    return Model(idf, model.basis, np.concatenate([model.latent(b) for b in blocks()]), y, how)


BLOCK = 256


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score``, ``predicted`` for every row; other columns of ``docs``
    that are asked for with ``_row`` go along untouched."""
    carried = [c for c in docs.columns if c == "_row"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried)
    extra = f", _row {docs.schema['_row'].dataType.simpleString()}" if carried else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                found = m.scores(np.stack([text_counts(t.as_py(), m.how.features) for t in part.column(1)]))
                columns = [part.column(0), pa.array(found), pa.array((found >= m.how.threshold).astype(np.int32)), *[part.column(2) for _ in carried]]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted", *carried])

    return given.mapInArrow(run, f"doc_id long, score double, predicted int{extra}")


def keep_documents(docs: DataFrame, labels: DataFrame, how: Voting = Voting()) -> DataFrame:
    """The rows of documents that are predicted good, as they are."""
    model = fit(docs, labels, how)
    scored = score(docs.select("doc_id", "text", F.struct("*").alias("_row")), model)
    return scored.filter("predicted = 1").select("_row.*")
