"""Toxicity grades by cumulative-link (proportional odds) regression.

P(grade >= j) = sigmoid(w.x - theta_j) with one weight vector w for all ordered
thresholds theta_1 < theta_2 < ...; x marks which words and which runs of six bytes
(parts of words, in any language) a text has, hashed to ``features`` columns. Columns
whose share among toxic sample texts is what chance gives get weight 0, which keeps
the fit sparse. The expected severity is the sum of P(grade >= j) over j.

The model is fitted on a sample of at most ``sample_rows`` labelled rows (L2-penalized
likelihood, limited-memory quasi-Newton steps); w is broadcast (``features`` numbers).
Every document is scored on its whole text, without a shuffle.

Where labels only say toxic or not, ``graded`` makes grades: 0 clean, 1 toxic, 2
toxic with more marker words than the median toxic text; markers are words that are
much more frequent among toxic sample texts.

Defined results: a null or empty text has no words and gets the severity of the
thresholds alone; no labelled rows, or one grade only, give severity 0 to all; repeated
rows are scored each; an empty table gives no rows; columns other than id and text
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockledger.llm.common import mix, word_bytes, word_hashes
from dockledger.llm.samples import labelled
from dockledger.session import cut_lineage


@dataclass(frozen=True)
class Ordinal:
    sample_rows: int = 6000
    features: int = 1 << 20
    least_texts: int = 5
    least_z: float = 4.0
    penalty: float = 0.3
    steps: int = 60
    flag: float = 0.5


PART = 6


def features_of(text: str | None, features: int) -> np.ndarray:
    """Distinct columns of a text's words (without punctuation at their ends) and of
    its runs of six bytes, white space being one space."""
    found = word_bytes(text)
    raw = np.frombuffer(b" " + b" ".join(found) + b" ", dtype=np.uint8).astype(np.uint64)
    parts = np.zeros(max(0, len(raw) - PART + 1) if found else 0, dtype=np.uint64)
    for i in range(PART):
        parts |= raw[i : i + len(parts)] << np.uint64(8 * i)
    whole = {w.strip(b".,;:!?()[]\"'") for w in found}
    whole.discard(b"")
    return np.unique(np.concatenate([mix(parts), word_hashes(whole)]) % np.uint64(features)).astype(np.int32)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    how: Ordinal

    def at_least(self, columns: np.ndarray) -> np.ndarray:
        """P(grade >= j) for each threshold."""
        if not len(self.thresholds):
            return np.zeros(1)
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds - self.weights[columns].sum(), -60, 60)))


def graded(labels: np.ndarray, markers: np.ndarray) -> np.ndarray:
    """Grades 0, 1, 2 from labels 0 and 1 and each text's number of marker words."""
    y = np.clip(labels, 0, 1)
    if not y.any() or y.all():
        return y
    return y + ((y == 1) & (markers > np.median(markers[y == 1])))


def _minimize(f, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with backtracking; ``f`` gives value and
    gradient."""
    value, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, alphas = -g, []
        for s, y in reversed(past):
            a = s @ d / (s @ y)
            alphas.append(a)
            d = d - a * y
        if past:
            s, y = past[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(alphas), strict=True):
            d = d + s * (a - y @ d / (s @ y))
        slope, rate = g @ d, 1.0 if past else 1.0 / max(1.0, np.abs(g).sum())
        while True:
            new, grad = f(x + rate * d)
            if new <= value + 1e-4 * rate * slope or rate < 1e-12:
                break
            rate /= 2
        s, y = rate * d, grad - g
        if s @ y > 1e-12:
            past = [*past[-(memory - 1) :], (s, y)]
        done = value - new < 1e-7 * max(1.0, abs(value))
        x, value, g = x + s, new, grad
        if done:
            break
    return x


def telling(sample: list[tuple[np.ndarray, int]], how: Ordinal) -> np.ndarray:
    """Columns whose number of texts above the lowest grade is far from its expectation
    (``least_z`` standard deviations, ``least_texts`` texts)."""
    low = min(g for _, g in sample)
    every, high = (np.zeros(how.features) for _ in range(2))
    for c, g in sample:
        every[c] += 1
        high[c] += g > low
    share = sum(g > low for _, g in sample) / len(sample)
    z = (high - every * share) / np.sqrt(np.maximum(every * share * (1 - share), 1e-9))
    return (np.abs(z) >= how.least_z) & (every >= how.least_texts)


def fit_rows(sample: list[tuple[np.ndarray, int]], how: Ordinal) -> Model:
    """``sample`` holds (columns, grade). Grades that do not occur have no threshold."""
    kinds, y = np.unique([g for _, g in sample], return_inverse=True)
    levels = len(kinds) - 1
    if levels < 1:
        return Model(np.zeros(how.features), np.zeros(0), how)
    keep = telling(sample, how)
    chosen = [c[keep[c]] for c, _ in sample]
    columns = np.concatenate(chosen)
    row = np.repeat(np.arange(len(sample)), [len(c) for c in chosen])
    used, at = np.unique(columns, return_inverse=True)
    share = np.array([(y >= j).mean() for j in range(1, levels + 1)])

    def unpack(x: np.ndarray) -> np.ndarray:
        # The first threshold is free, the gaps to the next are positive.
        return np.cumsum(np.concatenate([x[:1], np.exp(x[1:levels])]))

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        theta, w = unpack(x), x[levels:]
        z = np.bincount(row, w[at], minlength=len(y))
        upper = np.concatenate([[-np.inf], theta, [np.inf]])
        s = 1.0 / (1.0 + np.exp(np.clip(upper[None, :] - z[:, None], -60, 60)))  # P(grade >= j), j = 0 .. levels + 1
        s[:, 0], s[:, -1] = 1.0, 0.0
        i = np.arange(len(y))
        p = np.maximum(s[i, y] - s[i, y + 1], 1e-12)
        ds = s * (1 - s)
        gz = -(ds[i, y] - ds[i, y + 1]) / p
        gt = np.array([np.sum(np.where(y == j, ds[:, j] / p, 0.0)) - np.sum(np.where(y == j - 1, ds[:, j] / p, 0.0)) for j in range(1, levels + 1)])
        back = np.cumsum(gt[::-1])[::-1] * np.concatenate([[1.0], np.exp(x[1:levels])])
        gw = np.bincount(at, gz[row], minlength=len(used)) + how.penalty * w
        return float(-np.log(p).sum() + 0.5 * how.penalty * w @ w), np.concatenate([back, gw])

    start = -np.log(share / (1 - share))
    x0 = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-3)), np.zeros(len(used))])
    x = _minimize(loss, x0, how.steps)
    weights = np.zeros(how.features, dtype=np.float32)
    weights[used] = x[levels:]
    return Model(weights, unpack(x), how)


def fit(docs: DataFrame, labels: DataFrame, how: Ordinal = Ordinal(), target: str = "toxic") -> Model:
    """The sample's columns are counted in Spark. To the driver come, for at most
    ``sample_rows`` texts, only the columns that tell toxic from clean, however long the
    texts are."""
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("columns", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features_of(t.as_py(), how.features) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], schema=schema)

    sample = labelled(docs, labels, target, how.sample_rows).select("doc_id", "label", "text")
    rows = cut_lineage(sample.mapInArrow(run, "doc_id long, label int, columns array<int>"))
    n, least, most = rows.agg(F.count("*"), F.min("label"), F.max("label")).first()
    if not n:
        return Model(np.zeros(how.features), np.zeros(0), how)
    binary = most <= 1
    high = F.col("label") > (F.lit(0) if binary else F.lit(least))
    share = rows.agg(F.avg(high.cast("int"))).first()[0]
    pairs = rows.select("doc_id", high.cast("long").alias("high"), F.explode("columns").alias("column"))
    counts = pairs.groupBy("column").agg(F.count("*").alias("n"), F.sum("high").alias("high"))
    # a little wider than telling(), which decides; markers are counted, not collected
    z = F.abs(F.col("high") - F.col("n") * share) / F.sqrt(F.greatest(F.col("n") * (share * (1 - share)), F.lit(1e-9)))
    told = (z >= how.least_z - 1e-6) & (F.col("n") >= how.least_texts)
    marker = (F.col("high") >= 5) & (F.col("high") > 5 * share * F.col("n"))
    chosen = counts.select("column", told.alias("told"), marker.alias("marker")).filter("told OR marker")
    own = pairs.join(chosen, "column").groupBy("doc_id").agg(F.collect_list(F.when(F.col("told"), F.col("column"))).alias("columns"), F.count_if("marker").alias("markers"))
    got = sorted(rows.select("doc_id", "label").join(own, "doc_id", "left").collect(), key=lambda r: r.doc_id)
    found = [np.sort(np.array(r.columns or [], dtype=np.int32)) for r in got]
    y = np.array([r.label for r in got])
    grades = graded(y, np.array([r.markers or 0 for r in got])) if binary else y
    return fit_rows([(c, int(g)) for c, g in zip(found, grades, strict=True)], how)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``severity`` (expected grade), ``p_toxic``, ``grade`` (likeliest) and
    ``toxic`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            p = [m.at_least(features_of(t.as_py(), m.how.features)) for t in batch.column(1)]
            severity = np.array([x.sum() for x in p], dtype=np.float64)
            first = np.array([x[0] for x in p], dtype=np.float64)
            grade = np.array([np.argmax(-np.diff(np.concatenate([[1.0], x, [0.0]]))) for x in p], dtype=np.int32)
            columns = [batch.column(0), pa.array(severity), pa.array(first), pa.array(grade), pa.array(first >= m.how.flag, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "severity", "p_toxic", "grade", "toxic"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return given.mapInArrow(run, "doc_id long, severity double, p_toxic double, grade int, toxic boolean")
