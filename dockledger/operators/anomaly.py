"""Isolation forest over market groups."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockledger.functions import columns as fx
from dockledger.functions.stats import scalars

# Workers get the helpers below with the task, wherever the package is installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows drawn per tree: part of the method, not a cap on what is scored.
SAMPLE_ROWS = 256
MIN_ROWS, MIN_FEATURES = 20, 3
# What an unusual market shows in.
ANOMALY_FEATURES = [
    "actual_median_cps",
    "pred_p50",
    "model_residual_pct",
    "zero_rate",
    "norm_sensitivity_abs_pct",
    "paid_records",
    "median_distance",
    "median_route_stop_count",
    "median_route_tote_count",
]
TREE_SCHEMA = "tree int, feature array<int>, threshold array<double>, left array<int>, right array<int>, size array<int>, drawn int"


def expected_depth(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, dtype="float64")
    safe = np.maximum(n, 2.0)
    depth = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, depth))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread evenly (the SplitMix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grow(points: np.ndarray, rng: np.random.Generator) -> dict[str, list]:
    """Random splits until points are alone, equal or deep enough."""
    nodes: dict[str, list] = {"feature": [], "threshold": [], "left": [], "right": [], "size": []}
    limit = int(np.ceil(np.log2(max(len(points), 2))))

    def add(rows: np.ndarray, depth: int) -> int:
        at = len(nodes["size"])
        for name, value in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("size", len(rows))):
            nodes[name].append(value)
        spread = np.ptp(points[rows], axis=0) if len(rows) > 1 else np.zeros(points.shape[1])
        usable = np.flatnonzero(spread > 0)
        if depth >= limit or len(usable) == 0:
            return at
        f = int(rng.choice(usable))
        values = points[rows, f]
        cut = float(rng.uniform(values.min(), values.max()))
        below = values <= cut
        if below.all():  # the draw hit the largest value
            below = values < values.max()
            cut = float(values[below].max())
        nodes["feature"][at], nodes["threshold"][at] = f, cut
        nodes["left"][at] = add(rows[below], depth + 1)
        nodes["right"][at] = add(rows[~below], depth + 1)
        return at

    add(np.arange(len(points)), 0)
    return nodes


def _filled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``vec`` with missing values at the column median (0 for an empty column)."""
    clean = df.withColumns({f"__f{i}": fx.finite(F.col(c).cast("double")) for i, c in enumerate(features)})
    names = [f"__f{i}" for i in range(len(features))]
    # one row per market group, so the plain median will do
    medians = scalars(clean, **{n: F.median(n) for n in names})
    vector = F.array(*[F.coalesce(F.col(n), medians[n], F.lit(0.0)) for n in names])
    return clean.withColumn("__vec", vector).drop(*names)


def isolation_score(
    df: DataFrame, keys: Sequence[str], features: Sequence[str] = ANOMALY_FEATURES, trees: int = 100, seed: int = 42
) -> DataFrame:
    """``anomaly_score`` in (0, 1), higher for rows that are easy to isolate.

    Each tree draws the rows with the smallest of its own hashes: every task reads its
    rows once and offers, for all trees, those below a threshold. Trees are grown in
    parallel, and the forest (at most ``trees * 511`` nodes) is sent to the tasks that
    score the rows. With fewer than 20 rows or 3 features the score is null.
    """
    present = [c for c in features if c in df.columns]
    if len(present) < MIN_FEATURES:
        return df.withColumn("anomaly_score", F.lit(None).cast("double"))
    rows = _filled(df, present)
    total = rows.agg(F.count(F.lit(1))).scalar()
    offered = rows.select(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)).alias("hash"), total.alias("n"), F.col("__vec").alias("vec"))

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each tree's draw for each row; somewhat more rows than it needs pass, so that
        a tree meets about as many rows as it keeps, however large the table is."""
        for batch in batches:
            if not batch.num_rows:
                continue
            own, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1)[0].as_py()
            if n < MIN_ROWS:
                continue
            most = np.uint64(min(1.0, SAMPLE_ROWS * 1.5 / n) * (2.0**53))
            for t in range(trees):
                draw = _mixed(own ^ _mixed(np.array([t + 1], dtype=np.uint64))) >> np.uint64(11)
                at = np.flatnonzero(draw <= most)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(draw[at].astype(np.int64)), batch.column(2).take(pa.array(at))], names=["tree", "draw", "vec"])

    drawn = offered.mapInArrow(offer, "tree int, draw long, vec array<double>")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        kept = sorted(zip(pdf["draw"], map(tuple, pdf["vec"])))[:SAMPLE_ROWS]
        points = np.array(sorted(v for _, v in kept), dtype="float64")
        nodes = _grow(points, np.random.default_rng([seed, t]))
        return pd.DataFrame([{"tree": t, **nodes, "drawn": len(points)}])

    forest = [
        (*[np.array(r[c]) for c in ("feature", "threshold", "left", "right", "size")], r["drawn"])
        for r in drawn.groupBy("tree").applyInPandas(grow, TREE_SCHEMA).orderBy("tree").collect()
    ]
    if not forest:
        return df.withColumn("anomaly_score", F.lit(None).cast("double"))
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(vectors: pd.Series) -> pd.Series:
        points = np.array(vectors.tolist(), dtype="float64").reshape(len(vectors), -1)
        depth = np.zeros(len(points))
        norm = 0.0
        for feature, threshold, left, right, size, n in shared.value:
            at = np.zeros(len(points), dtype="int64")
            steps = np.zeros(len(points))
            inner = feature[at] >= 0
            while inner.any():
                node = at[inner]
                go_left = points[inner, feature[node]] <= threshold[node]
                at[inner] = np.where(go_left, left[node], right[node])
                steps[inner] += 1
                inner = feature[at] >= 0
            depth += steps + expected_depth(size[at])
            norm += float(expected_depth(np.array([n]))[0])
        return pd.Series(np.power(2.0, -depth / norm))

    return rows.withColumn("anomaly_score", score("__vec")).drop("__vec")


def anomaly_flag(scored: DataFrame, p: float = 0.90) -> DataFrame:
    """Score at or above its P90."""
    cut = scored.agg(F.percentile("anomaly_score", F.lit(p))).scalar()
    return scored.withColumn("anomaly_flag", fx.is_true(F.col("anomaly_score") >= cut))
