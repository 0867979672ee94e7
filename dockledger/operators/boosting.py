"""Gradient-boosted quantile regression by histograms (M2-M7).

Spark's own boosted trees know squared and absolute loss only. Here trees grow on
histograms of byte codes (``histogram_trees``), the quantiles side by side in tasks of
their own. Only the model passes through the driver; scoring covers all rows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dockledger.functions import columns as fx
from dockledger.functions.stats import join_back, scalars, with_before
from dockledger.operators import histogram_trees as ht
from dockledger.session import cut_lineage

# Workers get the helpers below with the task, wherever the package is installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

THREE_QUANTILES = (0.10, 0.50, 0.90)
FIVE_QUANTILES = (0.10, 0.25, 0.50, 0.75, 0.90)


def band_name(q: float) -> str:
    return f"pred_p{round(q * 100):02d}"


# ---- preparation ------------------------------------------------------------


@dataclass
class Encoder:
    """M2: medians for numbers, most frequent value and ordinal code for text."""

    numeric: Sequence[str]
    categorical: Sequence[str]
    medians: Column | None = None
    modes: dict[str, Column] = field(default_factory=dict)
    codes: dict[str, DataFrame] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        """Fill and encode; a value unseen in training gets code -1. The inputs
        stay, the features are named ``x_<column>``."""
        for c in self.categorical:
            filled = df.withColumn("__value", F.coalesce(F.col(c), self.modes[c]))
            df = join_back(filled, self.codes[c], ["__value"], null_safe=False).drop("__value")
            df = df.withColumn(f"x_{c}", F.coalesce(F.col(f"__code_{c}"), F.lit(-1.0))).drop(f"__code_{c}")
        return df.withColumns(
            {
                f"x_{c}": F.coalesce(F.col(c).cast("double"), self.medians[c], F.lit(0.0))
                for c in self.numeric
            }
        )

    @property
    def features(self) -> list[str]:
        return [f"x_{c}" for c in (*self.numeric, *self.categorical)]


def fit_encoder(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> Encoder:
    """``train`` is one row per market group or the row model's sample: small
    enough for plain medians."""
    encoder = Encoder(list(numeric), list(categorical))
    if numeric:
        encoder.medians = scalars(train, **{c: F.median(c) for c in numeric})
    for c in categorical:
        seen = train.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("__value")).agg(F.count(F.lit(1)).alias("n"))
        # ties go to the alphabetically first value; one row per category
        encoder.modes[c] = seen.agg(F.min_by("__value", F.struct(-F.col("n"), "__value"))).scalar()
        numbered = with_before(seen.select("__value"), [], "__value", F.lit(1))
        # written, as Spark would shuffle all rows to meet a table whose size it does not know
        encoder.codes[c] = cut_lineage(numbered.select("__value", F.col("before").cast("double").alias(f"__code_{c}")))
    return encoder


def impute_encode(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    return fit_encoder(df, numeric, categorical).apply(df)


def train_test_split(df: DataFrame, keys: Sequence[str], test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """M3: ``is_test`` by a hash of the key, the same on any partitioning."""
    name = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    bucket = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("bigint") % 10000
    return df.withColumn("is_test", bucket < round(test_share * 10000))


def row_model_sample(
    rows: DataFrame, keys: Sequence[str], max_rows: int | None = 90_000, seed: int = 42, cost: str = "cost_per_stop"
) -> DataFrame:
    """M5: paid rows for the row-level model, a fixed-size random sample of them.

    ``max_rows`` is the size of the sample the model is meant to see; None takes
    all. A hash threshold thins the rows out where they are read, so that only
    about ``max_rows`` are sorted for the exact cut.
    """
    paid = rows.filter(F.col(cost) > 0).withColumns({"target": F.log1p(cost), "weight": F.lit(1.0)})
    if max_rows is None:
        return paid
    total = paid.agg(F.count(F.lit(1))).scalar()
    draw = F.xxhash64(*[F.col(k) for k in keys], F.lit(seed))
    # hash mapped to [0, 1); 20 % and 1,000 rows of slack around the expected size
    position = F.pmod(draw, F.lit(1 << 40)) / F.lit(float(1 << 40))
    thinned = paid.withColumn("__draw", draw).filter(position * total <= max_rows * 1.2 + 1000)
    return thinned.orderBy("__draw", *keys).limit(max_rows).drop("__draw")


# ---- model ------------------------------------------------------------------

MOST_BINS = 255
MOST_ROWS = 90_000


@dataclass
class QuantileBoost:
    """M4: value cuts of each feature, start value and trees of each quantile."""

    features: list[str]
    cuts: list[np.ndarray]
    start: dict[float, float]
    trees: dict[float, list[ht.Tree]]

    def codes(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(c, np.asarray(x, dtype=np.float64), side="left") for c, x in zip(self.cuts, columns, strict=True)])

    def ensemble(self) -> ht.Ensemble:
        return ht.Ensemble([len(c) + 1 for c in self.cuts], list(self.start.values()), list(self.trees.values()))

    def predict(self, df: DataFrame) -> DataFrame:
        """``pred_pNN`` on the training scale for each quantile: one vectorized function
        over the flattened trees, whatever the number of rounds."""
        names = [band_name(q) for q in self.start]
        shared = df.sparkSession.sparkContext.broadcast((self.codes, self.ensemble()))

        @F.pandas_udf(", ".join(f"{n} double" for n in names))
        def bands(*columns: pd.Series) -> pd.DataFrame:
            codes, trees = shared.value
            return pd.DataFrame(trees.scores(codes([c.to_numpy(dtype=np.float64) for c in columns])), columns=names)

        scored = df.withColumn("__bands", bands(*[F.col(c).cast("double") for c in self.features]))
        return scored.select(*df.columns, *[F.col("__bands")[n].alias(n) for n in names])


def value_cuts(train: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """At most ``MOST_BINS`` - 1 values of each feature, evenly spread over its rows: all
    of them but the largest where there are that few. A mergeable sketch of fixed size."""
    probs = F.array(*[F.lit(i / MOST_BINS) for i in range(1, MOST_BINS)])
    found = train.agg(*[F.percentile_approx(F.col(c).cast("double"), probs, 20_000).alias(f"c{i}") for i, c in enumerate(features)], *[F.max(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(features)]).first()
    return [np.array(sorted({v for v in found[f"c{i}"] or [] if v < found[f"m{i}"]})) for i in range(len(features))]


_TREE = pa.schema([("round", pa.int32()), ("quantile", pa.int32()), *[(c, pa.list_(pa.int64())) for c in ("feature", "bin", "left", "right")], ("value", pa.list_(pa.float64()))])


def fit_quantile_boost(
    train: DataFrame,
    features: Sequence[str],
    quantiles: Sequence[float] = THREE_QUANTILES,
    rounds: int = 160,
    rate: float = 0.06,
    leaves: int = 31,
    depth: int | None = None,
    min_leaf: int = 20,
    l2: float = 0.05,
    max_rows: int = MOST_ROWS,
) -> QuantileBoost:
    """Fit on columns ``target``, ``weight`` and the feature columns.

    The model is defined on at most ``max_rows`` rows (the row-level model's sample, or
    one row per market group); of a larger table those with the smallest hash. They are
    binned to one byte a value, so a task holds ``max_rows`` times the number of features
    in bytes. The quantiles do not depend on each other and are fitted in a task each,
    which runs all rounds: a round needs about ten sums over all rows one after the
    other, and these are cheaper in memory than as ten exchanges of a cluster.
    """
    quantiles, how = list(quantiles), ht.Growth(leaves, depth, min_leaf, l2)
    named = train.select(F.col("target").cast("double"), F.col("weight").cast("double"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    count = named.count()
    if not count:
        raise ValueError("no rows to learn from")
    if count > max_rows:
        named = named.orderBy(F.xxhash64(*named.columns)).limit(max_rows)
    model = QuantileBoost(list(features), value_cuts(named, [f"x{i}" for i in range(len(features))]), {}, {q: [] for q in quantiles})
    step = _training(model, quantiles, how, rate, rounds)
    each = F.explode(F.array(*[F.lit(k) for k in range(len(quantiles))])).alias("quantile")
    # the order of the rows decides the last bits of sums: it is fixed
    dealt = named.select(each, "*").repartitionByRange(len(quantiles), "quantile").sortWithinPartitions("quantile", *named.columns)
    for r in sorted(dealt.mapInArrow(step, "round int, quantile int, feature array<long>, bin array<long>, left array<long>, right array<long>, value array<double>").collect(), key=lambda r: (r["round"], r["quantile"])):
        q = quantiles[r["quantile"]]
        if r["round"] < 0:
            model.start[q] = r["value"][0]
        else:
            model.trees[q].append(ht.Tree(*[np.array(r[c]) for c in ("feature", "bin", "left", "right", "value")]))
    return model


def _training(model: QuantileBoost, quantiles: list[float], how: ht.Growth, rate: float, rounds: int) -> Callable:
    bins = [len(c) + 1 for c in model.cuts]

    def fit(k: int, codes: np.ndarray, target: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
        rows = ht.Rows(codes, bins, target, weight)
        start = ht.group_values(target, weight, np.zeros(len(target), dtype=np.int64), 1, quantiles[k])
        score = np.full(len(target), start[0])
        out = [(-1, k, [], [], [], [], start.tolist())]
        for i in range(rounds):
            t = ht.boost(rows, quantiles[k], score, how, rate)
            out.append((i, k, *[a.tolist() for a in (t.feature, t.bin, t.left, t.right, t.value)]))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _TREE, strict=True)], schema=_TREE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in batches:
            which = batch.column(0).to_numpy()
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
            codes = model.codes(columns[2:]).astype(np.uint8)
            for k in np.unique(which).tolist():
                own = which == k
                parts.setdefault(k, []).append((codes[:, own], columns[0][own], columns[1][own]))
        for k, got in parts.items():
            yield fit(k, np.concatenate([g[0] for g in got], axis=1), *[np.concatenate([g[i] for g in got]) for i in (1, 2)])

    return run


# ---- use --------------------------------------------------------------------

# The features of the row-level model, those of them that are present.
ROW_NUMERIC = [
    "route_stop_count", "route_tote_count", "stop_count", "tote_count", "route_count", "distance",
    "geography_multiplier", "shipment_multiplier", "density_multiplier", "geo_mean", "year", "month",
]
ROW_CATEGORICAL = ["dc", "carrier_cd", "delivery_type", "charge_type", "charge_description"]
MIN_TRAINING_ROWS = 200


def row_features(rows: DataFrame) -> tuple[list[str], list[str]]:
    return [c for c in ROW_NUMERIC if c in rows.columns], [c for c in ROW_CATEGORICAL if c in rows.columns]


def bands_in_cost(df: DataFrame, bands: Sequence[str], eligible: Column) -> DataFrame:
    """Log-scale bands as cost, never negative, null where a row is not eligible."""
    return df.withColumns({b: F.when(eligible, F.greatest(F.lit(0.0), F.expm1(b))) for b in bands})


def score_bands(df: DataFrame, model: QuantileBoost, actual: str = "actual_median_cps") -> DataFrame:
    """M7: predictions as cost, never negative, only where there is a cost."""
    return bands_in_cost(model.predict(df), [band_name(q) for q in model.start], F.col(actual) > 0)


def model_metrics(predicted: DataFrame, expected: str = "pred_p50") -> DataFrame:
    """M6: errors in dollars and fit on the log scale, over rows with ``target``
    and a log-scale prediction."""
    cost, guess = F.expm1("target"), F.greatest(F.lit(0.0), F.expm1(expected))
    errors = predicted.withColumns({"__error": F.abs(cost - guess), "__squared": F.pow(F.col("target") - F.col(expected), F.lit(2.0))})
    return errors.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("__error").alias("mae_cost"),
        F.median("__error").alias("median_abs_error_cost"),
        (1.0 - fx.safe_div(F.sum("__squared"), F.var_pop("target") * F.count(F.lit(1)))).alias("r2_log_target"),
    )


def model_report(metrics: DataFrame | None, spark: SparkSession, status: str, **counts: int) -> DataFrame:
    """One row: ``model_status``, counts, and the hold-out errors (null without any)."""
    known = spark.range(1).select(F.lit(status).alias("model_status"), *[F.lit(v).cast("long").alias(c) for c, v in counts.items()])
    errors = ["mae_cost", "median_abs_error_cost", "r2_log_target"]
    if metrics is None:
        return known.withColumns({c: F.lit(None).cast("double") for c in errors})
    return known.join(metrics.select(*errors), F.lit(True))


@dataclass(frozen=True)
class RowModel:
    encoder: Encoder
    model: QuantileBoost
    report: DataFrame


def fit_row_model(
    rows: DataFrame, keys: Sequence[str], cost: str = "cost_per_stop", quantiles: Sequence[float] = FIVE_QUANTILES,
    rounds: int = 240, max_rows: int = MOST_ROWS, min_rows: int = MIN_TRAINING_ROWS, test_share: float = 0.2, **boost: object,
) -> RowModel:
    """M5: the row-level model of paid rows, identified by ``keys``.

    It sees a sample of at most ``max_rows`` of them and keeps a share of it from
    training; the report tells how far off it is on those. Fewer than ``min_rows`` paid
    rows, or no feature, are an error."""
    numeric, categorical = row_features(rows)
    if not numeric and not categorical:
        raise ValueError("no usable model features")
    paid = rows.filter(F.col(cost) > 0).count()
    if paid < min_rows:
        raise ValueError(f"{paid} paid rows; a model needs {min_rows}")
    sample = cut_lineage(train_test_split(row_model_sample(rows, keys, max_rows, cost=cost), keys, test_share))
    encoder = fit_encoder(sample.filter(~F.col("is_test")), numeric, categorical)
    data = cut_lineage(encoder.apply(sample).select("is_test", "target", "weight", *encoder.features))
    model = fit_quantile_boost(data.filter(~F.col("is_test")), encoder.features, quantiles, rounds, max_rows=max_rows, **boost)
    metrics = model_metrics(model.predict(data.filter("is_test")))
    report = model_report(metrics, rows.sparkSession, "model", paid_rows_total=paid, model_rows_used=data.count(), feature_count=len(encoder.features))
    return RowModel(encoder, model, report)


def score_rows(rows: DataFrame, fitted: RowModel, cost: str = "cost_per_stop") -> DataFrame:
    """Every row with its bands, in order; rows without a cost or any feature have none."""
    known = fx.is_true(F.col(cost) > 0) & F.coalesce(*[F.col(c).cast("string") for c in (*fitted.encoder.numeric, *fitted.encoder.categorical)]).isNotNull()
    banded = fitted.model.predict(fitted.encoder.apply(rows)).drop(*fitted.encoder.features)
    return bands_in_cost(banded, [band_name(q) for q in fitted.model.start], known)
