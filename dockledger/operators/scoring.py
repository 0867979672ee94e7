"""Bands, sensitivities, confidence, classes and the business view."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockledger.functions import columns as fx
from dockledger.functions.stats import scalars
from dockledger.operators.rollups import DRIVERS

# Class names, confidence levels and notes.
NORMAL = "Normal / inside expected band"
STRONG_OVER = "Strong overpay candidate"
POSSIBLE_OVER = "Possible overpay"
STRONG_UNDER = "Strong underpay candidate"
POSSIBLE_UNDER = "Possible underpay"
NO_EVIDENCE = "Not enough evidence"
NOTE_HIGH = "Model and cleansheet both point high"
NOTE_LOW = "Model and cleansheet both point low"
NOTE_WEAK = "Low volume, high zero rate, or weak basis"
NOTE_SENSITIVE = "Sensitive to normalization and cleansheet assumptions"
NOTE_MODEL = "Model-based residual signal"

BANDS = {"pred_p10": 0.10, "pred_p25": 0.25, "pred_p50": 0.50, "pred_p75": 0.75, "pred_p90": 0.90}


@dataclass(frozen=True)
class Thresholds:
    """Scorecard settings; the defaults are those of the scorecard screen."""

    min_group_n: int = 30
    overpay_strong: float = 0.20
    overpay_possible: float = 0.10
    underpay_strong: float = -0.20
    underpay_possible: float = -0.10
    five_bands: bool = False
    max_zero_rate: float = 0.35
    max_sensitivity: float = 0.40


# Group features: counts, and the medians of the drivers that are no cost to be explained.
NUMERIC_FEATURES = ["paid_records", "records", "zero_rate", "paid_rate"] + [
    f"median_{c}" for c in DRIVERS if not c.startswith(("normalized_", "benchmark_"))
]
# Categories that may be features.
CATEGORICAL_FEATURES = ["xdock", "carrier_cd", "fill_dc"]


def eligible(t: Thresholds) -> Column:
    return fx.is_true((F.col("actual_median_cps") > 0) & (F.col("paid_records") >= t.min_group_n))


def model_groups(markets: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """M1: groups the model learns from, with log target and weight."""
    return markets.filter(eligible(t)).withColumns(
        {
            "target": F.log1p("actual_median_cps"),
            "weight": F.sqrt(F.greatest(F.col("paid_records"), F.lit(1)).cast("double")),
        }
    )


def feature_columns(markets: DataFrame, keys: Sequence[str]) -> tuple[list[str], list[str]]:
    """Numeric features present, and those categories that are grouping keys."""
    return (
        [c for c in NUMERIC_FEATURES if c in markets.columns],
        [c for c in CATEGORICAL_FEATURES if c in markets.columns and c in keys],
    )


def benchmark_bands(markets: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """M9: the same bands for every group, quantiles of the eligible medians.

    Without any eligible group the quantiles are over all groups.
    """
    ok = F.when(eligible(t), F.col("actual_median_cps"))
    s = scalars(
        markets,
        **{n: F.coalesce(F.percentile(ok, F.lit(p)), F.percentile("actual_median_cps", F.lit(p))) for n, p in BANDS.items()},
    )
    wanted = BANDS if t.five_bands else {n: p for n, p in BANDS.items() if n not in ("pred_p25", "pred_p75")}
    return markets.withColumns({n: s[n] if n in wanted else F.lit(None).cast("double") for n in BANDS})


def monotone_bands(df: DataFrame, bands: Sequence[str]) -> DataFrame:
    """M8: the bands of each row in ascending order, nulls last."""
    ordered = df.withColumn("__bands", F.array_sort(F.array(*bands)))
    return ordered.withColumns({b: F.get("__bands", F.lit(i)) for i, b in enumerate(bands)}).drop("__bands")


def residuals(df: DataFrame, actual: str = "actual_median_cps", expected: str = "pred_p50", prefix: str = "model") -> DataFrame:
    """Gap to the expected cost, absolute and relative."""
    return df.withColumns(
        {
            f"{prefix}_residual": F.col(actual) - F.col(expected),
            f"{prefix}_residual_pct": fx.ratio_gap(actual, expected),
        }
    )


def _or_null(df: DataFrame, column: str) -> Column:
    return F.col(column) if column in df.columns else F.lit(None).cast("double")


def _mean_of_available(a: Column, b: Column) -> Column:
    present = a.isNotNull().cast("int") + b.isNotNull().cast("int")
    return fx.safe_div(F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)), present)


def sensitivities(df: DataFrame) -> DataFrame:
    """How much normalization and benchmark move the picture."""
    actual = F.col("actual_median_cps")
    low, high = _or_null(df, "median_benchmark_conservative"), _or_null(df, "median_benchmark_aggressive")
    out = df.withColumns(
        {
            "normalization_sensitivity_pct": fx.ratio_gap(_or_null(df, "median_normalized_cost"), actual),
            "conservative_gap_pct": fx.ratio_gap(actual, low),
            "aggressive_gap_pct": fx.ratio_gap(actual, high),
            "benchmark_mid_cost": (low + high) / 2.0,
            "benchmark_spread_pct": F.abs(fx.ratio_gap(high, low)),
        }
    )
    out = out.withColumns(
        {
            "norm_sensitivity_abs_pct": F.abs("normalization_sensitivity_pct"),
            "benchmark_sensitivity_abs_pct": F.abs(fx.ratio_gap("benchmark_mid_cost", "actual_median_cps")),
        }
    )
    return out.withColumn(
        "combined_sensitivity_abs_pct",
        _mean_of_available(F.col("norm_sensitivity_abs_pct"), F.col("benchmark_sensitivity_abs_pct")),
    )


def confidence(df: DataFrame, t: Thresholds = Thresholds(), sensitivity: str = "combined_sensitivity_abs_pct") -> DataFrame:
    """0-4 points. ``sensitivity='norm_sensitivity_abs_pct'`` is the older rule."""
    points = [
        F.col("paid_records") >= t.min_group_n,
        F.col("paid_records") >= t.min_group_n * 3,
        F.col("zero_rate") <= t.max_zero_rate,
        F.coalesce(F.col(sensitivity), F.lit(0.0)) <= t.max_sensitivity,
    ]
    score = sum((fx.is_true(p).cast("int") for p in points), F.lit(0))
    level = (
        F.when(F.col("confidence_score") >= 4, "High")
        .when(F.col("confidence_score") == 3, "Medium")
        .when(F.col("confidence_score") == 2, "Low")
        .otherwise("Very Low")
    )
    return df.withColumn("confidence_score", score).withColumn("confidence", level)


def classification(df: DataFrame, t: Thresholds = Thresholds(), test_nulls: bool = True) -> DataFrame:
    """One of six classes. The row-level scorecard used ``five_bands`` and
    ``test_nulls=False``."""
    actual, gap = F.col("actual_median_cps"), F.col("model_residual_pct")
    trusted = F.col("confidence").isin("High", "Medium")
    weak = (F.col("paid_records") < t.min_group_n) | (F.col("confidence") == "Very Low")
    if test_nulls:
        weak = weak | actual.isNull() | F.col("pred_p50").isNull()
    over, under = gap >= t.overpay_possible, gap <= t.underpay_possible
    if t.five_bands:
        over, under = over & (actual > F.col("pred_p75")), under & (actual < F.col("pred_p25"))
    label = (
        F.when(weak, NO_EVIDENCE)
        .when((gap <= t.underpay_strong) & (actual < F.col("pred_p10")) & trusted, STRONG_UNDER)
        .when((gap >= t.overpay_strong) & (actual > F.col("pred_p90")) & trusted, STRONG_OVER)
        .when(over, POSSIBLE_OVER)
        .when(under, POSSIBLE_UNDER)
        .otherwise(NORMAL)
    )
    return df.withColumn("classification", label)


def support_note(
    df: DataFrame, t: Thresholds = Thresholds(), sensitivity: str = "combined_sensitivity_abs_pct"
) -> DataFrame:
    """Does the benchmark agree, and the first note that applies."""
    out = df.withColumns(
        {
            "overpay_support": fx.is_true(F.col("aggressive_gap_pct") > 0),
            "underpay_support": fx.is_true(F.col("conservative_gap_pct") < 0),
        }
    )
    text = F.lower("classification")
    note = (
        F.when(text.contains("overpay") & F.col("overpay_support"), NOTE_HIGH)
        .when(text.contains("underpay") & F.col("underpay_support"), NOTE_LOW)
        .when(F.col("classification") == NO_EVIDENCE, NOTE_WEAK)
        .when(F.coalesce(F.col(sensitivity), F.lit(0.0)) > t.max_sensitivity, NOTE_SENSITIVE)
        .otherwise(NOTE_MODEL)
    )
    return out.withColumn("business_note", note)


def score_markets(banded: DataFrame, keys: Sequence[str], t: Thresholds = Thresholds()) -> DataFrame:
    """M10-M14 on groups that carry bands, plus market id, name and carrier."""
    out = support_note(classification(confidence(sensitivities(residuals(banded)), t), t), t)
    market = "xdock" if "xdock" in out.columns else keys[0]
    carrier = F.col("carrier_cd") if "carrier_cd" in out.columns else F.lit("All carriers")
    return out.withColumns({"market_id": F.col(market), "market_name": fx.market_name(market), "carrier": carrier})


# Published column names of the scorecard, in display order.
BUSINESS_COLUMNS = {
    "Market / Xdock": "market_id",
    "Market Name": "market_name",
    "Carrier": "carrier",
    "Signal / Classification": "classification",
    "Confidence": "confidence",
    "Business Note": "business_note",
    "Total Records": "records",
    "Records With CPS": "paid_records",
    "Zero Cost Rate": "zero_rate",
    "Actual CPS": "actual_median_cps",
    "Expected CPS": "pred_p50",
    "Expected Low CPS P10": "pred_p10",
    "Expected High CPS P90": "pred_p90",
    "CPS Gap vs Expected": "model_residual",
    "CPS Gap vs Expected %": "model_residual_pct",
    "Normalized Cost": "median_normalized_cost",
    "Normalization Sensitivity": "norm_sensitivity_abs_pct",
    "Cleansheet Sensitivity": "benchmark_sensitivity_abs_pct",
    "Combined Sensitivity": "combined_sensitivity_abs_pct",
    "Cleansheet Conservative": "median_benchmark_conservative",
    "Cleansheet Aggressive": "median_benchmark_aggressive",
    "Gap vs Conservative Cleansheet %": "conservative_gap_pct",
    "Gap vs Aggressive Cleansheet %": "aggressive_gap_pct",
    "median_distance_val": "median_distance",
    "median_stop_count_val_route_lvl": "median_route_stop_count",
    "median_tote_count_val_route_lvl": "median_route_tote_count",
}


def business_view(scored: DataFrame) -> DataFrame:
    """The scorecard under its published names, in its published order."""
    present = {shown: c for shown, c in BUSINESS_COLUMNS.items() if c in scored.columns}
    ordered = scored.orderBy(F.asc("classification"), F.desc("model_residual_pct"), F.desc("paid_records"), "market_id", "carrier")
    return ordered.select(*[F.col(c).alias(shown) for shown, c in present.items()])
