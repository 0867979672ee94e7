"""Shipment and density multipliers, outlier removal, normalized cost."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dockledger.functions import columns as fx
from dockledger.functions.stats import group_quantiles, scalars

# The density multiplier enters the geometric mean twice.
GEO_MEAN_WEIGHTS = {"shipment_multiplier": 1, "density_multiplier": 2}


def shipment_multiplier(monthly: DataFrame, value: str = "daily_shipments") -> DataFrame:
    """Daily shipments of the dock-month over the median of all dock-months."""
    base = monthly.agg(F.median(value)).scalar()
    return monthly.withColumn("shipment_multiplier_raw", fx.safe_div(value, base))


def winsor_global(df: DataFrame, column: str, out: str, low: float = 0.10, high: float = 0.90) -> DataFrame:
    """Clip a dock-month column to its overall quantiles."""
    bounds = scalars(df, low=F.percentile(column, F.lit(low)), high=F.percentile(column, F.lit(high)))
    return df.withColumn(out, fx.clip(column, bounds["low"], bounds["high"]))


def density_multiplier(monthly: DataFrame, value: str = "avg_miles_per_stop") -> DataFrame:
    """Miles per stop over the median dock of the same month.

    The table has one row per dock and month, so a window holds one month's docks.
    """
    baseline = F.median(value).over(Window.partitionBy("year", "month"))
    return monthly.withColumn("baseline_miles_per_stop", baseline).withColumn(
        "density_multiplier_raw", fx.safe_div(value, "baseline_miles_per_stop")
    )


def winsor_monthly(df: DataFrame, column: str, out: str, low: float = 0.10, high: float = 0.90) -> DataFrame:
    """Clip a dock-month column to the quantiles of its month."""
    bounds = {f"__p{p}": F.percentile(column, F.lit(p)).over(Window.partitionBy("year", "month")) for p in (low, high)}
    clipped = fx.clip(column, F.col(f"`__p{low}`"), F.col(f"`__p{high}`"))
    return df.withColumns(bounds).withColumn(out, clipped).drop(*bounds)


def shipment_table(monthly: DataFrame) -> DataFrame:
    return winsor_global(shipment_multiplier(monthly), "shipment_multiplier_raw", "shipment_multiplier")


def density_table(monthly: DataFrame) -> DataFrame:
    return winsor_monthly(density_multiplier(monthly), "density_multiplier_raw", "density_multiplier")


def iqr_flag(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """``outlier`` is true outside Q1 - k*IQR .. Q3 + k*IQR of the whole table."""
    quartiles = group_quantiles(df, [], {"q1": (column, 0.25), "q3": (column, 0.75)})
    s = scalars(quartiles, q1=F.max("q1"), q3=F.max("q3"))
    spread = (s["q3"] - s["q1"]) * k
    outside = (F.col(column) < s["q1"] - spread) | (F.col(column) > s["q3"] + spread)
    return df.withColumn("outlier", fx.is_true(outside))


def iqr_filter(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Rows without outliers; nulls stay."""
    return iqr_flag(df, column, k).filter(~F.col("outlier")).drop("outlier")


def outlier_share(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """How many rows the filter removes and the range that remains."""
    kept = F.when(~F.col("outlier"), F.col(column))
    return iqr_flag(df, column, k).agg(
        F.count_if("outlier").alias("outliers"),
        F.count(F.lit(1)).alias("total"),
        (F.count_if("outlier") * 100.0 / F.count(F.lit(1))).alias("outlier_pct"),
        F.count_if(~F.col("outlier")).alias("remaining"),
        F.min(kept).alias("min_kept"),
        F.max(kept).alias("max_kept"),
    )


def geo_mean(df: DataFrame, weights: Mapping[str, int] = GEO_MEAN_WEIGHTS) -> DataFrame:
    """Weighted geometric mean of the multipliers."""
    product = F.lit(1.0)
    for column, weight in weights.items():
        for _ in range(weight):
            product = product * F.col(column)
    return df.withColumn("geo_mean", F.pow(product, F.lit(1.0 / sum(weights.values()))))


def normalized_costs(df: DataFrame, cost: str = "cost_per_stop") -> DataFrame:
    """Cost over the combined and over each single multiplier."""
    return df.withColumns(
        {
            "normalized_cost": fx.safe_div(cost, "geo_mean"),
            "normalized_cost_geography": fx.safe_div(cost, "geography_multiplier"),
            "normalized_cost_shipment": fx.safe_div(cost, "shipment_multiplier"),
            "normalized_cost_density": fx.safe_div(cost, "density_multiplier"),
        }
    )


def dc_baseline_gap(markets: DataFrame, value: str = "normalized_cost", baseline: str = "median") -> DataFrame:
    """Each market against the median or mean market of its fill DC."""
    center = {"median": F.median, "mean": F.avg}[baseline](value).over(Window.partitionBy("fill_dc"))
    gap = F.col("deviation")
    return (
        # a market without a fill DC has no baseline
        markets.withColumn("baseline", F.when(F.col("fill_dc").isNotNull(), center))
        .withColumn("deviation", F.col(value) - F.col("baseline"))
        .withColumn("deviation_pct", fx.safe_div("deviation", "baseline") * 100.0)
        .withColumn(
            "status",
            F.when(gap > 0, "Above baseline").when(gap < 0, "Below baseline").otherwise("At baseline"),
        )
    )


def row_sensitivity(df: DataFrame, cost: str = "cost_per_stop") -> DataFrame:
    """Per row, normalized over actual and actual over each benchmark."""
    return df.withColumns(
        {
            "normalization_ratio": fx.safe_div("normalized_cost", cost),
            "normalization_sensitivity_pct": fx.ratio_gap("normalized_cost", cost),
            "gap_vs_conservative_pct": fx.ratio_gap(cost, "benchmark_conservative"),
            "gap_vs_aggressive_pct": fx.ratio_gap(cost, "benchmark_aggressive"),
        }
    )
