"""The end-to-end dataflows: charge rows to normalized costs to scorecard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockledger.functions import columns as fx
from dockledger.operators import allocate, boosting, geography, lookups, multipliers, prepare, rollups
from dockledger.operators import scoring as sc
from dockledger.session import cut_lineage, settled


def allocated_costs(events: DataFrame, order_cols: Sequence[str], scope: str = "all") -> DataFrame:
    """Charge rows of the wanted codes -> rows with cost per stop."""
    return allocate.allocate_costs(prepare.filter_codes(events), order_cols, scope=scope)


def shipment_multipliers(shipments: DataFrame) -> DataFrame:
    """One row per dock-month. The counts are kept: the medians read them again."""
    monthly = rollups.avg_daily_shipments(rollups.daily_shipments(shipments))
    return multipliers.shipment_table(cut_lineage(monthly))


def conform_telemetry(telemetry: DataFrame) -> DataFrame:
    """Text fields of the telemetry feed -> distance, day, year, month."""
    # a column of its own: the reader of times tests it more than once
    plain = telemetry.withColumns({"distance": fx.numeric_text("distance_text"), "__time": fx.strip_zone("eta_start")})
    typed = plain.withColumn("eta", fx.parse_time("__time")).drop("__time")
    return typed.withColumns({"day": F.to_date("eta"), "year": F.year("eta"), "month": F.month("eta")})


def kept_telemetry(telemetry: DataFrame, codes: DataFrame) -> DataFrame:
    """Feed rows without distance outliers, with dock codes. The typed rows are written
    once: the quartiles and every later filter would parse the text again."""
    typed = cut_lineage(conform_telemetry(telemetry))
    return lookups.add_dock_code(multipliers.iqr_filter(typed, "distance"), codes)


def density_multipliers(telemetry: DataFrame, codes: DataFrame) -> DataFrame:
    days = rollups.dock_day_miles(rollups.route_day_distance(kept_telemetry(telemetry, codes)))
    return multipliers.density_table(rollups.dock_month_miles(days))


def normalized_rows(rows: DataFrame, geography_table: DataFrame, shipment_table: DataFrame, density_table: DataFrame) -> DataFrame:
    """Allocated rows with the three multipliers and the normalized costs.

    The multiplier tables have one row per dock and month; adaptive execution
    broadcasts them by the size they turn out to have."""
    out = rows
    for table, value, dock in (
        (geography_table, "geography_multiplier", "origin"),
        (shipment_table, "shipment_multiplier", "xdock"),
        (density_table, "density_multiplier", "xdock"),
    ):
        out = lookups.join_multiplier(out, table.select(dock, "year", "month", value), value, dock)
    return multipliers.normalized_costs(multipliers.geo_mean(out))


def geography_from(shipments: DataFrame, since: str | None = None) -> DataFrame:
    return geography.geography_table(shipments, since)


def scorecard(
    rows: DataFrame, keys: Sequence[str], thresholds: sc.Thresholds = sc.Thresholds(), drivers: Sequence[str] = rollups.DRIVERS
) -> DataFrame:
    """Scored markets with benchmark bands, no model. The groups are kept, as the
    bands and every later view read them again."""
    markets = cut_lineage(rollups.market_groups(rows, keys, drivers))
    return sc.score_markets(sc.benchmark_bands(markets, thresholds), keys, thresholds)


def scorecard_from_charges(
    charges: DataFrame,
    customers: DataFrame,
    geography_table: DataFrame,
    shipment_table: DataFrame,
    density_table: DataFrame,
    benchmarks: DataFrame,
    order_cols: Sequence[str],
    keys: Sequence[str],
    thresholds: sc.Thresholds = sc.Thresholds(),
    drivers: Sequence[str] = rollups.DRIVERS,
) -> DataFrame:
    """The whole dataflow: charge rows with their job keys -> customers -> cost per stop ->
    normalized cost -> benchmark -> market groups -> scored markets."""
    # the allocation writes and shuffles its rows: what no later step reads stays behind
    needed = {*order_cols, *keys, *drivers, *allocate.INPUTS, "delivery_type"}

    def with_customers() -> DataFrame:
        """Written, as are the customers: the shuffles of one step are gone before the next
        begins, and the sampling of load order does not join everything again."""
        joined = lookups.join_customers(charges, cut_lineage(customers))
        return prepare.filter_codes(joined.select([c for c in joined.columns if c in needed]))

    rows = allocated_costs(settled(charges.sparkSession, with_customers), order_cols)
    rows = normalized_rows(rows, geography_table, shipment_table, density_table)
    return scorecard(lookups.join_benchmark(rows, benchmarks), keys, thresholds, drivers)


def modeled_scorecard(
    rows: DataFrame,
    keys: Sequence[str],
    thresholds: sc.Thresholds = sc.Thresholds(),
    min_groups: int = 20,
    rounds: int = 160,
    drivers: Sequence[str] = rollups.DRIVERS,
    **boost: object,
) -> tuple[DataFrame, DataFrame]:
    """Scored markets with model bands, and the model report.

    Below ``min_groups`` eligible groups the benchmark bands are used; the report says
    so in ``model_status`` and has no errors then.
    """
    markets = cut_lineage(rollups.market_groups(rows, keys, drivers))
    train_all = boosting.train_test_split(sc.model_groups(markets, thresholds), keys)
    numeric, categorical = sc.feature_columns(markets, keys)
    counts = {"groups_total": markets.count(), "model_groups": train_all.count(), "feature_count": len(numeric) + len(categorical)}
    if counts["model_groups"] < min_groups or not counts["feature_count"]:
        report = boosting.model_report(None, rows.sparkSession, "fallback benchmark", **counts)
        return sc.score_markets(sc.benchmark_bands(markets, thresholds), keys, thresholds), report
    encoder = boosting.fit_encoder(train_all.filter(~F.col("is_test")), numeric, categorical)
    quantiles = boosting.FIVE_QUANTILES if thresholds.five_bands else boosting.THREE_QUANTILES
    train = cut_lineage(encoder.apply(train_all))
    model = boosting.fit_quantile_boost(train.filter(~F.col("is_test")), encoder.features, quantiles, rounds, **boost)
    report = boosting.model_report(boosting.model_metrics(model.predict(train.filter(F.col("is_test")))), rows.sparkSession, "model", **counts)
    banded = boosting.score_bands(encoder.apply(markets), model).drop(*encoder.features)
    banded = sc.monotone_bands(banded, [boosting.band_name(q) for q in quantiles])
    for b in sc.BANDS:
        if b not in banded.columns:
            banded = banded.withColumn(b, F.lit(None).cast("double"))
    return sc.score_markets(banded, keys, thresholds), report


def modeled_rows(rows: DataFrame, order_cols: Sequence[str], cost: str = "cost_per_stop", **model: object) -> tuple[DataFrame, DataFrame]:
    """Rows with the bands of the row-level model and their residuals, and its report. The
    rows are written once: counting, sampling and scoring read them."""
    measured = cut_lineage(multipliers.row_sensitivity(rows, cost))
    fitted = boosting.fit_row_model(measured, order_cols, cost, **model)
    banded = boosting.score_rows(measured, fitted, cost)
    banded = sc.monotone_bands(banded, [boosting.band_name(q) for q in fitted.model.start])
    return sc.residuals(banded, cost, "pred_p50", prefix="row"), fitted.report
