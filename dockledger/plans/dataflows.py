"""Registered queries: the whole dataflow as one, and allocation of dirty charge rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dockledger.functions import columns as fx
from dockledger.operators import allocate, prepare, rollups
from dockledger.plans import bindings as b
from dockledger.plans import normalization as n
from dockledger.plans import pipelines
from dockledger.plans.bindings_sql import SCORE_DRIVERS, mavg
from dockledger.plans.registry import query
from dockledger.plans.scorecards import KEYS, THRESHOLDS
from dockledger.session import settled


@query(
    "pipeline_scorecard",
    "SELECT * FROM w_sc",
    "market_id carrier market_name classification confidence business_note records paid_records",
    "zero_rate actual_median_cps pred_p10 pred_p50 pred_p90 model_residual_pct median_normalized_cost norm_sensitivity_abs_pct "
    "benchmark_sensitivity_abs_pct combined_sensitivity_abs_pct median_benchmark_conservative aggressive_gap_pct",
)
def pipeline_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    """Charge rows -> customers -> allocation -> multipliers -> benchmark -> groups -> scores.

    The tables of one row per dock and month come first, so that what they were made of is
    gone before the charge rows take their room."""
    geography, shipments, density = (settled(spark, lambda: made(spark, sf)) for made in (n.geography_table, n.shipment_table, n.density_table))
    charges = b.job_events(spark, sf, distance=True)
    return pipelines.scorecard_from_charges(
        charges, b.customers(spark, sf), geography, shipments, density,
        b.benchmarks(spark, sf), [*b.ORDER_COLS, "customer_name"], KEYS, THRESHOLDS, SCORE_DRIVERS,
    )


# ---- dirty rows: no route, dock, day, stop or sequence, rates that are no numbers, repeats


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.filter_codes(b.dirty_events(spark, sf).drop(*b.BESIDE_COST))


def _plain_cost(c: str = "cost_per_stop") -> Column:
    """No number is no cost, as in the cross-check."""
    return fx.finite(c)


ROW = "l_orderkey l_linenumber l_partkey l_suppkey l_extendedprice"


@query("cost_per_stop_dirty", "SELECT * FROM d_costed", f"{ROW} charge_type route_key stop_key first_of_stop", "rc_total route_cost")
def cost_per_stop_dirty(spark: SparkSession, sf: str) -> DataFrame:
    return allocate.cost_per_stop(dirty(spark, sf), b.ORDER_COLS).withColumn("route_cost", _plain_cost())


@query("delivery_stop_counts_dirty", "SELECT * FROM d_routed WHERE charge_type <> 'TS'", f"{ROW} delivery_stop", text="route_stop_count fill_dc_stop_count")
def delivery_stop_counts_dirty(spark: SparkSession, sf: str) -> DataFrame:
    return allocate.drop_topside_rows(allocate.flag_stops(dirty(spark, sf), b.ORDER_COLS))


@query("drop_topside_rows_dirty", "SELECT * FROM d_alloc", f"{ROW} charge_type first_of_week", "topside_share cost_per_stop")
def drop_topside_rows_dirty(spark: SparkSession, sf: str) -> DataFrame:
    return allocate.allocate_costs(dirty(spark, sf), b.ORDER_COLS).withColumn("cost_per_stop", _plain_cost())


@query(
    "allocation_audit_dirty",
    """SELECT *, charged - allocated AS lost FROM (
    SELECT 'route' AS level, route_key AS group_key, CASE WHEN route_key IS NULL THEN COALESCE(SUM(CASE WHEN charge_type = 'RC' THEN FLOOR(total_rate * 1e4 + 0.5) END) / 1e4, 0) ELSE MAX(rc_total) END AS charged,
      MAX(fm_count) AS stops, COALESCE(SUM(CASE WHEN rc_total > 0 AND fm_count > 0 AND charge_type = 'FM' AND first_of_stop = 1 THEN 1 ELSE 0 END)
        * MAX(rc_total / NULLIF(fm_count, 0)), 0) AS allocated FROM d_routed GROUP BY route_key
    UNION ALL SELECT 'week', s.week_key, CASE WHEN s.week_key IS NULL THEN COALESCE(SUM(CASE WHEN charge_type = 'TS' THEN FLOOR(topside_cost * 1e4 + 0.5) END) / 1e4, 0) ELSE MAX(topside_total) END,
      MAX(topside_stops), COALESCE(SUM(first_of_week) * MAX(topside_total / NULLIF(topside_stops, 0)), 0) FROM d_shared s GROUP BY s.week_key) t""",
    "level group_key stops",
    "charged allocated lost",
)
def allocation_audit_dirty(spark: SparkSession, sf: str) -> DataFrame:
    return allocate.allocation_audit(dirty(spark, sf), b.ORDER_COLS)


@query(
    "market_counts_dirty",
    f"""SELECT *, zero_records / CAST(records AS DOUBLE) AS zero_rate FROM (SELECT xdock, month, COUNT(*) AS records, COUNT(*) FILTER (WHERE COALESCE(cost_per_stop, 0) > 0) AS paid_records,
    COUNT(*) FILTER (WHERE NOT COALESCE(cost_per_stop, 0) > 0) AS zero_records, {mavg('CASE WHEN cost_per_stop > 0 THEN cost_per_stop END')} AS actual_mean_cps
    FROM d_alloc GROUP BY xdock, month) t""",
    "xdock records paid_records zero_records",
    "zero_rate actual_mean_cps",
    "month",
)
def market_counts_dirty(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.market_counts(allocate.allocate_costs(dirty(spark, sf), b.ORDER_COLS), ["xdock", "month"])
