"""Registered queries: joins, geography, multipliers, rollups, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockledger.functions import columns as fx
from dockledger.functions.stats import average_ranks, group_quantiles, group_transform, join_back, scalars
from dockledger.operators import geography, lookups, multipliers, rollups
from dockledger.plans import bindings as b
from dockledger.plans import pipelines
from dockledger.plans.bindings_sql import mavg, msum0, q
from dockledger.plans.registry import query

KEYS = "l_orderkey l_linenumber l_partkey l_suppkey l_extendedprice"
SINCE = "1996-01-01 00:00:00"


def allocated(spark: SparkSession, sf: str) -> DataFrame:
    # the allocation writes and shuffles its rows: what nothing here reads stays behind
    return pipelines.allocated_costs(b.delivery_events(spark, sf).drop("xdock", *b.BESIDE_COST), b.ORDER_COLS)


def codes(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.carrier_codes(b.delivery_events(spark, sf))


def kept_telemetry(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.kept_telemetry(b.telemetry(spark, sf), codes(spark, sf))


def geography_table(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.geography_from(b.geo_shipments(spark, sf), SINCE)


def shipment_table(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.shipment_multipliers(b.dock_shipments(spark, sf))


def density_table(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.density_multipliers(b.telemetry(spark, sf), codes(spark, sf))


def normalized(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.normalized_rows(
        allocated(spark, sf), geography_table(spark, sf), shipment_table(spark, sf), density_table(spark, sf)
    )


# ---- joins ------------------------------------------------------------------


@query("join_customers", "SELECT * FROM job_cust", KEYS + " job_customer customer_type customer_name")
def join_customers(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.join_customers(b.job_events(spark, sf), b.customers(spark, sf))


@query(
    "join_audit",
    """SELECT COUNT(*) AS row_count, (SELECT COUNT(*) FROM (SELECT 1 FROM cust GROUP BY UPPER(TRIM(fill_dc_id)),
      UPPER(TRIM(account_id)), UPPER(TRIM(route_no)), UPPER(TRIM(stop_no)) HAVING COUNT(*) > 1) d) AS duplicate_key_groups,
    AVG(CASE WHEN customer_name IS NOT NULL THEN 1 ELSE 0 END) AS match_rate FROM job_cust""",
    "row_count duplicate_key_groups",
    "match_rate",
)
def join_audit(spark: SparkSession, sf: str) -> DataFrame:
    audit = lookups.join_audit(b.job_events(spark, sf), b.customers(spark, sf))
    return audit.withColumnRenamed("rows", "row_count")


@query(
    "join_geography",
    """SELECT a.*, g.geography_multiplier FROM alloc a JOIN gmult g
    ON UPPER(TRIM(a.dc)) = UPPER(TRIM(g.origin)) AND a.year = g.year AND a.month = g.month""",
    KEYS,
    "cost_per_stop geography_multiplier",
)
def join_geography(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.join_multiplier(allocated(spark, sf), geography_table(spark, sf), "geography_multiplier", "origin")


@query(
    "join_shipment",
    """SELECT a.*, s.shipment_multiplier FROM reg a JOIN smult s
    ON UPPER(TRIM(a.dc)) = UPPER(TRIM(s.xdock)) AND a.year = s.year AND a.month = s.month""",
    KEYS,
    "shipment_multiplier",
)
def join_shipment(spark: SparkSession, sf: str) -> DataFrame:
    from dockledger.plans.preparation import reg_events

    return lookups.join_multiplier(reg_events(spark, sf), shipment_table(spark, sf), "shipment_multiplier")


@query(
    "join_density",
    """SELECT a.*, d.density_multiplier FROM reg a JOIN dmult d
    ON UPPER(TRIM(a.dc)) = UPPER(TRIM(d.xdock)) AND a.year = d.year AND a.month = d.month""",
    KEYS,
    "density_multiplier",
)
def join_density(spark: SparkSession, sf: str) -> DataFrame:
    from dockledger.plans.preparation import reg_events

    return lookups.join_multiplier(reg_events(spark, sf), density_table(spark, sf), "density_multiplier")


@query(
    "dropped_markets",
    """SELECT a.dc AS dock_key, a.year, a.month, COUNT(*) AS row_count FROM reg a WHERE NOT EXISTS (SELECT 1 FROM gmult g
    WHERE g.origin = a.dc AND g.year = a.year AND g.month = a.month) GROUP BY 1, 2, 3""",
    "dock_key year month row_count",
)
def dropped_markets(spark: SparkSession, sf: str) -> DataFrame:
    from dockledger.plans.preparation import reg_events

    lost = lookups.dropped_markets(reg_events(spark, sf), geography_table(spark, sf), "origin")
    return lost.withColumnRenamed("rows", "row_count")


@query(
    "join_benchmark",
    """SELECT r.*, benchmark_conservative, benchmark_aggressive FROM reg r LEFT JOIN bench m
    ON r.dc = m.distribution_center AND r.year = m.year AND r.month = m.month""",
    KEYS,
    "benchmark_conservative benchmark_aggressive",
)
def join_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    from dockledger.plans.preparation import reg_events

    return lookups.join_benchmark(reg_events(spark, sf), b.benchmarks(spark, sf))


@query("lookup_carrier_code", "SELECT * FROM codes", "carrier_name carrier_cd")
def lookup_carrier_code(spark: SparkSession, sf: str) -> DataFrame:
    return codes(spark, sf)


@query(
    "zip_geocode_join",
    "SELECT zip5, avg_daily_rate, latitude, longitude FROM zrate JOIN zref ON zip5 = postal_code WHERE avg_daily_rate > 0",
    "zip5",
    "avg_daily_rate latitude longitude",
)
def zip_geocode_join(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.zip_geocode(rollups.zip_rate(b.zip_shipments(spark, sf)), b.zip_reference(spark, sf))


@query(
    "broadcast_scalar",
    "SELECT *, (SELECT QUANTILE_CONT(daily_shipments, 0.5) FROM mship) AS baseline FROM mship",
    "xdock year month",
    "daily_shipments baseline",
)
def broadcast_scalar(spark: SparkSession, sf: str) -> DataFrame:
    monthly = rollups.avg_daily_shipments(rollups.daily_shipments(b.dock_shipments(spark, sf)))
    return monthly.withColumn("baseline", scalars(monthly, m=F.median("daily_shipments"))["m"])


# ---- shipment counts, distances, multipliers --------------------------------


@query("daily_shipments", "SELECT * FROM dship", "xdock shipments", text="day")
def daily_shipments(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.daily_shipments(b.dock_shipments(spark, sf))


@query("avg_daily_shipments", "SELECT * FROM mship", "xdock year month", "daily_shipments")
def avg_daily_shipments(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.avg_daily_shipments(rollups.daily_shipments(b.dock_shipments(spark, sf)))


@query("shipment_multiplier", "SELECT * FROM smult_raw", "xdock year month", "shipment_multiplier_raw")
def shipment_multiplier(spark: SparkSession, sf: str) -> DataFrame:
    return multipliers.shipment_multiplier(avg_daily_shipments(spark, sf))


@query("winsor_global", "SELECT * FROM smult", "xdock year month", "shipment_multiplier")
def winsor_global(spark: SparkSession, sf: str) -> DataFrame:
    return shipment_table(spark, sf)


@query("iqr_filter", "SELECT * FROM tkept", "fill_dc x_dock xdock route_id stop_id", "distance", "day")
def iqr_filter(spark: SparkSession, sf: str) -> DataFrame:
    return kept_telemetry(spark, sf)


@query(
    "outlier_share",
    """SELECT COUNT(*) FILTER (WHERE o) AS outliers, COUNT(*) AS total, COUNT(*) FILTER (WHERE o) * 1e2 / COUNT(*) AS outlier_pct,
    COUNT(*) FILTER (WHERE NOT o) AS remaining, MIN(CASE WHEN NOT o THEN distance END) AS min_kept,
    MAX(CASE WHEN NOT o THEN distance END) AS max_kept
    FROM (SELECT distance, COALESCE(distance < q1 - (q3 - q1) * 15e-1 OR distance > q3 + (q3 - q1) * 15e-1, FALSE) AS o FROM tele2, tq) t""",
    "outliers total remaining",
    "outlier_pct min_kept max_kept",
)
def outlier_share(spark: SparkSession, sf: str) -> DataFrame:
    return multipliers.outlier_share(pipelines.conform_telemetry(b.telemetry(spark, sf)), "distance")


def kept_route_days(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.route_day_distance(kept_telemetry(spark, sf))


@query("route_day_distance", "SELECT * FROM rdist", "fill_dc xdock route_id year month stop_count", "total_miles", "day")
def route_day_distance(spark: SparkSession, sf: str) -> DataFrame:
    return kept_route_days(spark, sf)


@query("xdock_day_miles", "SELECT * FROM ddist", "fill_dc xdock year month stop_count", "total_miles miles_per_stop", "day")
def xdock_day_miles(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.dock_day_miles(kept_route_days(spark, sf))


@query("xdock_month_miles", "SELECT * FROM mdist", "xdock year month", "avg_miles_per_stop")
def xdock_month_miles(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.dock_month_miles(xdock_day_miles(spark, sf))


@query("density_multiplier", "SELECT * FROM dmult_raw", "xdock year month", "baseline_miles_per_stop density_multiplier_raw")
def density_multiplier(spark: SparkSession, sf: str) -> DataFrame:
    return multipliers.density_multiplier(xdock_month_miles(spark, sf))


@query("winsor_monthly", "SELECT * FROM dmult", "xdock year month", "density_multiplier")
def winsor_monthly(spark: SparkSession, sf: str) -> DataFrame:
    return density_table(spark, sf)


# ---- geography --------------------------------------------------------------

STOP_KEYS = "route_id stop_id origin fill_dc"


def stops(spark: SparkSession, sf: str) -> DataFrame:
    return geography.route_stops(b.geo_shipments(spark, sf), SINCE)


@query("route_stops", "SELECT * FROM rstops", STOP_KEYS, "dest_lat dest_lon origin_lat origin_lon", "route_date")
def route_stops(spark: SparkSession, sf: str) -> DataFrame:
    return stops(spark, sf)


@query("previous_stop", "SELECT * FROM seqd", STOP_KEYS, "dest_lat dest_lon prev_lat prev_lon", "route_date")
def previous_stop(spark: SparkSession, sf: str) -> DataFrame:
    return geography.previous_stop(stops(spark, sf))


def legs(spark: SparkSession, sf: str) -> DataFrame:
    return geography.leg_miles(previous_stop(spark, sf))


@query("leg_miles", "SELECT * FROM legs", STOP_KEYS, "leg_miles", "route_date")
def leg_miles(spark: SparkSession, sf: str) -> DataFrame:
    # near 0 the arc cosine amplifies rounding noise of the two engines
    return legs(spark, sf)


@query("route_day_summary", "SELECT * FROM rdays", "route_id origin fill_dc distinct_stops", "total_miles miles_per_stop", "route_date")
def route_day_summary(spark: SparkSession, sf: str) -> DataFrame:
    return geography.route_day_summary(legs(spark, sf))


def origin_months(spark: SparkSession, sf: str) -> DataFrame:
    return geography.origin_month_summary(route_day_summary(spark, sf))


@query(
    "origin_month_summary",
    "SELECT * FROM omonths",
    "year month origin route_days total_stops",
    "total_leg_miles weighted_miles_per_stop median_miles_per_stop p75_miles_per_stop max_miles_per_stop",
)
def origin_month_summary(spark: SparkSession, sf: str) -> DataFrame:
    return origin_months(spark, sf)


@query("conditional_min_over", "SELECT * FROM gbase", "year month origin", "median_miles_per_stop baseline")
def conditional_min_over(spark: SparkSession, sf: str) -> DataFrame:
    return geography.monthly_minimum(origin_months(spark, sf))


@query("geography_multiplier", "SELECT * FROM gmult", "year month origin", "geography_multiplier")
def geography_multiplier(spark: SparkSession, sf: str) -> DataFrame:
    return geography_table(spark, sf)


# ---- normalized cost and rollups --------------------------------------------


@query("geo_mean", "SELECT * FROM slim", KEYS, "geo_mean")
def geo_mean(spark: SparkSession, sf: str) -> DataFrame:
    return multipliers.geo_mean(b.slim_extract(spark, sf).drop("geo_mean"))


NORMALIZED = "cost_per_stop normalized_cost normalized_cost_geography normalized_cost_shipment normalized_cost_density"


@query("normalized_costs", "SELECT * FROM norm", KEYS, "geo_mean " + NORMALIZED)
def normalized_costs(spark: SparkSession, sf: str) -> DataFrame:
    return normalized(spark, sf)


@query(
    "row_sensitivity",
    """SELECT *, normalized_cost / NULLIF(cost_per_stop, 0) AS normalization_ratio,
    normalized_cost / NULLIF(cost_per_stop, 0) - 1 AS normalization_sensitivity_pct,
    cost_per_stop / NULLIF(benchmark_conservative, 0) - 1 AS gap_vs_conservative_pct,
    cost_per_stop / NULLIF(benchmark_aggressive, 0) - 1 AS gap_vs_aggressive_pct FROM slim""",
    KEYS,
    "normalization_ratio normalization_sensitivity_pct gap_vs_conservative_pct gap_vs_aggressive_pct",
)
def row_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    return multipliers.row_sensitivity(b.slim_extract(spark, sf))


ROUTE_DAILY = f"""SELECT fill_dc, dc, year, month, route_id, CAST(delivered_at AS DATE) AS delivery_date, {mavg('cost_per_stop')} AS avg_cost_per_stop,
    AVG(normalized_cost) AS avg_normalized_cost, COUNT(DISTINCT stop_id) AS route_stop_count,
    SUM(density_multiplier) AS sum_density_multiplier
    FROM norm WHERE cost_per_stop > 0 AND delivery_seq <> 0 GROUP BY 1, 2, 3, 4, 5, 6"""


def paid_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    from dockledger.operators.prepare import filter_paid_deliveries

    return filter_paid_deliveries(normalized(spark, sf))


@query(
    "route_daily_cost",
    ROUTE_DAILY,
    "fill_dc dc year month route_id route_stop_count",
    "avg_cost_per_stop avg_normalized_cost sum_density_multiplier",
    "delivery_date",
)
def route_daily_cost(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.route_daily_cost(paid_deliveries(spark, sf))


@query(
    "dock_daily_cost",
    f"""SELECT fill_dc, dc, year, month, delivery_date, AVG(avg_cost_per_stop) AS avg_cost_per_stop,
    AVG(avg_normalized_cost) AS avg_normalized_cost, CAST(SUM(route_stop_count) AS BIGINT) AS route_stop_count_daily,
    SUM(sum_density_multiplier) AS sum_density_daily, COUNT(DISTINCT route_id) AS route_count
    FROM ({ROUTE_DAILY}) r GROUP BY 1, 2, 3, 4, 5""",
    "fill_dc dc year month route_stop_count_daily route_count",
    "avg_cost_per_stop avg_normalized_cost sum_density_daily",
    "delivery_date",
)
def dock_daily_cost(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.dock_daily_cost(route_daily_cost(spark, sf))


@query(
    "dock_monthly_cost",
    f"SELECT fill_dc, year, month, dc, {mavg('cost_per_stop')} AS avg_cost_per_stop FROM alloc GROUP BY 1, 2, 3, 4",
    "fill_dc year month dc",
    "avg_cost_per_stop",
)
def dock_monthly_cost(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.dock_monthly_cost(allocated(spark, sf), "cost_per_stop")


@query(
    "dock_monthly_normalized",
    f"""SELECT fill_dc, year, month, dc, AVG(normalized_cost) AS avg_normalized_cost FROM norm GROUP BY 1, 2, 3, 4""",
    "fill_dc year month dc",
    "avg_normalized_cost",
)
def dock_monthly_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.dock_monthly_cost(normalized(spark, sf))


@query(
    "route_monthly_cost",
    f"SELECT fill_dc, year, month, dc, route_id, {mavg('cost_per_stop')} AS avg_cost_per_stop FROM alloc GROUP BY 1, 2, 3, 4, 5",
    "fill_dc year month dc route_id",
    "avg_cost_per_stop",
)
def route_monthly_cost(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.dock_monthly_cost(allocated(spark, sf), "cost_per_stop", by_route=True)


@query(
    "docks_per_dc_month",
    "SELECT fill_dc, year, month, COUNT(DISTINCT dc) AS docks FROM norm GROUP BY 1, 2, 3",
    "fill_dc year month docks",
)
def docks_per_dc_month(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.docks_per_dc_month(normalized(spark, sf))


# ---- windows ----------------------------------------------------------------


@query("mom_change", "SELECT *, (leg_total_cost / LAG(leg_total_cost) OVER (ORDER BY month_start) - 1) * 1e2 AS mom_pct FROM trend", "", "leg_total_cost mom_pct", "month_start")
def mom_change(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.mom_change(rollups.monthly_trend(b.monthly_summary(spark, sf)))


@query(
    "group_transform",
    f"""SELECT d.*, SUM(shipments) OVER (PARTITION BY xdock) AS dock_total, AVG(shipments) OVER (PARTITION BY xdock) AS dock_mean,
    QUANTILE_CONT(shipments, 0.5) OVER (PARTITION BY xdock) AS dock_median FROM dship d""",
    "xdock shipments",
    "dock_total dock_mean dock_median",
    "day",
)
def group_transform_query(spark: SparkSession, sf: str) -> DataFrame:
    daily = rollups.daily_shipments(b.dock_shipments(spark, sf))
    sums = group_transform(daily, ["xdock"], dock_total=F.sum("shipments"), dock_mean=F.avg("shipments"))
    return join_back(sums, group_quantiles(daily, ["xdock"], {"dock_median": ("shipments", 0.5)}), ["xdock"])


@query(
    "group_quantile_transform",
    f"""SELECT s.*, lo, hi FROM slim s JOIN (SELECT xdock, year, month, {q('cost_per_stop', 0.1)} AS lo, {q('cost_per_stop', 0.9)} AS hi
    FROM slim GROUP BY 1, 2, 3) g ON s.xdock = g.xdock AND s.year = g.year AND s.month = g.month""",
    KEYS,
    "lo hi",
)
def group_quantile_transform(spark: SparkSession, sf: str) -> DataFrame:
    rows, keys = b.slim_extract(spark, sf), ["xdock", "year", "month"]
    return join_back(rows, group_quantiles(rows, keys, {"lo": ("cost_per_stop", 0.1), "hi": ("cost_per_stop", 0.9)}), keys)


@query(
    "average_rank",
    """SELECT *, RANK() OVER (PARTITION BY year, month ORDER BY route_days)
    + (COUNT(*) OVER (PARTITION BY year, month, route_days) - 1) / 2e0 AS avg_rank
    FROM (SELECT dc, year, month, COUNT(*) % 7 AS route_days FROM ev GROUP BY 1, 2, 3) t""",
    "dc year month",
    "avg_rank",
)
def average_rank_query(spark: SparkSession, sf: str) -> DataFrame:
    docks = b.delivery_events(spark, sf).groupBy("dc", "year", "month").agg((F.count(F.lit(1)) % 7).alias("route_days"))
    return average_ranks(docks, "route_days", ["year", "month"], "avg_rank")


# ---- exploration ------------------------------------------------------------

PARTS = "leg_base_cost leg_fuel_cost leg_misc_cost leg_total_cost"


@query("monthly_trend", "SELECT * FROM trend", "", PARTS + " total_routes total_stops total_totes", "month_start")
def monthly_trend(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.monthly_trend(b.monthly_summary(spark, sf))


@query(
    "weekday_cost",
    f"""SELECT STRFTIME(ts, '%A') AS weekday, CAST(EXTRACT(ISODOW FROM ts) - 1 AS INTEGER) AS weekday_no, {mavg('value')} AS avg_cost,
    {msum0('value')} AS total_cost, COUNT(value) AS deliveries FROM events GROUP BY 1, 2""",
    "weekday weekday_no deliveries",
    "avg_cost total_cost",
)
def weekday_cost(spark: SparkSession, sf: str) -> DataFrame:
    events = b.table(spark, sf, "events").withColumnRenamed("ts", "delivered_at")
    return rollups.weekday_cost(events, "value")


@query(
    "carrier_weekday_pivot",
    "SELECT 'Carrier ' || CAST(user_id % 12 AS VARCHAR) AS carrier_name, "
    + ", ".join(
        f"COALESCE({mavg('CASE WHEN STRFTIME(ts, ' + chr(39) + '%A' + chr(39) + f') = {chr(39)}{d}{chr(39)} THEN value END')}, 0) AS {d}"
        for d in rollups.WEEKDAYS
    )
    + " FROM events GROUP BY 1",
    "carrier_name",
    " ".join(rollups.WEEKDAYS),
)
def carrier_weekday_pivot(spark: SparkSession, sf: str) -> DataFrame:
    events = b.table(spark, sf, "events").select(
        F.col("ts").alias("delivered_at"),
        F.concat(F.lit("Carrier "), (F.col("user_id") % 12).cast("string")).alias("carrier_name"),
        fx.weekday_name("ts").alias("weekday"),
        "value",
    )
    return rollups.carrier_weekday_pivot(events, "value")


DAILY = rollups.DAILY_SUMS
DAILY_SQL = ", ".join(f"{msum0(c)} AS {c}" for c in DAILY)


@query(
    "carrier_daily_profile",
    f"""SELECT carrier_name, {', '.join(f'{mavg(c)} AS avg_daily_{c}' for c in DAILY)}, COUNT(day) AS active_days
    FROM (SELECT carrier_name, CAST(delivered_at AS DATE) AS day, {DAILY_SQL} FROM (SELECT *, stop_count AS route_stop_count FROM evd) e
    GROUP BY 1, 2) t GROUP BY 1""",
    "carrier_name active_days",
    " ".join(f"avg_daily_{c}" for c in DAILY),
)
def carrier_daily_profile(spark: SparkSession, sf: str) -> DataFrame:
    events = b.events_with_distance(spark, sf).withColumn("route_stop_count", F.col("stop_count"))
    return rollups.carrier_daily_profile(events)


@query(
    "state_rate",
    f"""SELECT state, {mavg('rate')} AS avg_daily_rate FROM (SELECT state, del_date, {msum0('rate')} AS rate FROM zships
    WHERE TRIM(state) <> '' GROUP BY 1, 2) t GROUP BY 1""",
    "state",
    "avg_daily_rate",
)
def state_rate(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.state_rate(b.zip_shipments(spark, sf))


@query("state_total", f"SELECT state, {msum0('rate')} AS total_rate FROM zships WHERE TRIM(state) <> '' GROUP BY 1", "state", "total_rate")
def state_total(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.state_rate(b.zip_shipments(spark, sf), how="total")


@query(
    "zip_rate",
    "SELECT zip5, avg_daily_rate, (SELECT QUANTILE_CONT(avg_daily_rate, 0.99) FROM zrate) AS color_cap FROM zrate",
    "zip5",
    "avg_daily_rate color_cap",
)
def zip_rate(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.with_color_cap(rollups.zip_rate(b.zip_shipments(spark, sf)))
