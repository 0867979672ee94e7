"""Daily, monthly and market rollups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockledger.functions import columns as fx
from dockledger.functions.stats import average_rank, group_quantiles, join_back, scalars
from dockledger.operators.lookups import keep_top_groups
from dockledger.session import cut_lineage

COST_PARTS = ["leg_base_cost", "leg_fuel_cost", "leg_misc_cost", "leg_total_cost"]
# Monday-first weekday names.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
COST_METRICS = [
    "cost_per_stop",
    "normalized_cost",
    "normalized_cost_geography",
    "normalized_cost_shipment",
    "normalized_cost_density",
]
MULTIPLIERS = ["geography_multiplier", "density_multiplier", "shipment_multiplier", "geo_mean"]
# Display names of the multipliers.
MULTIPLIER_LABELS = {
    "geography_multiplier": "Geography",
    "density_multiplier": "Density (miles / stop)",
    "shipment_multiplier": "Shipment multiplier",
    "geo_mean": "Geo mean",
}


# ---- trends -----------------------------------------------------------------


def monthly_trend(monthly: DataFrame) -> DataFrame:
    """A1: monthly sums of costs and volumes."""
    return (
        monthly.withColumn("month_start", fx.month_start("year", "month"))
        .filter(F.col("month_start").isNotNull())
        .groupBy("month_start")
        .agg(
            *[fx.money_sum0(c).alias(c) for c in COST_PARTS],
            fx.money_sum0("routes").alias("total_routes"),
            fx.money_sum0("stops").alias("total_stops"),
            fx.money_sum0("totes").alias("total_totes"),
        )
    )


def mom_change(trend: DataFrame, value: str = "leg_total_cost") -> DataFrame:
    """Percent change to the previous month present (one row per month)."""
    previous = F.lag(value).over(Window.orderBy("month_start"))
    return trend.withColumn("mom_pct", fx.ratio_gap(F.col(value), previous) * 100.0)


def weekday_cost(events: DataFrame, cost: str = "leg_total_cost") -> DataFrame:
    """A2: average and total cost and deliveries per weekday."""
    return (
        events.filter(F.col("delivered_at").isNotNull())
        .groupBy(fx.weekday_name("delivered_at").alias("weekday"), fx.weekday_order("delivered_at").alias("weekday_no"))
        .agg(
            fx.money_avg(cost).alias("avg_cost"),
            fx.money_sum0(cost).alias("total_cost"),
            F.count(cost).alias("deliveries"),
        )
    )


def carrier_weekday_pivot(events: DataFrame, cost: str = "leg_total_cost") -> DataFrame:
    """A3: average cost, carrier by weekday, 0 where a carrier has none."""
    return (
        events.filter(F.col("delivered_at").isNotNull() & F.col("carrier_name").isNotNull())
        .groupBy("carrier_name")
        .pivot("weekday", WEEKDAYS)
        .agg(fx.money_avg(cost))
        .na.fill(0.0, WEEKDAYS)
    )


def carrier_profile(monthly: DataFrame) -> DataFrame:
    """A4: ten means per carrier over its route-months."""
    money = {f"avg_{c}": c for c in [*COST_PARTS, "routes", "stops", "totes"]}
    ratios = {"avg_cpr": "avg_cost_per_route", "avg_cps": "avg_cost_per_stop", "avg_cpt": "avg_cost_per_tote"}
    return (
        monthly.filter(F.col("carrier_name").isNotNull())
        .groupBy("carrier_name")
        .agg(
            *[fx.money_avg(c).alias(n) for n, c in money.items()],
            *[F.avg(c).alias(n) for n, c in ratios.items()],
        )
    )


DAILY_SUMS = [*COST_PARTS, "route_count", "route_stop_count", "tote_count", "distance"]


def carrier_daily_profile(events: DataFrame) -> DataFrame:
    """A5: means of the daily sums per carrier, and its active days."""
    daily = (
        events.filter(F.col("delivered_at").isNotNull() & F.col("carrier_name").isNotNull())
        .groupBy("carrier_name", F.to_date("delivered_at").alias("day"))
        .agg(*[fx.money_sum0(c).alias(c) for c in DAILY_SUMS])
    )
    return daily.groupBy("carrier_name").agg(
        *[fx.money_avg(c).alias(f"avg_daily_{c}") for c in DAILY_SUMS], F.count("day").alias("active_days")
    )


def state_rate(shipments: DataFrame, how: str = "daily_mean") -> DataFrame:
    """Mean daily rate per state, or the state's total."""
    named = shipments.filter(F.trim("state") != "")
    if how == "total":
        return named.groupBy("state").agg(fx.money_sum0("rate").alias("total_rate"))
    daily = named.filter(F.col("del_date").isNotNull()).groupBy("state", "del_date").agg(fx.money_sum0("rate").alias("rate"))
    return daily.groupBy("state").agg(fx.money_avg("rate").alias("avg_daily_rate"))


def zip_rate(shipments: DataFrame) -> DataFrame:
    """Mean daily rate per five-digit zip."""
    daily = (
        shipments.withColumn("zip5", fx.zip5("zip"))
        .filter(F.col("zip5").isNotNull() & F.col("del_date").isNotNull())
        .groupBy("zip5", "del_date")
        .agg(fx.money_sum0("rate").alias("rate"))
    )
    return daily.groupBy("zip5").agg(fx.money_avg("rate").alias("avg_daily_rate"))


def with_color_cap(zip_rates: DataFrame, p: float = 0.99) -> DataFrame:
    """The rates with their P99 as color cap."""
    cap = zip_rates.agg(F.percentile("avg_daily_rate", F.lit(p))).scalar()
    return zip_rates.withColumn("color_cap", cap)


# ---- shipments and distances ------------------------------------------------


def daily_shipments(shipments: DataFrame, key: str = "record_key") -> DataFrame:
    """Records per dock and day."""
    return shipments.groupBy("xdock", F.to_date("shipped_at").alias("day")).agg(F.count(key).alias("shipments"))


def avg_daily_shipments(daily: DataFrame) -> DataFrame:
    """Mean daily count per dock and month."""
    return (
        daily.filter(F.col("xdock").isNotNull() & F.col("day").isNotNull())
        .groupBy("xdock", F.year("day").alias("year"), F.month("day").alias("month"))
        .agg(F.avg("shipments").alias("daily_shipments"))
    )


ROUTE_DAY_KEYS = ["fill_dc", "xdock", "route_id", "day", "year", "month"]


def route_day_distance(telemetry: DataFrame) -> DataFrame:
    """A10: distance is a running total, so the maximum counts; distinct stops."""
    return (
        telemetry.dropna(subset=ROUTE_DAY_KEYS)
        .groupBy(*ROUTE_DAY_KEYS)
        .agg(F.max("distance").alias("total_miles"), F.count_distinct("stop_id").alias("stop_count"))
    )


def dock_day_miles(route_days: DataFrame) -> DataFrame:
    """Miles per stop of the dock's day."""
    return (
        route_days.groupBy("fill_dc", "xdock", "day", "year", "month")
        .agg(fx.money_sum0("total_miles").alias("total_miles"), F.sum("stop_count").alias("stop_count"))
        .withColumn("miles_per_stop", fx.safe_div("total_miles", "stop_count"))
    )


def dock_month_miles(dock_days: DataFrame) -> DataFrame:
    """Unweighted mean of the daily ratio."""
    return dock_days.groupBy("xdock", "year", "month").agg(F.avg("miles_per_stop").alias("avg_miles_per_stop"))


# ---- cost rollups -----------------------------------------------------------

ROUTE_KEYS = ["fill_dc", "dc", "year", "month", "route_id", "delivery_date"]


def _mean(value: str) -> Column:
    """Normalized costs are quotients, other costs are charged amounts."""
    return fx.ratio_avg(value) if value.startswith("normalized") else fx.money_avg(value)


def route_daily_cost(rows: DataFrame) -> DataFrame:
    """Mean costs, distinct stops and multiplier sum per route and day."""
    return (
        rows.withColumn("delivery_date", F.to_date("delivered_at"))
        .dropna(subset=ROUTE_KEYS)
        .groupBy(*ROUTE_KEYS)
        .agg(
            fx.money_avg("cost_per_stop").alias("avg_cost_per_stop"),
            fx.ratio_avg("normalized_cost").alias("avg_normalized_cost"),
            F.count_distinct("stop_id").alias("route_stop_count"),
            F.sum("density_multiplier").alias("sum_density_multiplier"),
        )
    )


def dock_daily_cost(routes: DataFrame) -> DataFrame:
    """Mean of the route means per dock and day."""
    return routes.groupBy("fill_dc", "dc", "year", "month", "delivery_date").agg(
        F.avg("avg_cost_per_stop").alias("avg_cost_per_stop"),
        F.avg("avg_normalized_cost").alias("avg_normalized_cost"),
        F.sum("route_stop_count").alias("route_stop_count_daily"),
        F.sum("sum_density_multiplier").alias("sum_density_daily"),
        F.count_distinct("route_id").alias("route_count"),
    )


def dock_monthly_cost(rows: DataFrame, value: str = "normalized_cost", by_route: bool = False) -> DataFrame:
    """Mean cost per fill DC, month and dock (and route)."""
    keys = ["fill_dc", "year", "month", "dc", *(["route_id"] if by_route else [])]
    return rows.dropna(subset=keys).groupBy(*keys).agg(_mean(value).alias(f"avg_{value}"))


def docks_per_dc_month(rows: DataFrame) -> DataFrame:
    """Distinct docks per fill DC and month."""
    keys = ["fill_dc", "year", "month"]
    return rows.dropna(subset=keys).groupBy(*keys).agg(F.count_distinct("dc").alias("docks"))


# ---- market groups ----------------------------------------------------------

QUANTILES = {"actual_median_cps": 0.5, "actual_p75_cps": 0.75, "actual_p90_cps": 0.9}
# The driver columns whose medians a market carries.
DRIVERS = [
    "normalized_cost",
    "normalized_cost_geography",
    "normalized_cost_shipment",
    "normalized_cost_density",
    "geography_multiplier",
    "shipment_multiplier",
    "density_multiplier",
    "geo_mean",
    "route_stop_count",
    "route_tote_count",
    "stop_count",
    "tote_count",
    "route_count",
    "distance",
    "leg_total_cost",
    "leg_base_cost",
    "leg_fuel_cost",
    "leg_misc_cost",
    "benchmark_conservative",
    "benchmark_aggressive",
]


def market_counts(rows: DataFrame, keys: Sequence[str], cost: str = "cost_per_stop") -> DataFrame:
    """Records, paid and zero records and their rates; mean paid cost."""
    paid = fx.is_paid(cost)
    return (
        rows.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.count_if(paid).alias("paid_records"),
            F.count_if(~paid).alias("zero_records"),
            fx.money_avg(F.when(paid, F.col(cost))).alias("actual_mean_cps"),
        )
        .withColumn("zero_rate", fx.safe_div("zero_records", "records"))
        .withColumn("paid_rate", fx.safe_div("paid_records", "records"))
    )


def _paid(rows: DataFrame, cost: str) -> DataFrame:
    return rows.filter(fx.is_paid(cost))


def paid_cost_quantiles(rows: DataFrame, keys: Sequence[str], cost: str = "cost_per_stop") -> DataFrame:
    """Median, P75 and P90 of the paid rows."""
    return group_quantiles(_paid(rows, cost), keys, {n: (cost, p) for n, p in QUANTILES.items()})


def driver_medians(
    rows: DataFrame, keys: Sequence[str], drivers: Sequence[str] = DRIVERS, cost: str = "cost_per_stop"
) -> DataFrame:
    """Medians of the driver columns present, over paid rows."""
    present = [c for c in drivers if c in rows.columns]
    return group_quantiles(_paid(rows, cost), keys, {f"median_{c}": (c, 0.5) for c in present})


def market_groups(
    rows: DataFrame, keys: Sequence[str], drivers: Sequence[str] = DRIVERS, cost: str = "cost_per_stop"
) -> DataFrame:
    """A17-A19 in one table (J8); a group without paid rows keeps its counts."""
    present = [c for c in drivers if c in rows.columns]
    wanted = {n: (cost, p) for n, p in QUANTILES.items()} | {f"median_{c}": (c, 0.5) for c in present}
    # written once: both the counts and the quantiles read the rows
    rows = cut_lineage(rows.select(*dict.fromkeys([*keys, cost, *present])))
    # a driver without any value still gets its (null) column
    return join_back(market_counts(rows, keys, cost), group_quantiles(_paid(rows, cost), keys, wanted, written=True), keys)


CROSSDOCK_COSTS = ["cost_per_stop", "normalized_cost", "benchmark_conservative", "benchmark_aggressive"]


def crossdock_month(rows: DataFrame, year: int, month: int, how: str = "mean") -> DataFrame:
    """One month per fill DC and dock: costs by mean or median, mean multipliers."""
    keys = ["fill_dc", "xdock"]
    rows = rows.filter((F.col("year") == year) & (F.col("month") == month)).dropna(subset=keys)
    costs = [c for c in CROSSDOCK_COSTS if c in rows.columns]
    means = [F.avg(c).alias(c) for c in MULTIPLIERS if c in rows.columns]
    if how == "mean":
        return rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("shipments"), *[_mean(c).alias(c) for c in costs], *means
        )
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("shipments"), *means)
    return join_back(counted, group_quantiles(rows, keys, {c: (c, 0.5) for c in costs}), keys)


def dc_average(markets: DataFrame, columns: Sequence[str] = ("cost_per_stop", "normalized_cost")) -> DataFrame:
    """Mean of market means per fill DC."""
    return markets.groupBy("fill_dc").agg(*[F.avg(c).alias(c) for c in columns])


def factor_by_dc(markets: DataFrame, factors: Sequence[str] = MULTIPLIERS) -> DataFrame:
    """Mean factor per fill DC, long form."""
    means = markets.groupBy("fill_dc").agg(*[F.avg(c).alias(c) for c in factors])
    labels = F.create_map(*[F.lit(x) for kv in MULTIPLIER_LABELS.items() for x in kv])
    long = means.unpivot("fill_dc", list(factors), "factor", "value")
    return long.filter(F.col("value").isNotNull()).withColumn("factor", labels[F.col("factor")])


def biggest_factor_impact(markets: DataFrame) -> DataFrame:
    """The fill DC whose geometric mean moves cost the most."""
    impact = (fx.safe_div(F.lit(1.0), F.col("value")) - 1.0) * 100.0
    rows = markets.groupBy("fill_dc").agg(F.avg("geo_mean").alias("value")).withColumn("impact", impact)
    return (
        rows.filter(F.col("impact").isNotNull())
        .orderBy(F.desc(F.abs("impact")), "fill_dc")
        .limit(1)
        .withColumn("direction", F.when(F.col("impact") >= 0, "raises").otherwise("lowers"))
    )


# ---- reliability of the normalization ---------------------------------------


def group_cv(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str] = COST_METRICS) -> DataFrame:
    """Size, mean, median, deviation and variation per group and metric."""
    values = rows.unpivot(list(keys), list(metrics), "metric", "value")
    group = [*keys, "metric"]
    moments = values.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")
    )
    medians = group_quantiles(values.withColumnRenamed("metric", "measure"), [*keys, "measure"], {"median": ("value", 0.5)})
    joined = join_back(moments, medians.withColumnRenamed("measure", "metric"), group)
    return joined.withColumn("cv", fx.safe_div("std", "mean"))


def cv_summary(cv: DataFrame) -> DataFrame:
    """Median variation per metric."""
    return cv.groupBy("metric").agg(F.median("cv").alias("cv"))


def rank_stability(
    rows: DataFrame, dock: str = "dc", metrics: Sequence[str] = COST_METRICS, min_common: int = 5
) -> DataFrame:
    """Mean rank correlation of dock medians between neighbouring months."""
    keys = [dock, "year", "month"]
    located = rows.dropna(subset=["year", "month", dock])
    # one row per dock and month, read three times below
    medians = cut_lineage(group_quantiles(located, keys, {m: (m, 0.5) for m in metrics}))
    long = (
        medians.withColumn("period", F.col("year") * 12 + F.col("month"))
        .unpivot([dock, "period"], list(metrics), "metric", "value")
        .filter(F.col("value").isNotNull())
    )
    # the month before is the one before among those present for the metric
    present = long.select("metric", "period").distinct()
    steps = present.withColumn("before", F.lag("period").over(Window.partitionBy("metric").orderBy("period"))).dropna()
    earlier = long.select("metric", F.col("period").alias("before"), dock, F.col("value").alias("value_before"))
    pairs = long.join(steps, ["metric", "period"]).join(earlier, ["metric", "before", dock])
    step = ["metric", "period"]
    ranked = pairs.select(
        *step, average_rank("value_before", step).alias("rank_before"), average_rank("value", step).alias("rank_now")
    )
    correlations = (
        ranked.groupBy(*step)
        .agg(F.corr("rank_before", "rank_now").alias("corr"), F.count(F.lit(1)).alias("docks"))
        .filter(F.col("docks") >= min_common)
    )
    scores = correlations.groupBy("metric").agg(
        F.avg(fx.finite("corr")).alias("avg_rank_corr"), F.count(F.lit(1)).alias("period_pairs")
    )
    every = rows.sparkSession.createDataFrame([(m,) for m in metrics], "metric string")
    return every.join(scores, "metric", "left").withColumn("period_pairs", F.coalesce("period_pairs", F.lit(0)))


# ---- scorecard summaries ----------------------------------------------------


def classification_counts(markets: DataFrame) -> DataFrame:
    """Groups per class, most first."""
    return markets.groupBy("classification").agg(F.count(F.lit(1)).alias("groups")).orderBy(F.desc("groups"), "classification")


def bucket_summary(bucketed: DataFrame) -> DataFrame:
    """Markets, records and median gaps per signal bucket."""
    return bucketed.groupBy("bucket_label", "model_signal", "normalized_signal", "benchmark_signal").agg(
        F.count("market_id").alias("markets"),
        F.sum("paid_records").alias("records_with_cps"),
        F.median("model_residual_pct").alias("median_model_gap"),
        F.median("normalized_gap_pct").alias("median_normalized_gap"),
        F.median("aggressive_gap_pct").alias("median_benchmark_gap"),
        F.median("three_signal_score").alias("median_three_signal_score"),
    )


def customer_type_summary(rows: DataFrame, cost: str = "cost_per_stop") -> DataFrame:
    """Paid records and cost per customer type, with shares of the total."""
    paid = _paid(rows.withColumn("customer_type", fx.fill_unknown("customer_type")), cost)
    per_type = paid.groupBy("customer_type").agg(
        F.count(F.lit(1)).alias("records"), fx.money_avg(cost).alias("mean_cps"), fx.money_sum(cost).alias("total_cost")
    )
    # one row per customer type: the totals are over a small table
    totals = scalars(per_type, records=F.sum("records"), cost=fx.money_sum("total_cost"))
    medians = group_quantiles(paid, ["customer_type"], {"median_cps": (cost, 0.5)})
    return join_back(per_type, medians, ["customer_type"]).withColumns(
        {
            "records_share": fx.safe_div("records", totals["records"]),
            "cost_share": F.when(totals["cost"] > 0, fx.safe_div("total_cost", totals["cost"])),
        }
    )


def market_customer_gap(rows: DataFrame, dock: str = "xdock", cost: str = "cost_per_stop") -> DataFrame:
    """Median per dock and customer type against the median of those medians."""
    keys = [dock, "customer_type"]
    paid = _paid(rows.withColumn("customer_type", fx.fill_unknown("customer_type")), cost)
    counts = paid.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"))
    cells = join_back(counts, group_quantiles(paid, keys, {"actual_cps": (cost, 0.5)}), keys)
    baselines = cells.groupBy("customer_type").agg(F.median("actual_cps").alias("expected_cps"))
    return join_back(cells, baselines, ["customer_type"]).withColumn("gap_pct", fx.ratio_gap("actual_cps", "expected_cps"))


def gap_heat(cells: DataFrame, dock: str = "xdock", n: int = 8) -> DataFrame:
    """Mean gap per dock and customer type, for the types with most records."""
    top = keep_top_groups(cells, "customer_type", F.col("records"), n)
    return top.groupBy(dock, "customer_type").agg(F.avg("gap_pct").alias("gap_pct"))


def _class_is(*classes: str) -> Column:
    return F.count_if(F.col("classification").isin(*classes))


def kpi_row(markets: DataFrame) -> DataFrame:
    """The headline numbers of a scorecard."""
    gap = F.col("model_residual_pct")
    return markets.agg(
        F.count(F.lit(1)).alias("scored_groups"),
        _class_is("Strong overpay candidate").alias("strong_overpay"),
        _class_is("Strong overpay candidate", "Possible overpay").alias("overpay"),
        _class_is("Strong underpay candidate", "Possible underpay").alias("underpay"),
        _class_is("Not enough evidence").alias("not_enough_evidence"),
        F.count_if(F.col("confidence") == "High").alias("high_confidence"),
        F.max_by("market_name", F.struct(gap, "market_id")).alias("worst_market"),
        F.max(gap).alias("worst_gap"),
    )


def crossdock_kpis(summary: DataFrame) -> DataFrame:
    """Docks, fill DCs and the largest gap of a crossdock month."""
    return summary.agg(
        F.count_distinct("xdock").alias("docks"),
        F.count_distinct("fill_dc").alias("fill_dcs"),
        F.max("deviation_pct").alias("largest_gap_pct"),
        F.max_by("xdock", F.struct("deviation_pct", "xdock")).alias("largest_gap_dock"),
    )


def residual_month_pivot(scored: DataFrame, months: Sequence[int] = tuple(range(1, 13))) -> DataFrame:
    """Median residual, dock by month."""
    return scored.groupBy("xdock").pivot("month", list(months)).agg(F.median("model_residual_pct"))


def _row_quantiles(columns: Sequence[str], cost: str) -> dict[str, tuple[str, float]]:
    return {
        "actual_median_cps": (cost, 0.5),
        "actual_p75_cps": (cost, 0.75),
        "actual_p90_cps": (cost, 0.9),
        **{c: (c, 0.5) for c in columns if c.startswith("pred_p")},
        "median_row_residual_pct": ("row_residual_pct", 0.5),
        "norm_sensitivity_median_pct": ("normalization_sensitivity_pct", 0.5),
        "norm_sensitivity_abs_pct": ("norm_sensitivity_abs_pct", 0.5),
        "conservative_gap_median_pct": ("gap_vs_conservative_pct", 0.5),
        "aggressive_gap_median_pct": ("gap_vs_aggressive_pct", 0.5),
        **{f"median_{c}": (c, 0.5) for c in DRIVERS if c in columns},
    }


def scorecard_rows(scored_rows: DataFrame, keys: Sequence[str], cost: str = "cost_per_stop") -> DataFrame:
    """What ``row_scorecard`` reads of each row."""
    rows = scored_rows.withColumn("norm_sensitivity_abs_pct", F.abs("normalization_sensitivity_pct"))
    return rows.select(*dict.fromkeys([*keys, cost, *[c for c, _ in _row_quantiles(rows.columns, cost).values()]]))


def row_scorecard(scored_rows: DataFrame, keys: Sequence[str], cost: str = "cost_per_stop", written: bool = False) -> DataFrame:
    """Group medians of row-level predictions, residuals and sensitivities."""
    # written once (if ``scorecard_rows`` is not yet): counts, means and quantiles read it, and scoring a row is dear
    rows = scored_rows if written else cut_lineage(scorecard_rows(scored_rows, keys, cost))
    wanted = _row_quantiles(rows.columns, cost)
    bands = [c for c in rows.columns if c.startswith("pred_p")]
    # here medians are over all rows of the group, paid or not
    counts = market_counts(rows, keys, cost).drop("actual_mean_cps")
    means = rows.groupBy(*keys).agg(fx.money_avg(cost).alias("actual_mean_cps"))
    cards = join_back(join_back(counts, means, keys), group_quantiles(rows, keys, wanted, written=True), keys)
    actual = F.col("actual_median_cps")
    return cards.withColumns(
        {
            "model_residual": actual - F.col("pred_p50"),
            "model_residual_pct": fx.ratio_gap("actual_median_cps", "pred_p50"),
            **{f"above_{b[5:]}": actual > F.col(b) for b in bands if b in ("pred_p75", "pred_p90")},
            **{f"below_{b[5:]}": actual < F.col(b) for b in bands if b in ("pred_p10", "pred_p25")},
        }
    )


# ---- exploration ------------------------------------------------------------


def correlation_matrix(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Pairwise Pearson correlation, lower triangle, long form.

    ``columns`` maps a label to a column. Rows where either value is null do not
    count for that pair.
    """
    labels = list(columns)
    pairs = [(a, b) for i, a in enumerate(labels) for b in labels[: i + 1]]
    sums = df.agg(*[F.corr(columns[a], columns[b]).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = [
        F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"), fx.finite(f"c{i}").alias("corr"))
        for i, (a, b) in enumerate(pairs)
    ]
    return sums.select(F.inline(F.array(*rows)))


def ols_trend(df: DataFrame, y: str, x: str) -> DataFrame:
    """Least-squares line of y on x over all rows."""
    return df.agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_count(y, x).alias("n"),
    )
