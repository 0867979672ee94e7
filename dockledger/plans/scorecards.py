"""Registered queries: market groups, scorecard, views, comparison, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockledger.functions.stats import describe_columns
from dockledger.operators import lookups, multipliers, prepare, profiles, rollups, views
from dockledger.operators import scoring as sc
from dockledger.plans import bindings as b
from dockledger.plans import pipelines
from dockledger.plans.bindings_sql import FEATURES, MIN_N, SCORE_DRIVERS, mavg, msum, q
from dockledger.plans.registry import on_grid, on_grid_sql, query

KEYS = ["xdock", "carrier_cd"]
THRESHOLDS = sc.Thresholds(min_group_n=MIN_N)
FIVE = sc.Thresholds(min_group_n=MIN_N, five_bands=True)


def markets(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.cut_lineage(rollups.market_groups(b.slim_extract(spark, sf), KEYS, SCORE_DRIVERS))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.scorecard(b.slim_extract(spark, sf), KEYS, THRESHOLDS, SCORE_DRIVERS)


# ---- market groups ----------------------------------------------------------


@query("market_counts", "SELECT * FROM mk", "xdock carrier_cd records paid_records zero_records", "zero_rate paid_rate actual_mean_cps")
def market_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.market_counts(b.slim_extract(spark, sf), KEYS)


@query("paid_cost_quantiles", "SELECT * FROM mk", "xdock carrier_cd", "actual_median_cps actual_p75_cps actual_p90_cps")
def paid_cost_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.paid_cost_quantiles(b.slim_extract(spark, sf), KEYS)


DRIVERS = [c for c in rollups.DRIVERS if c in (
    "normalized_cost", "normalized_cost_geography", "normalized_cost_shipment", "normalized_cost_density",
    "geography_multiplier", "shipment_multiplier", "density_multiplier", "geo_mean", "route_stop_count",
    "route_tote_count", "distance", "benchmark_conservative", "benchmark_aggressive",
)]


@query(
    "driver_medians",
    f"SELECT xdock, carrier_cd, {', '.join(q(c, 0.5) + f' AS median_{c}' for c in DRIVERS)} FROM slim WHERE paid GROUP BY 1, 2",
    "xdock carrier_cd",
    " ".join(f"median_{c}" for c in DRIVERS),
)
def driver_medians(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.driver_medians(b.slim_extract(spark, sf), KEYS)


@query(
    "join_aggregates",
    "SELECT * FROM mk",
    "xdock carrier_cd records paid_records",
    "zero_rate actual_mean_cps actual_median_cps actual_p90_cps " + " ".join(f"median_{c}" for c in SCORE_DRIVERS),
)
def join_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.market_groups(b.slim_extract(spark, sf), KEYS, SCORE_DRIVERS)


# ---- scoring ----------------------------------------------------------------


@query(
    "model_groups",
    f"SELECT *, LN(1 + actual_median_cps) AS target, SQRT(GREATEST(paid_records, 1)) AS weight FROM mk "
    f"WHERE actual_median_cps > 0 AND paid_records >= {MIN_N}",
    "xdock carrier_cd paid_records",
    "target weight",
)
def model_groups(spark: SparkSession, sf: str) -> DataFrame:
    # the reduced test tables may hold no eligible group at all
    return sc.model_groups(markets(spark, sf), THRESHOLDS)


@query("benchmark_bands", "SELECT * FROM band", "xdock carrier_cd", "pred_p10 pred_p25 pred_p50 pred_p75 pred_p90")
def benchmark_bands(spark: SparkSession, sf: str) -> DataFrame:
    return sc.benchmark_bands(markets(spark, sf), FIVE)


@query(
    "monotone_bands",
    """SELECT xdock, carrier_cd, LIST_SORT(v)[1] AS a, LIST_SORT(v)[2] AS b, LIST_SORT(v)[3] AS c FROM (
    SELECT xdock, carrier_cd, [actual_p90_cps, actual_median_cps, actual_mean_cps] AS v FROM mk) t""",
    "xdock carrier_cd",
    "a b c",
)
def monotone_bands(spark: SparkSession, sf: str) -> DataFrame:
    bands = markets(spark, sf).select(
        *KEYS, F.col("actual_p90_cps").alias("a"), F.col("actual_median_cps").alias("b"), F.col("actual_mean_cps").alias("c")
    )
    return sc.monotone_bands(bands, ["a", "b", "c"])


@query("residuals", "SELECT * FROM sens", "xdock carrier_cd", "model_residual model_residual_pct")
def residuals(spark: SparkSession, sf: str) -> DataFrame:
    return sc.residuals(sc.benchmark_bands(markets(spark, sf), THRESHOLDS))


SENSITIVITIES = (
    "normalization_sensitivity_pct conservative_gap_pct aggressive_gap_pct benchmark_mid_cost benchmark_spread_pct "
    "norm_sensitivity_abs_pct benchmark_sensitivity_abs_pct combined_sensitivity_abs_pct"
)


@query("sensitivities", "SELECT * FROM conf", "xdock carrier_cd", SENSITIVITIES)
def sensitivities(spark: SparkSession, sf: str) -> DataFrame:
    return sc.sensitivities(sc.residuals(sc.benchmark_bands(markets(spark, sf), THRESHOLDS)))


@query("confidence", "SELECT * FROM conf", "xdock carrier_cd confidence confidence_score")
def confidence(spark: SparkSession, sf: str) -> DataFrame:
    return sc.confidence(sensitivities(spark, sf), THRESHOLDS)


@query(
    "classification",
    "SELECT xdock, carrier_cd, classification, classification_five FROM cls",
    "xdock carrier_cd classification classification_five",
)
def classification(spark: SparkSession, sf: str) -> DataFrame:
    banded = sc.residuals(sc.benchmark_bands(markets(spark, sf), FIVE))
    graded = sc.confidence(sc.sensitivities(banded), THRESHOLDS)
    five = sc.classification(graded, FIVE).withColumnRenamed("classification", "classification_five")
    return sc.classification(five, THRESHOLDS)


@query(
    "benchmark_support_note",
    "SELECT * FROM noted",
    "xdock carrier_cd overpay_support underpay_support business_note",
)
def benchmark_support_note(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf)


_SHOWN = {shown: c for shown, c in sc.BUSINESS_COLUMNS.items() if c not in ("median_route_count",)}
_TEXT = {"market_id", "market_name", "carrier", "classification", "confidence", "business_note", "records", "paid_records"}


@query(
    "business_view",
    "SELECT " + ", ".join(f'{c} AS "{shown}"' if c in _TEXT else f'{on_grid_sql(c)} AS "{shown}"' for shown, c in _SHOWN.items()) + " FROM sc",
)
def business_view(spark: SparkSession, sf: str) -> DataFrame:
    view = sc.business_view(scored(spark, sf))
    return view.select(
        *[
            F.col(f"`{shown}`") if c in _TEXT else on_grid(f"`{shown}`").alias(shown)
            for shown, c in _SHOWN.items()
        ]
    )


# ---- views ------------------------------------------------------------------

ID = "market_id carrier classification"


def _top_sql(where: str, order: str, n: int) -> str:
    return f"SELECT *, market_id || ' | ' || carrier AS label FROM sc WHERE {where} ORDER BY {order}, market_id, carrier LIMIT {n}"


@query(
    "top_overpay",
    _top_sql("classification IN ('Strong overpay candidate', 'Possible overpay')", "model_residual_pct DESC", 30),
    ID + " label",
    "model_residual_pct",
)
def top_overpay(spark: SparkSession, sf: str) -> DataFrame:
    return views.top_overpay(scored(spark, sf))


@query(
    "top_underpay",
    _top_sql("classification IN ('Strong underpay candidate', 'Possible underpay')", "model_residual_pct ASC", 30),
    ID + " label",
    "model_residual_pct",
)
def top_underpay(spark: SparkSession, sf: str) -> DataFrame:
    return views.top_underpay(scored(spark, sf))


@query(
    "cost_band_top",
    _top_sql("model_residual_pct IS NOT NULL", "model_residual_pct DESC", 30),
    ID,
    "actual_median_cps pred_p10 pred_p50 pred_p90",
)
def cost_band_top(spark: SparkSession, sf: str) -> DataFrame:
    return views.cost_band_top(scored(spark, sf))


@query(
    "actual_vs_expected",
    """SELECT *, (SELECT MAX(GREATEST(actual_median_cps, pred_p50)) FROM sc) AS axis_max FROM sc
    WHERE actual_median_cps IS NOT NULL AND pred_p50 IS NOT NULL""",
    ID + " paid_records",
    "actual_median_cps pred_p50 axis_max",
)
def actual_vs_expected(spark: SparkSession, sf: str) -> DataFrame:
    return views.actual_vs_expected(scored(spark, sf))


COMPLETE = "aggressive_gap_pct IS NOT NULL AND model_residual_pct IS NOT NULL"


@query(
    "benchmark_triangulation",
    f"""SELECT sc.*, LEAST(GREATEST(aggressive_gap_pct, x1), x2) AS benchmark_gap_plot, LEAST(GREATEST(model_residual_pct, y1), y2) AS model_gap_plot
    FROM sc, (SELECT {q('aggressive_gap_pct', 0.01)} AS x1, {q('aggressive_gap_pct', 0.99)} AS x2, {q('model_residual_pct', 0.01)} AS y1,
      {q('model_residual_pct', 0.99)} AS y2 FROM sc WHERE {COMPLETE}) s WHERE {COMPLETE}""",
    ID,
    "aggressive_gap_pct model_residual_pct benchmark_gap_plot model_gap_plot",
)
def benchmark_triangulation(spark: SparkSession, sf: str) -> DataFrame:
    return views.benchmark_triangulation(scored(spark, sf))


@query("triangulation_labels", _top_sql(COMPLETE, "paid_records DESC", 15), ID + " paid_records", "model_residual_pct")
def triangulation_labels(spark: SparkSession, sf: str) -> DataFrame:
    return views.triangulation_labels(scored(spark, sf))


@query("top_quadrant", _top_sql(COMPLETE, "model_residual_pct DESC, paid_records DESC", 25), ID + " paid_records", "model_residual_pct")
def top_quadrant(spark: SparkSession, sf: str) -> DataFrame:
    return views.top_quadrant(scored(spark, sf))


@query(
    "cost_comparison_long",
    " UNION ALL ".join(
        f"SELECT market_id, carrier, '{label}' AS metric, {c} AS value FROM sc WHERE {c} IS NOT NULL"
        for label, c in views.COMPARISON_METRICS.items()
    ),
    "market_id carrier metric",
    "value",
)
def cost_comparison_long(spark: SparkSession, sf: str) -> DataFrame:
    return views.cost_comparison_long(scored(spark, sf))


@query(
    "normalized_gap",
    """SELECT *, actual_median_cps / NULLIF(median_normalized_cost, 0) - 1 AS normalized_gap_pct FROM sc
    WHERE median_normalized_cost IS NOT NULL AND model_residual_pct IS NOT NULL""",
    ID,
    "normalized_gap_pct",
)
def normalized_gap(spark: SparkSession, sf: str) -> DataFrame:
    return views.normalized_gap(scored(spark, sf))


@query(
    "validation_score",
    f"""SELECT *, 5e-1 * model_residual_pct + 3e-1 * aggressive_gap_pct
      + 2e-1 * (actual_median_cps / NULLIF(median_normalized_cost, 0) - 1) AS validation_score FROM sc
    WHERE median_normalized_cost IS NOT NULL AND {COMPLETE}""",
    ID,
    "validation_score",
)
def validation_score(spark: SparkSession, sf: str) -> DataFrame:
    return views.validation_score(scored(spark, sf))


def bucketed(spark: SparkSession, sf: str) -> DataFrame:
    return views.three_signal_score(views.signal_buckets(scored(spark, sf)))


@query("signal_buckets", "SELECT * FROM buck", ID + " signal_bucket bucket_label", "normalized_gap_pct")
def signal_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return views.signal_buckets(scored(spark, sf))


@query("three_signal_score", "SELECT * FROM buck", ID, "three_signal_score volume_adjusted_score")
def three_signal_score(spark: SparkSession, sf: str) -> DataFrame:
    return bucketed(spark, sf)


@query(
    "bucket_detail",
    "SELECT * FROM buck WHERE bucket_label = 'All 3 Above: Strong Overpay Support'",
    ID + " confidence business_note paid_records",
    "actual_median_cps pred_p50 median_normalized_cost median_benchmark_aggressive normalized_gap_pct volume_adjusted_score",
)
def bucket_detail(spark: SparkSession, sf: str) -> DataFrame:
    return views.bucket_detail(bucketed(spark, sf), "All 3 Above: Strong Overpay Support")


@query(
    "bucket_summary",
    f"""SELECT bucket_label, model_signal, normalized_signal, benchmark_signal, COUNT(*) AS markets,
    CAST(SUM(paid_records) AS BIGINT) AS records_with_cps, {q('model_residual_pct', 0.5)} AS median_model_gap,
    {q('normalized_gap_pct', 0.5)} AS median_normalized_gap, {q('aggressive_gap_pct', 0.5)} AS median_benchmark_gap,
    {q('three_signal_score', 0.5)} AS median_three_signal_score FROM buck GROUP BY 1, 2, 3, 4""",
    "bucket_label model_signal normalized_signal benchmark_signal markets records_with_cps",
    "median_model_gap median_normalized_gap median_benchmark_gap median_three_signal_score",
)
def bucket_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.bucket_summary(bucketed(spark, sf))


@query(
    "class_detail",
    """SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY classification ORDER BY
      CASE WHEN LOWER(classification) LIKE '%underpay%' THEN -model_residual_pct
           WHEN classification = 'Not enough evidence' THEN CAST(paid_records AS DOUBLE) ELSE model_residual_pct END DESC NULLS LAST,
      market_id, carrier) AS class_rank FROM sc) t WHERE class_rank <= 50""",
    ID + " class_rank paid_records",
    "model_residual_pct",
)
def class_detail(spark: SparkSession, sf: str) -> DataFrame:
    return views.class_tops(scored(spark, sf), 50)


def _dollars(c: str) -> str:
    return f"COALESCE('$' || FORMAT('{{:,.2f}}', {c}), 'n/a')"


@query(
    "row_narrative",
    f"""SELECT *, 'Signal: ' || classification || ' with ' || confidence || ' confidence. Actual CPS is ' || {_dollars('actual_median_cps')}
    || ' versus expected CPS of ' || {_dollars('pred_p50')} || ', a gap of ' || CASE WHEN model_residual_pct * 1e2 >= 0 THEN '+' ELSE '' END
    || FORMAT('{{:,.1f}}', model_residual_pct * 1e2) || '% based on ' || FORMAT('{{:,}}', paid_records) || ' records with CPS.'
    || CASE WHEN median_normalized_cost IS NULL THEN '' ELSE ' Normalized cost is ' || {_dollars('median_normalized_cost')}
      || '. Use it as supporting evidence, not the final decision rule.' END
    || CASE WHEN median_benchmark_conservative IS NULL AND median_benchmark_aggressive IS NULL THEN '' ELSE ' Cleansheet range: conservative '
      || {_dollars('median_benchmark_conservative')} || ', aggressive ' || {_dollars('median_benchmark_aggressive')} || '.' END
    || ' Business note: ' || business_note AS narrative FROM sc""",
    ID + " narrative",
)
def row_narrative(spark: SparkSession, sf: str) -> DataFrame:
    return views.row_narrative(scored(spark, sf))


@query(
    "class_summary_row",
    """SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE classification = 'Strong overpay candidate') AS strong_overpay,
    COUNT(*) FILTER (WHERE classification = 'Possible overpay') AS possible_overpay,
    COUNT(*) FILTER (WHERE classification = 'Strong underpay candidate') AS strong_underpay,
    COUNT(*) FILTER (WHERE classification = 'Possible underpay') AS possible_underpay,
    COUNT(*) FILTER (WHERE classification = 'Not enough evidence') AS not_enough_evidence FROM sc""",
    "total strong_overpay possible_overpay strong_underpay possible_underpay not_enough_evidence",
)
def class_summary_row(spark: SparkSession, sf: str) -> DataFrame:
    return views.class_summary_row(scored(spark, sf))


@query("classification_counts", 'SELECT classification, COUNT(*) AS "groups" FROM sc GROUP BY 1')
def classification_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.classification_counts(scored(spark, sf))


@query(
    "kpi_row",
    """SELECT COUNT(*) AS scored_groups, COUNT(*) FILTER (WHERE classification = 'Strong overpay candidate') AS strong_overpay,
    COUNT(*) FILTER (WHERE classification IN ('Strong overpay candidate', 'Possible overpay')) AS overpay,
    COUNT(*) FILTER (WHERE classification IN ('Strong underpay candidate', 'Possible underpay')) AS underpay,
    COUNT(*) FILTER (WHERE classification = 'Not enough evidence') AS not_enough_evidence,
    COUNT(*) FILTER (WHERE confidence = 'High') AS high_confidence, MAX(model_residual_pct) AS worst_gap,
    (SELECT market_name FROM sc ORDER BY model_residual_pct DESC NULLS LAST, market_id DESC LIMIT 1) AS worst_market FROM sc""",
    "scored_groups strong_overpay overpay underpay not_enough_evidence high_confidence worst_market",
    "worst_gap",
)
def kpi_row(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.kpi_row(scored(spark, sf))


# ---- crossdock comparison ---------------------------------------------------


def crossdock(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.crossdock_month(b.slim_extract(spark, sf), 1998, 6)


COSTS = "cost_per_stop normalized_cost benchmark_conservative benchmark_aggressive"
FACTORS = "geography_multiplier density_multiplier shipment_multiplier geo_mean"


@query("crossdock_month", "SELECT * FROM xmonth", "fill_dc xdock shipments", f"{COSTS} {FACTORS}")
def crossdock_month(spark: SparkSession, sf: str) -> DataFrame:
    return crossdock(spark, sf)


@query(
    "crossdock_month_median",
    f"SELECT fill_dc, xdock, COUNT(*) AS shipments, {', '.join(q(c, 0.5) + f' AS {c}' for c in COSTS.split())} "
    "FROM slim WHERE year = 1998 AND month = 6 GROUP BY 1, 2",
    "fill_dc xdock shipments",
    COSTS,
)
def crossdock_month_median(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.crossdock_month(b.slim_extract(spark, sf), 1998, 6, how="median")


@query("dc_average", "SELECT fill_dc, AVG(cost_per_stop) AS cost_per_stop, AVG(normalized_cost) AS normalized_cost FROM xmonth GROUP BY 1", "fill_dc", "cost_per_stop normalized_cost")
def dc_average(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.dc_average(crossdock(spark, sf))


@query(
    "factor_by_dc",
    " UNION ALL ".join(
        f"SELECT fill_dc, '{label}' AS factor, AVG({c}) AS value FROM xmonth GROUP BY 1 HAVING AVG({c}) IS NOT NULL"
        for c, label in rollups.MULTIPLIER_LABELS.items()
    ),
    "fill_dc factor",
    "value",
)
def factor_by_dc(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.factor_by_dc(crossdock(spark, sf))


@query(
    "biggest_factor_impact",
    """SELECT *, CASE WHEN impact >= 0 THEN 'raises' ELSE 'lowers' END AS direction FROM (
    SELECT fill_dc, AVG(geo_mean) AS value, (1 / AVG(geo_mean) - 1) * 1e2 AS impact FROM xmonth GROUP BY 1) t
    ORDER BY abs(impact) DESC, fill_dc LIMIT 1""",
    "fill_dc direction",
    "value impact",
)
def biggest_factor_impact(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.biggest_factor_impact(crossdock(spark, sf))


def gaps(spark: SparkSession, sf: str) -> DataFrame:
    return multipliers.dc_baseline_gap(crossdock(spark, sf))


@query("dc_baseline_gap", "SELECT * FROM xgap", "fill_dc xdock status", "normalized_cost baseline deviation deviation_pct")
def dc_baseline_gap(spark: SparkSession, sf: str) -> DataFrame:
    return gaps(spark, sf)


@query("gap_ranking", "SELECT * FROM xgap", "fill_dc xdock status", "deviation_pct")
def gap_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return views.gap_ranking(gaps(spark, sf))


@query(
    "metric_long",
    " UNION ALL ".join(f"SELECT xdock, fill_dc, '{label}' AS metric, {c} AS value FROM xmonth" for c, label in views.METRIC_LABELS.items()),
    "xdock fill_dc metric",
    "value",
)
def metric_long(spark: SparkSession, sf: str) -> DataFrame:
    return views.metric_long(crossdock(spark, sf))


@query(
    "crossdock_kpis",
    """SELECT COUNT(DISTINCT xdock) AS docks, COUNT(DISTINCT fill_dc) AS fill_dcs, MAX(deviation_pct) AS largest_gap_pct,
    (SELECT xdock FROM xgap ORDER BY deviation_pct DESC NULLS LAST, xdock DESC LIMIT 1) AS largest_gap_dock FROM xgap""",
    "docks fill_dcs largest_gap_dock",
    "largest_gap_pct",
)
def crossdock_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.crossdock_kpis(gaps(spark, sf))


# ---- customer layer ---------------------------------------------------------


@query(
    "customer_type_summary",
    f"""SELECT *, records / CAST(SUM(records) OVER () AS DOUBLE) AS records_share, total_cost / SUM(total_cost) OVER () AS cost_share FROM (
    SELECT COALESCE(customer_type, 'Unknown') AS customer_type, COUNT(*) AS records, {q('cost_per_stop', 0.5)} AS median_cps,
      {mavg('cost_per_stop')} AS mean_cps, {msum('cost_per_stop')} AS total_cost FROM slim WHERE paid GROUP BY 1) t""",
    "customer_type records",
    "median_cps mean_cps total_cost records_share cost_share",
)
def customer_type_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.customer_type_summary(b.slim_extract(spark, sf))


@query("market_customer_gap", "SELECT * FROM mgap", "xdock customer_type records", "actual_cps expected_cps gap_pct")
def market_customer_gap(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.market_customer_gap(b.slim_extract(spark, sf))


@query("join_back_baseline", "SELECT * FROM mgap", "xdock customer_type", "expected_cps")
def join_back_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.market_customer_gap(b.slim_extract(spark, sf))


TOP_TYPES = "SELECT customer_type FROM mtype GROUP BY 1 ORDER BY SUM(records) DESC, customer_type LIMIT 8"


@query("semi_join_top", f"SELECT * FROM mtype WHERE customer_type IN ({TOP_TYPES})", "xdock customer_type records", "actual_cps")
def semi_join_top(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.keep_top_groups(rollups.market_customer_gap(b.slim_extract(spark, sf)), "customer_type", F.col("records"))


@query("gap_heat", f"SELECT xdock, customer_type, AVG(gap_pct) AS gap_pct FROM mgap WHERE customer_type IN ({TOP_TYPES}) GROUP BY 1, 2", "xdock customer_type", "gap_pct")
def gap_heat(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.gap_heat(rollups.market_customer_gap(b.slim_extract(spark, sf)))


# ---- reliability ------------------------------------------------------------

METRICS = rollups.COST_METRICS
CV_SQL = " UNION ALL ".join(
    f"""SELECT xdock, month, '{m}' AS metric, COUNT(*) AS n, AVG({m}) AS mean, {q(m, 0.5)} AS median, STDDEV_SAMP({m}) AS std,
    STDDEV_SAMP({m}) / NULLIF(AVG({m}), 0) AS cv FROM slim GROUP BY 1, 2"""
    for m in METRICS
)


@query("group_cv", CV_SQL, "xdock month metric n", "mean median std cv")
def group_cv(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.group_cv(b.slim_extract(spark, sf), ["xdock", "month"])


@query("cv_summary", f"SELECT metric, {q('cv', 0.5)} AS cv FROM ({CV_SQL}) t GROUP BY 1", "metric", "cv")
def cv_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.cv_summary(group_cv(spark, sf))


def _rank_sql(metric: str) -> str:
    return f"""SELECT '{metric}' AS metric, AVG(CASE WHEN NOT isnan(r) THEN r END) AS avg_rank_corr, COUNT(*) AS period_pairs FROM (
    SELECT period, CORR(ra, rb) AS r FROM (
      SELECT period, RANK() OVER (PARTITION BY period ORDER BY va) + (COUNT(*) OVER (PARTITION BY period, va) - 1) / 2e0 AS ra,
        RANK() OVER (PARTITION BY period ORDER BY vb) + (COUNT(*) OVER (PARTITION BY period, vb) - 1) / 2e0 AS rb
      FROM (SELECT n.period, p.v AS va, n.v AS vb FROM
        (SELECT m.*, s.before FROM (SELECT dc, year * 12 + month AS period, {q(metric, 0.5)} AS v FROM slim GROUP BY 1, 2) m
         JOIN (SELECT period, LAG(period) OVER (ORDER BY period) AS before FROM
           (SELECT DISTINCT year * 12 + month AS period FROM slim WHERE {metric} IS NOT NULL) d) s ON m.period = s.period) n
        JOIN (SELECT dc, year * 12 + month AS period, {q(metric, 0.5)} AS v FROM slim GROUP BY 1, 2) p
          ON p.dc = n.dc AND p.period = n.before WHERE n.v IS NOT NULL AND p.v IS NOT NULL) x) y
    GROUP BY period HAVING COUNT(*) >= 5) z"""


@query("rank_stability", " UNION ALL ".join(_rank_sql(m) for m in METRICS), "metric period_pairs", "avg_rank_corr")
def rank_stability(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.rank_stability(b.slim_extract(spark, sf))


PROFILED = {"cost_per_stop": "double", "normalized_cost": "double", "distance": "double", "year": "int"}


@query(
    "column_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS field, '{t}' AS dtype, COUNT(*) AS row_count, COUNT({c}) AS non_null, MIN({c}) AS lowest, MAX({c}) AS highest,
        AVG({c}) AS mean, STDDEV_SAMP({c}) AS std, {q(c, 0.25)} AS p25, {q(c, 0.5)} AS p50, {q(c, 0.75)} AS p75 FROM slim"""
        for c, t in PROFILED.items()
    ),
    "field dtype row_count non_null",
    "lowest highest mean std p25 p50 p75",
)
def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    profile = describe_columns(b.slim_extract(spark, sf), list(PROFILED))
    return profile.withColumnsRenamed({"column": "field", "rows": "row_count", "min": "lowest", "max": "highest"})


# ---- correlation, trend, similarity -----------------------------------------

CORRELATED = {
    "Routes": "routes", "Stops": "stops", "Totes": "totes", "Base$": "leg_base_cost", "Fuel$": "leg_fuel_cost",
    "Misc$": "leg_misc_cost", "Total$": "leg_total_cost", "$/Route": "avg_cost_per_route",
    "$/Stop": "avg_cost_per_stop", "$/Tote": "avg_cost_per_tote",
}
_labels = list(CORRELATED)


@query(
    "correlation_matrix",
    " UNION ALL ".join(
        f"""SELECT '{x}' AS "row", '{y}' AS "col", CORR({CORRELATED[x]}, {CORRELATED[y]}) AS corr FROM monthly"""
        for i, x in enumerate(_labels) for y in _labels[: i + 1]
    ),
    'row col',
    "corr",
)
def correlation_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.correlation_matrix(b.monthly_summary(spark, sf), CORRELATED)


@query(
    "ols_trend",
    """SELECT REGR_SLOPE(leg_total_cost, totes) AS slope, REGR_INTERCEPT(leg_total_cost, totes) AS intercept,
    REGR_R2(leg_total_cost, totes) AS r2, CAST(REGR_COUNT(leg_total_cost, totes) AS BIGINT) AS n FROM monthly
    WHERE leg_total_cost > 0 AND totes > 0""",
    "n",
    "slope intercept r2",
)
def ols_trend(spark: SparkSession, sf: str) -> DataFrame:
    rows = prepare.filter_positive_pair(b.monthly_summary(spark, sf), "leg_total_cost", "totes")
    return rollups.ols_trend(rows, "leg_total_cost", "totes")


def profile(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.carrier_profile(b.monthly_summary(spark, sf))


@query("carrier_profile", "SELECT * FROM prof", "carrier_name", " ".join(FEATURES))
def carrier_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile(spark, sf)


@query("standard_scale", "SELECT * FROM zs", "carrier_name", " ".join(FEATURES))
def standard_scale(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.standard_scale(profile(spark, sf), FEATURES)


def scaled(spark: SparkSession, sf: str) -> DataFrame:
    # one row per carrier, read several times by the comparison
    return pipelines.cut_lineage(standard_scale(spark, sf))


@query("cosine_similarity", "SELECT * FROM cosine", "a b", "similarity")
def cosine_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.cosine_similarity(scaled(spark, sf), "carrier_name", FEATURES)


@query("pairs_self_join", "SELECT * FROM cosine WHERE a < b", "a b", "similarity")
def pairs_self_join(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.carrier_pairs(scaled(spark, sf), "carrier_name", FEATURES)


@query(
    "top_similar_pairs",
    "SELECT a, b, ROUND(similarity, 4) AS similarity FROM cosine WHERE a < b ORDER BY 3 DESC, a, b LIMIT 10",
    "a b",
    "similarity",
)
def top_similar_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.top_similar_pairs(scaled(spark, sf), "carrier_name", FEATURES, n=10)
