"""Registered queries: learned bands and anomaly scores. Where SQL cannot learn
them, the tests check what must hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockledger.operators import anomaly, boosting, multipliers, rollups
from dockledger.operators import scoring as sc
from dockledger.plans import bindings as b
from dockledger.plans import pipelines
from dockledger.plans.registry import query
from dockledger.plans.scorecards import KEYS, markets, scored
from dockledger.plans.bindings_sql import SCORE_DRIVERS
from dockledger.session import cut_lineage, settled

LEARN = sc.Thresholds(min_group_n=20)
NUMERIC = ["paid_records", "zero_rate", "median_distance", "median_route_stop_count", "median_route_tote_count"]


LEARNING = "SELECT * FROM mk WHERE actual_median_cps > 0 AND paid_records >= 20"


@query(
    "impute_encode",
    f"""WITH g AS ({LEARNING}) SELECT xdock, carrier_cd, DENSE_RANK() OVER (ORDER BY xdock) - 1 AS x_xdock,
    DENSE_RANK() OVER (ORDER BY carrier_cd) - 1 AS x_carrier_cd,
    {', '.join(f'COALESCE({c}, (SELECT QUANTILE_CONT({c}, 0.5) FROM g), 0) AS x_{c}' for c in NUMERIC)} FROM g""",
    "xdock carrier_cd",
    " ".join(f"x_{c}" for c in NUMERIC) + " x_xdock x_carrier_cd",
)
def impute_encode(spark: SparkSession, sf: str) -> DataFrame:
    return boosting.impute_encode(sc.model_groups(markets(spark, sf), LEARN), NUMERIC, KEYS)


@query(
    "train_test_split",
    f"""SELECT xdock, carrier_cd, CAST('0x' || SUBSTR(MD5(CONCAT_WS('|', xdock, carrier_cd, '42')), 1, 8) AS BIGINT) % 10000 < 2000 AS is_test
    FROM ({LEARNING}) g""",
    "xdock carrier_cd is_test",
)
def train_test_split(spark: SparkSession, sf: str) -> DataFrame:
    return boosting.train_test_split(sc.model_groups(markets(spark, sf), LEARN), KEYS)


def fitted(spark: SparkSession, sf: str) -> tuple[DataFrame, boosting.QuantileBoost]:
    groups = markets(spark, sf)
    numeric, categorical = sc.feature_columns(groups, KEYS)
    split = boosting.train_test_split(sc.model_groups(groups, LEARN), KEYS)
    encoder = boosting.fit_encoder(split.filter(~F.col("is_test")), numeric, categorical)
    data = cut_lineage(encoder.apply(split))
    return data, boosting.fit_quantile_boost(data.filter(~F.col("is_test")), encoder.features)


@query("quantile_boost", None, "xdock carrier_cd is_test", "target pred_p10 pred_p50 pred_p90")
def quantile_boost(spark: SparkSession, sf: str) -> DataFrame:
    data, model = fitted(spark, sf)
    return model.predict(data)


@query("model_metrics", None, "model_status groups_total model_groups feature_count", "mae_cost median_abs_error_cost r2_log_target")
def model_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.modeled_scorecard(b.slim_extract(spark, sf), KEYS, LEARN, drivers=SCORE_DRIVERS)[1]


@query("score_bands", None, "xdock carrier_cd classification confidence", "actual_median_cps pred_p10 pred_p50 pred_p90")
def score_bands(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.modeled_scorecard(b.slim_extract(spark, sf), KEYS, LEARN, drivers=SCORE_DRIVERS)[0]


# ---- the same operators on predictions that SQL can form ---------------------


@query(
    "model_metrics_given",
    f"""SELECT COUNT(*) AS rows, AVG(ABS(actual_median_cps - GREATEST(0, actual_mean_cps))) AS mae_cost,
    QUANTILE_CONT(ABS(actual_median_cps - GREATEST(0, actual_mean_cps)), 0.5) AS median_abs_error_cost,
    1 - SUM(POWER(LN(1 + actual_median_cps) - LN(1 + actual_mean_cps), 2)) / NULLIF(VAR_POP(LN(1 + actual_median_cps)) * COUNT(*), 0) AS r2_log_target
    FROM ({LEARNING}) g""",
    "rows",
    "mae_cost median_abs_error_cost r2_log_target",
)
def model_metrics_given(spark: SparkSession, sf: str) -> DataFrame:
    """The mean of a group as the prediction of its median."""
    groups = sc.model_groups(markets(spark, sf), LEARN)
    return boosting.model_metrics(groups.withColumn("pred_p50", F.log1p("actual_mean_cps")))


GIVEN_BANDS = {"pred_p10": -0.25, "pred_p50": 0.0, "pred_p90": -5.0}  # out of order on purpose


@query(
    "score_bands_given",
    f"""SELECT xdock, carrier_cd, LIST_SORT(v)[1] AS pred_p10, LIST_SORT(v)[2] AS pred_p50, LIST_SORT(v)[3] AS pred_p90 FROM (
    SELECT xdock, carrier_cd, [{', '.join(f'CASE WHEN actual_median_cps > 0 THEN GREATEST(0, EXP(LN(1 + actual_mean_cps) + {d}e0) - 1) END' for d in GIVEN_BANDS.values())}] AS v FROM mk) t""",
    "xdock carrier_cd",
    "pred_p10 pred_p50 pred_p90",
)
def score_bands_given(spark: SparkSession, sf: str) -> DataFrame:
    """Log-scale bands around a group's mean, as cost and in order."""
    groups = markets(spark, sf).withColumns({c: F.log1p("actual_mean_cps") + F.lit(d) for c, d in GIVEN_BANDS.items()})
    return sc.monotone_bands(boosting.bands_in_cost(groups, list(GIVEN_BANDS), F.col("actual_median_cps") > 0), list(GIVEN_BANDS))


ROW_GIVEN = {"pred_p10": "30e0 + month", "pred_p25": "34e0 + month", "pred_p50": "40e0 + month", "pred_p75": "44e0 + month * 2e0", "pred_p90": "50e0 + month * 3e0"}
_given = ", ".join(f"CASE WHEN cost_per_stop > 0 THEN {e} END AS {c}" for c, e in ROW_GIVEN.items())
_SENSITIVITY = "normalized_cost / NULLIF(cost_per_stop, 0) - 1"


@query(
    "row_scorecard_given",
    f"""SELECT *, actual_median_cps / NULLIF(pred_p50, 0) - 1 AS model_residual_pct, actual_median_cps > pred_p90 AS above_p90,
      actual_median_cps > pred_p75 AS above_p75, actual_median_cps < pred_p10 AS below_p10, actual_median_cps < pred_p25 AS below_p25 FROM (
      SELECT xdock, month, COUNT(*) AS records, COUNT(*) FILTER (WHERE paid) AS paid_records, {', '.join(f'QUANTILE_CONT({c}, 0.5) AS {c}' for c in ROW_GIVEN)},
        QUANTILE_CONT(cost_per_stop, 0.5) AS actual_median_cps, QUANTILE_CONT(cost_per_stop, 0.9) AS actual_p90_cps,
        QUANTILE_CONT(cost_per_stop / NULLIF(pred_p50, 0) - 1, 0.5) AS median_row_residual_pct,
        QUANTILE_CONT({_SENSITIVITY}, 0.5) AS norm_sensitivity_median_pct, QUANTILE_CONT(ABS({_SENSITIVITY}), 0.5) AS norm_sensitivity_abs_pct
      FROM (SELECT *, {_given} FROM slim) r GROUP BY xdock, month) g""",
    "xdock month records paid_records above_p90 above_p75 below_p10 below_p25",
    f"actual_median_cps actual_p90_cps {' '.join(ROW_GIVEN)} median_row_residual_pct model_residual_pct norm_sensitivity_median_pct norm_sensitivity_abs_pct",
)
def row_scorecard_given(spark: SparkSession, sf: str) -> DataFrame:
    """The row-level scorecard on bands that are a function of the month."""
    paid = F.col("cost_per_stop") > 0
    rows = multipliers.row_sensitivity(b.slim_extract(spark, sf)).withColumns({c: F.when(paid, F.expr(e)) for c, e in ROW_GIVEN.items()})
    return rollups.row_scorecard(sc.residuals(rows, "cost_per_stop", "pred_p50", prefix="row"), ["xdock", "month"])


@query(
    "anomaly_flag_given",
    "SELECT xdock, carrier_cd, COALESCE(zero_rate >= (SELECT QUANTILE_CONT(zero_rate, 0.9) FROM mk), FALSE) AS anomaly_flag FROM mk",
    "xdock carrier_cd anomaly_flag",
)
def anomaly_flag_given(spark: SparkSession, sf: str) -> DataFrame:
    """The share of unpaid rows as the score."""
    return anomaly.anomaly_flag(markets(spark, sf).withColumn("anomaly_score", F.col("zero_rate")))


# ---- row-level model --------------------------------------------------------


# The sample is all paid rows up to 90,000, which a cross-check at sf0.01 stays below.
@query("row_model_sample", "SELECT *, LN(1 + cost_per_stop) AS target, 1e0 AS weight FROM slim WHERE cost_per_stop > 0", " ".join(b.ORDER_COLS), "target weight")
def row_model_sample(spark: SparkSession, sf: str) -> DataFrame:
    return boosting.row_model_sample(b.slim_extract(spark, sf), b.ORDER_COLS)


def model_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The slim extract with the further columns that the row-level model can use."""
    extra = b.delivery_events(spark, sf).select(*b.ORDER_COLS, "delivery_type", "charge_type", "stop_count", "tote_count", "route_count")
    described = F.concat(F.lit("charge "), "charge_type")
    rows = b.slim_extract(spark, sf)
    # one further row for each of the extract: rows equal in all order columns are one;
    # written, so that the shuffle that tells them apart is gone before the next one
    extra = cut_lineage(extra.dropDuplicates(b.ORDER_COLS))
    return rows.join(extra, b.ORDER_COLS).withColumn("charge_description", described)


@query(
    "row_scorecard",
    None,
    "xdock month records paid_records",
    "actual_median_cps pred_p10 pred_p25 pred_p50 pred_p75 pred_p90 median_row_residual_pct model_residual_pct norm_sensitivity_abs_pct",
)
def row_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["xdock", "month"]
    # what the scored rows were made of is gone before their quantiles take room
    rows = settled(spark, lambda: rollups.scorecard_rows(pipelines.modeled_rows(model_rows(spark, sf), b.ORDER_COLS)[0], keys))
    return rollups.row_scorecard(rows, keys, written=True)


@query("row_model_report", None, "model_status paid_rows_total model_rows_used feature_count", "mae_cost median_abs_error_cost r2_log_target")
def row_model_report(spark: SparkSession, sf: str) -> DataFrame:
    return pipelines.modeled_rows(model_rows(spark, sf), b.ORDER_COLS)[1]


MONTHS = range(1, 13)


@query(
    "residual_month_pivot",
    f"""SELECT xdock, {', '.join(f'MAX(CASE WHEN month = {m} THEN med / p50 - 1 END) AS m{m}' for m in MONTHS)} FROM (
    SELECT xdock, month, med, (SELECT COALESCE(QUANTILE_CONT(CASE WHEN med > 0 AND paid_records >= 20 THEN med END, 0.5), QUANTILE_CONT(med, 0.5))
      FROM (SELECT QUANTILE_CONT(CASE WHEN paid THEN cost_per_stop END, 0.5) AS med, COUNT(*) FILTER (WHERE paid) AS paid_records
            FROM slim GROUP BY xdock, month) e) AS p50
    FROM (SELECT xdock, month, QUANTILE_CONT(CASE WHEN paid THEN cost_per_stop END, 0.5) AS med FROM slim GROUP BY 1, 2) t) u GROUP BY 1""",
    "xdock",
    " ".join(f"m{m}" for m in MONTHS),
)
def residual_month_pivot(spark: SparkSession, sf: str) -> DataFrame:
    groups = rollups.market_groups(b.slim_extract(spark, sf), ["xdock", "month"], [])
    banded = sc.residuals(sc.benchmark_bands(cut_lineage(groups), LEARN))
    return rollups.residual_month_pivot(banded).withColumnsRenamed({str(m): f"m{m}" for m in MONTHS})


@query("isolation_score", None, "market_id carrier", "anomaly_score")
def isolation_score(spark: SparkSession, sf: str) -> DataFrame:
    return anomaly.isolation_score(scored(spark, sf), ["market_id", "carrier"])


@query("anomaly_flag", None, "market_id carrier anomaly_flag", "anomaly_score")
def anomaly_flag(spark: SparkSession, sf: str) -> DataFrame:
    cards = anomaly.isolation_score(scored(spark, sf), ["market_id", "carrier"])
    return anomaly.anomaly_flag(cut_lineage(cards))
