"""Tables behind the scorecard and comparison screens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockledger.functions import columns as fx
from dockledger.functions.stats import scalars
from dockledger.operators import scoring as sc

GAP = "model_residual_pct"
TIES = ("market_id", "carrier")

# Bucket names by (model, normalized, benchmark) side of zero.
BUCKET_LABELS = {
    "Above Expected | Above Normalized | Above Cleansheet": "All 3 Above: Strong Overpay Support",
    "Above Expected | Above Normalized | Below Cleansheet": "Model + Normalized Above, Cleansheet Below",
    "Above Expected | Below Normalized | Above Cleansheet": "Model + Cleansheet Above, Normalized Below",
    "Above Expected | Below Normalized | Below Cleansheet": "Model Above Only",
    "Below Expected | Above Normalized | Above Cleansheet": "Normalized + Cleansheet Above, Model Below",
    "Below Expected | Above Normalized | Below Cleansheet": "Normalized Above Only",
    "Below Expected | Below Normalized | Above Cleansheet": "Cleansheet Above Only",
    "Below Expected | Below Normalized | Below Cleansheet": "All 3 Below: Strong Underpay / Low-Cost Support",
}
# The cost measures compared for one market.
COMPARISON_METRICS = {
    "Actual CPS": "actual_median_cps",
    "Expected CPS": "pred_p50",
    "Normalized Cost": "median_normalized_cost",
    "Conservative Cleansheet": "median_benchmark_conservative",
    "Aggressive Cleansheet": "median_benchmark_aggressive",
}
# Display names of the cost columns of a crossdock month.
METRIC_LABELS = {
    "cost_per_stop": "Cost per stop",
    "normalized_cost": "Normalized cost",
    "benchmark_conservative": "Cleansheet conservative",
    "benchmark_aggressive": "Cleansheet aggressive",
}
# Weights of the two combined scores.
VALIDATION_WEIGHTS = {"model_residual_pct": 0.50, "aggressive_gap_pct": 0.30, "normalized_gap_pct": 0.20}
THREE_SIGNAL_WEIGHTS = {"model_residual_pct": 0.40, "normalized_gap_pct": 0.30, "aggressive_gap_pct": 0.30}


def _top(df: DataFrame, *order: Column, n: int) -> DataFrame:
    return df.orderBy(*order, *TIES).limit(n)


def top_overpay(scored: DataFrame, n: int = 30) -> DataFrame:
    """V1: overpay candidates by gap."""
    rows = scored.filter(F.col("classification").isin(sc.STRONG_OVER, sc.POSSIBLE_OVER))
    return _top(rows, F.desc(GAP), n=n).withColumn("label", fx.group_label("market_id", "carrier"))


def top_underpay(scored: DataFrame, n: int = 30) -> DataFrame:
    """V2: underpay candidates by gap."""
    rows = scored.filter(F.col("classification").isin(sc.STRONG_UNDER, sc.POSSIBLE_UNDER))
    return _top(rows, F.asc(GAP), n=n).withColumn("label", fx.group_label("market_id", "carrier"))


def cost_band_top(scored: DataFrame, n: int = 30) -> DataFrame:
    """V3: largest gaps with their expected band."""
    return _top(scored.filter(F.col(GAP).isNotNull()), F.desc(GAP), n=n)


def actual_vs_expected(scored: DataFrame) -> DataFrame:
    """V4: groups with both costs, and the common axis maximum."""
    both = scored.dropna(subset=["actual_median_cps", "pred_p50"])
    s = scalars(both, axis_max=F.max(F.greatest("actual_median_cps", "pred_p50")))
    return both.withColumn("axis_max", s["axis_max"])


def benchmark_triangulation(scored: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """V5: model and benchmark gap clipped for plotting; the originals stay."""
    clean = scored.dropna(subset=["aggressive_gap_pct", GAP])
    s = scalars(
        clean,
        x_low=F.percentile("aggressive_gap_pct", F.lit(low)),
        x_high=F.percentile("aggressive_gap_pct", F.lit(high)),
        y_low=F.percentile(GAP, F.lit(low)),
        y_high=F.percentile(GAP, F.lit(high)),
    )
    return clean.withColumns(
        {
            "benchmark_gap_plot": fx.clip("aggressive_gap_pct", s["x_low"], s["x_high"]),
            "model_gap_plot": fx.clip(GAP, s["y_low"], s["y_high"]),
        }
    )


def triangulation_labels(scored: DataFrame, n: int = 15) -> DataFrame:
    """V6: the largest groups."""
    return _top(scored.dropna(subset=["aggressive_gap_pct", GAP]), F.desc("paid_records"), n=n)


def top_quadrant(scored: DataFrame, n: int = 25) -> DataFrame:
    """V6: largest gaps, more records first among equals."""
    return _top(scored.dropna(subset=["aggressive_gap_pct", GAP]), F.desc(GAP), F.desc("paid_records"), n=n)


def cost_comparison_long(scored: DataFrame, market: str | None = None) -> DataFrame:
    """V7: the cost measures of one market (or of all), long form."""
    rows = scored if market is None else scored.filter(F.col("market_id") == market)
    pairs = [
        F.struct(F.lit(label).alias("metric"), F.col(c).cast("double").alias("value"))
        for label, c in COMPARISON_METRICS.items() if c in scored.columns
    ]
    return rows.select("market_id", "carrier", F.inline(F.array(*pairs))).filter(F.col("value").isNotNull())


def normalized_gap(scored: DataFrame) -> DataFrame:
    """V8: actual over normalized cost."""
    return scored.dropna(subset=["median_normalized_cost", GAP]).withColumn(
        "normalized_gap_pct", fx.ratio_gap("actual_median_cps", "median_normalized_cost")
    )


def _weighted(weights: dict[str, float]) -> Column:
    return sum((F.lit(w) * F.col(c) for c, w in weights.items()), F.lit(0.0))


def validation_score(scored: DataFrame) -> DataFrame:
    """V9: weighted mean of the model, benchmark and normalized gap."""
    rows = normalized_gap(scored).filter(F.col("aggressive_gap_pct").isNotNull())
    return rows.withColumn("validation_score", _weighted(VALIDATION_WEIGHTS))


def signal_buckets(scored: DataFrame) -> DataFrame:
    """Three signs, eight named buckets; a gap of exactly 0 is below."""
    complete = scored.dropna(
        subset=["actual_median_cps", "pred_p50", "median_normalized_cost", "median_benchmark_aggressive", GAP, "paid_records"]
    ).withColumn("normalized_gap_pct", fx.ratio_gap("actual_median_cps", "median_normalized_cost"))

    def side(column: str, name: str) -> Column:
        return F.when(F.col(column) > 0, f"Above {name}").otherwise(f"Below {name}")

    out = complete.withColumns(
        {
            "model_signal": side(GAP, "Expected"),
            "normalized_signal": side("normalized_gap_pct", "Normalized"),
            "benchmark_signal": side("aggressive_gap_pct", "Cleansheet"),
        }
    ).withColumn("signal_bucket", F.concat_ws(" | ", "model_signal", "normalized_signal", "benchmark_signal"))
    names = F.create_map(*[F.lit(x) for kv in BUCKET_LABELS.items() for x in kv])
    return out.withColumn("bucket_label", F.coalesce(names[F.col("signal_bucket")], F.col("signal_bucket")))


def three_signal_score(bucketed: DataFrame) -> DataFrame:
    """Weighted gap, and the same scaled by volume."""
    return bucketed.withColumn("three_signal_score", _weighted(THREE_SIGNAL_WEIGHTS)).withColumn(
        "volume_adjusted_score", F.col("three_signal_score") * F.log1p("paid_records")
    )


def bucket_detail(bucketed: DataFrame, label: str) -> DataFrame:
    """The groups of one bucket by volume-adjusted score."""
    return bucketed.filter(F.col("bucket_label") == label).orderBy(F.desc("volume_adjusted_score"), *TIES)


def class_detail(scored: DataFrame, label: str) -> DataFrame:
    """The groups of one class by gap."""
    return scored.filter(F.col("classification") == label).orderBy(F.desc(GAP), *TIES)


def class_tops(scored: DataFrame, n: int = 50) -> DataFrame:
    """The first ``n`` groups of every class: overpay and normal by gap, underpay
    by gap ascending, weak evidence by volume."""
    sort_key = (
        F.when(F.lower("classification").contains("underpay"), -F.col(GAP))
        .when(F.col("classification") == sc.NO_EVIDENCE, F.col("paid_records").cast("double"))
        .otherwise(F.col(GAP))
    )
    order = Window.partitionBy("classification").orderBy(F.desc_nulls_last("__sort"), *TIES)
    ranked = scored.withColumn("__sort", sort_key).withColumn("class_rank", F.row_number().over(order))
    return ranked.filter(F.col("class_rank") <= n).drop("__sort")


def metric_long(markets: DataFrame, ids: Sequence[str] = ("xdock", "fill_dc")) -> DataFrame:
    """Cost columns as (metric label, value)."""
    present = [c for c in METRIC_LABELS if c in markets.columns]
    names = F.create_map(*[F.lit(x) for kv in METRIC_LABELS.items() for x in kv])
    return markets.unpivot(list(ids), present, "metric", "value").withColumn("metric", names[F.col("metric")])


def gap_ranking(markets: DataFrame) -> DataFrame:
    """Markets by fill DC, then gap."""
    return markets.orderBy("fill_dc", "deviation_pct", "xdock")


def _money(c: str) -> Column:
    # two decimals and thousands commas, sign after the currency mark
    return F.coalesce(F.concat(F.lit("$"), F.format_number(F.col(c), 2)), F.lit("n/a"))


def _percent(c: str) -> Column:
    scaled = F.col(c) * 100.0
    sign = F.when(scaled >= 0, "+").otherwise("")
    return F.coalesce(F.concat(sign, F.format_number(scaled, 1), F.lit("%")), F.lit("n/a"))


def row_narrative(scored: DataFrame) -> DataFrame:
    """Explanation sentences of each group, as one text. The sentences are fixed
    values."""
    signal = F.concat(F.lit("Signal: "), F.col("classification"), F.lit(" with "), F.col("confidence"), F.lit(" confidence."))
    basis = F.coalesce(
        F.concat(F.lit(" based on "), F.format_number("paid_records", 0), F.lit(" records with CPS.")), F.lit(".")
    )
    cost = F.concat(
        F.lit("Actual CPS is "), _money("actual_median_cps"), F.lit(" versus expected CPS of "), _money("pred_p50"),
        F.lit(", a gap of "), _percent(GAP), basis,
    )
    normalized = F.when(
        F.col("median_normalized_cost").isNotNull(),
        F.concat(
            F.lit("Normalized cost is "), _money("median_normalized_cost"),
            F.lit(". Use it as supporting evidence, not the final decision rule."),
        ),
    )
    low, high = "median_benchmark_conservative", "median_benchmark_aggressive"
    benchmark = F.when(
        F.col(low).isNotNull() | F.col(high).isNotNull(),
        F.concat(F.lit("Cleansheet range: conservative "), _money(low), F.lit(", aggressive "), _money(high), F.lit(".")),
    )
    note = F.when(F.col("business_note") != "", F.concat(F.lit("Business note: "), F.col("business_note")))
    return scored.withColumn("narrative", F.concat_ws(" ", signal, cost, normalized, benchmark, note))


def class_narrative(detail: DataFrame, selected_class: str) -> DataFrame:
    """The text about one class, one row. ``detail`` holds business-view rows of
    the class; the first is the one with the largest gap. Sentences are fixed values."""
    gap, benchmark_gap = "CPS Gap vs Expected %", "Gap vs Aggressive Cleansheet %"
    name = F.coalesce(F.col("Market Name"), F.col("Market / Xdock"), F.lit("n/a"))
    sentences = F.concat_ws(
        " ",
        F.concat(F.lit(f"For {selected_class}, the largest gap is "), name, F.lit(" at "), _percent(gap), F.lit(" versus expected CPS.")),
        F.concat(
            F.lit("Top actual CPS is "), _money("Actual CPS"), F.lit(" versus expected CPS of "), _money("Expected CPS"),
            F.lit("; records with CPS count is "), F.format_number(F.coalesce("Records With CPS", F.lit(0)), 0), F.lit("."),
        ),
        F.when(
            F.col("Cleansheet Aggressive").isNotNull(),
            F.concat(F.lit("Against aggressive cleansheet, the top group is "), _percent(benchmark_gap), F.lit(" from benchmark.")),
        ),
        F.when(
            F.col("Normalization Sensitivity") > 0.40,
            F.lit("The top group is sensitive to normalization assumptions, so review the multiplier inputs before making a pricing decision."),
        ),
    )
    rank = F.struct(F.col(gap).isNotNull(), F.col(gap), F.col("Market / Xdock"))
    best = detail.filter(F.col("Signal / Classification") == selected_class).agg(F.max_by(sentences, rank).alias("text"))
    return best.select(F.coalesce("text", F.lit(f"No market groups currently fall into {selected_class}.")).alias("narrative"))


def class_summary_row(scored: DataFrame) -> DataFrame:
    """The counts used by the summary text."""

    def count(*classes: str) -> Column:
        return F.count_if(F.col("classification").isin(*classes))

    return scored.agg(
        F.count(F.lit(1)).alias("total"),
        count(sc.STRONG_OVER).alias("strong_overpay"),
        count(sc.POSSIBLE_OVER).alias("possible_overpay"),
        count(sc.STRONG_UNDER).alias("strong_underpay"),
        count(sc.POSSIBLE_UNDER).alias("possible_underpay"),
        count(sc.NO_EVIDENCE).alias("not_enough_evidence"),
    )
