import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from dockledger.operators import geography, lookups, multipliers, prepare, profiles, rollups, views
from dockledger.operators import scoring as sc
from dockledger.plans import bindings
from dockledger.session import partitions_of


# ---- joins ------------------------------------------------------------------


def test_customer_join_fans_out_and_audits(spark):
    events = spark.createDataFrame([("8170-r1-2-c9-2026-05-04",), ("8170-R1-3-c9-2026-05-04",), (None,)], "job_id string")
    customers = spark.createDataFrame(
        [("8170 ", "C9", "r1", "2", "RX", "one"), ("8170", "c9", "R1", "2", "RX", "two")],
        "fill_dc_id string, account_id string, route_no string, stop_no string, customer_type string, customer_name string",
    )
    names = sorted(str(r["customer_name"]) for r in lookups.join_customers(events, customers).collect())
    assert names == ["None", "None", "one", "two"]
    audit = lookups.join_audit(events, customers).first()
    assert (audit["rows"], audit["duplicate_key_groups"], audit["match_rate"]) == (4, 1, 0.5)


def test_multiplier_join_drops_and_reports(spark):
    rows = spark.createDataFrame([(" x.c ", 2026, 5), ("Y.C", 2026, 5)], "dc string, year int, month int")
    table = spark.createDataFrame([("X.C", 2026, 5, 1.2)], "xdock string, year int, month int, m double")
    assert [r["m"] for r in lookups.join_multiplier(rows, table, "m").collect()] == [1.2]
    assert [r["dock_key"] for r in lookups.dropped_markets(rows, table).collect()] == ["Y.C"]


def test_union_fills_missing_columns(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([(2,)], "i int")
    assert sorted((r["i"], r["s"]) for r in lookups.union_sources([a, b]).collect()) == [(1, "x"), (2, None)]


# ---- geography --------------------------------------------------------------


def brute_previous(stops):
    def order(s):
        try:
            return (0, float(s["stop_id"]), s["stop_id"])
        except ValueError:
            return (1, 0.0, s["stop_id"])

    out = {}
    for day, group in itertools.groupby(sorted(stops, key=lambda s: (s["route_id"], *order(s))), key=lambda s: s["route_id"]):
        last = None
        for s in group:
            out[(day, s["stop_id"])] = (last["dest_lat"], last["dest_lon"]) if last else (s["origin_lat"], s["origin_lon"])
            last = s
    return out


@pytest.mark.parametrize("chunk", [2, 7, 1000])
def test_previous_stop_across_runs(spark, chunk):
    ids = ["2", "10", "A", "AB", "B1", "9", "100", "3", "2005", "77", "02"]
    stops = [
        {"route_id": r, "stop_id": s, "origin": "O", "fill_dc": "F", "route_date": "2026-05-04", "dest_lat": float(i), "dest_lon": float(-i),
         "origin_lat": 50.0, "origin_lon": None}
        for r in ("R1", "R2") for i, s in enumerate(ids) if not (r == "R2" and i > 5)
    ]
    df = spark.createDataFrame(
        stops,
        "route_id string, stop_id string, origin string, fill_dc string, route_date string, dest_lat double, dest_lon double, origin_lat double, origin_lon double",
    )
    got = {(r["route_id"], r["stop_id"]): (r["prev_lat"], r["prev_lon"]) for r in geography.previous_stop(df, chunk).collect()}
    assert got == brute_previous(stops)


def test_single_stop_days_and_missing_baseline(spark):
    days = spark.createDataFrame(
        [("XD_1_A.C", "2026-05-04", 2, 10.0, 5.0), ("P_1.C", "2026-05-04", 3, 6.0, 2.0), ("P_1.C", "2026-05-05", 1, 90.0, 90.0), ("XD_1_A.C", "2026-06-04", 2, 8.0, 4.0)],
        "origin string, d string, distinct_stops long, total_miles double, miles_per_stop double",
    ).withColumn("route_date", F.to_date("d"))
    out = {(r["origin"], r["month"]): r for r in geography.geography_multiplier(geography.origin_month_summary(days)).collect()}
    assert out[("P_1.C", 5)]["route_days"] == 1 and out[("P_1.C", 5)]["geography_multiplier"] == 1.0
    assert out[("XD_1_A.C", 5)]["geography_multiplier"] == round(min(1.5, 2.5**0.3), 2)
    assert out[("XD_1_A.C", 6)]["geography_multiplier"] is None  # no plain origin that month


# ---- multipliers ------------------------------------------------------------


def test_iqr_keeps_null_distances(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 2, 3, 3, 3, 4, 500]] + [(None,)], "distance double")
    kept = sorted((r["distance"] for r in multipliers.iqr_filter(df, "distance").collect()), key=lambda v: (v is None, v))
    assert kept == [1, 2, 2, 3, 3, 3, 4, None]
    share = multipliers.outlier_share(df, "distance").first()
    assert (share["outliers"], share["total"], share["max_kept"]) == (1, 9, 4.0)


def test_monthly_baseline_and_winsor(spark):
    data = [(f"d{i}", 2026, m, float(i * m)) for m in (5, 6) for i in range(1, 12)]
    df = spark.createDataFrame(data, "xdock string, year int, month int, avg_miles_per_stop double")
    out = multipliers.density_table(df).toPandas()
    for _, part in out.groupby("month"):
        raw = part["avg_miles_per_stop"] / part["avg_miles_per_stop"].median()
        expected = raw.clip(raw.quantile(0.1), raw.quantile(0.9))
        assert np.allclose(part["density_multiplier"], expected)


def test_geo_mean_and_baseline_gap(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "shipment_multiplier double, density_multiplier double")
    assert multipliers.geo_mean(df).first()["geo_mean"] == pytest.approx((2 * 3 * 3) ** (1 / 3))
    markets = spark.createDataFrame([("f", "a", 1.0), ("f", "b", 2.0), ("f", "c", 6.0), (None, "d", 3.0)], "fill_dc string, xdock string, normalized_cost double")
    got = {r["xdock"]: (r["deviation_pct"], r["status"]) for r in multipliers.dc_baseline_gap(markets).collect()}
    assert got == {"a": (-50.0, "Below baseline"), "b": (0.0, "At baseline"), "c": (200.0, "Above baseline"), "d": (None, "At baseline")}


# ---- scoring ----------------------------------------------------------------

BASE = {
    "xdock": "XD_1_A_B.C", "records": 100, "paid_records": 90, "zero_rate": 0.1, "actual_median_cps": 100.0, "pred_p10": 80.0, "pred_p25": 90.0,
    "pred_p50": 100.0, "pred_p75": 110.0, "pred_p90": 120.0, "median_normalized_cost": 100.0, "median_benchmark_conservative": 110.0,
    "median_benchmark_aggressive": 95.0,
}
TYPES = ", ".join(f"{k} {'string' if k == 'xdock' else 'int' if 'records' in k else 'double'}" for k in BASE)


@pytest.mark.parametrize(
    "change, label, level",
    [
        ({}, sc.NORMAL, "High"),
        ({"actual_median_cps": 125.0}, sc.STRONG_OVER, "High"),
        ({"actual_median_cps": 110.00000001}, sc.POSSIBLE_OVER, "High"),
        ({"actual_median_cps": 119.0}, sc.POSSIBLE_OVER, "High"),
        ({"actual_median_cps": 75.0}, sc.STRONG_UNDER, "High"),
        ({"actual_median_cps": 89.0}, sc.POSSIBLE_UNDER, "High"),
        ({"actual_median_cps": 125.0, "paid_records": 30, "zero_rate": 0.5}, sc.POSSIBLE_OVER, "Low"),
        ({"paid_records": 29}, sc.NO_EVIDENCE, "Low"),
        ({"paid_records": 89}, sc.NORMAL, "Medium"),
        ({"zero_rate": 0.35}, sc.NORMAL, "High"),
        ({"zero_rate": None}, sc.NORMAL, "Medium"),
        ({"pred_p50": None}, sc.NO_EVIDENCE, "High"),
        ({"actual_median_cps": None}, sc.NO_EVIDENCE, "High"),
        ({"median_normalized_cost": None, "median_benchmark_aggressive": None}, sc.NORMAL, "High"),
        ({"median_normalized_cost": 300.0}, sc.NORMAL, "Medium"),
    ],
)
def test_classes_at_the_thresholds(spark, change, label, level):
    df = spark.createDataFrame([tuple({**BASE, **change}.values())], TYPES)
    row = sc.score_markets(df, ["xdock"]).first()
    assert (row["classification"], row["confidence"]) == (label, level)


def test_notes_and_view(spark):
    rows = [{**BASE, "actual_median_cps": 125.0}, {**BASE, "actual_median_cps": 75.0}, {**BASE, "paid_records": 1}]
    scored = sc.score_markets(spark.createDataFrame([tuple(r.values()) for r in rows], TYPES), ["xdock"])
    assert [r["business_note"] for r in scored.collect()] == [sc.NOTE_HIGH, sc.NOTE_LOW, sc.NOTE_WEAK]
    view = sc.business_view(scored)
    assert view.columns[:3] == ["Market / Xdock", "Market Name", "Carrier"]
    assert view.first()["Market Name"] == "A B" and view.first()["Carrier"] == "All carriers"
    text = views.row_narrative(scored).first()["narrative"]
    assert text.startswith("Signal: Strong overpay candidate with High confidence. Actual CPS is $125.00 versus expected CPS of $100.00, a gap of +25.0% based on 90 records with CPS.")


def test_benchmark_bands_fall_back_to_all_groups(spark):
    df = spark.createDataFrame([(float(v), 5) for v in range(1, 12)], "actual_median_cps double, paid_records int")
    row = sc.benchmark_bands(df).first()
    assert (row["pred_p10"], row["pred_p50"], row["pred_p90"], row["pred_p25"]) == (2.0, 6.0, 10.0, None)


def test_monotone_bands_put_nulls_last(spark):
    df = spark.createDataFrame([(3.0, None, 1.0)], "a double, b double, c double")
    assert tuple(sc.monotone_bands(df, ["a", "b", "c"]).first()) == (1.0, 3.0, None)


def test_all_eight_buckets(spark):
    gaps = list(itertools.product([0.2, 0.0], [80.0, 100.0], [80.0, 100.0]))
    rows = [(f"m{i}", "c", 100.0, 90.0, n, b, g, 100.0 / b - 1, 10) for i, (g, n, b) in enumerate(gaps)]
    df = spark.createDataFrame(
        rows,
        "market_id string, carrier string, actual_median_cps double, pred_p50 double, median_normalized_cost double, "
        "median_benchmark_aggressive double, model_residual_pct double, aggressive_gap_pct double, paid_records int",
    )
    out = views.three_signal_score(views.signal_buckets(df)).collect()
    assert {r["bucket_label"] for r in out} == set(views.BUCKET_LABELS.values())
    by_id = {r["market_id"]: r for r in out}
    assert by_id["m7"]["bucket_label"].startswith("All 3 Below")  # a gap of exactly 0 is below
    assert by_id["m0"]["three_signal_score"] == pytest.approx(0.4 * 0.2 + 0.3 * 0.25 + 0.3 * 0.25)


# ---- rollups and similarity -------------------------------------------------


def test_market_groups_keep_unpaid_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 0.0), ("b", None)], "xdock string, cost_per_stop double")
    got = {r["xdock"]: r for r in rollups.market_groups(df, ["xdock"], []).collect()}
    assert (got["a"]["records"], got["a"]["paid_records"], got["a"]["actual_median_cps"]) == (3, 2, 2.0)
    assert (got["b"]["zero_records"], got["b"]["actual_median_cps"]) == (1, None)


def test_rank_stability_uses_previous_present_month(spark):
    data = [(f"d{i}", 2026, m, float(v)) for m, vs in {1: range(6), 3: range(6), 4: range(5, -1, -1)}.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(data, "dc string, year int, month int, cost_per_stop double")
    row = rollups.rank_stability(df, metrics=["cost_per_stop"]).first()
    assert row["period_pairs"] == 2 and row["avg_rank_corr"] == pytest.approx(0.0)


def test_mom_change_and_positive_filters(spark):
    df = spark.createDataFrame([("2026-01-01", 10.0), ("2026-03-01", 15.0)], "month_start string, leg_total_cost double")
    assert [r["mom_pct"] for r in rollups.mom_change(df).orderBy("month_start").collect()] == [None, 50.0]
    seqs = spark.createDataFrame([(1.0, 0), (1.0, None), (1.0, 2), (0.0, 2), (None, 2)], "cost_per_stop double, delivery_seq int")
    assert prepare.filter_paid_deliveries(seqs).count() == 2


def brute_cosine(points):
    m = np.array([p for _, p in points])
    z = (m - m.mean(0)) / np.where(m.std(0) > 0, m.std(0), 1)
    norm = np.linalg.norm(z, axis=1, keepdims=True)
    unit = np.divide(z, norm, out=np.zeros_like(z), where=norm > 0)
    return {(a, b): float(unit[i] @ unit[j]) for i, (a, _) in enumerate(points) for j, (b, _) in enumerate(points)}


@pytest.mark.parametrize("block_rows", [3, 2000])
def test_blocked_similarity_matches_brute_force(spark, block_rows):
    rng = np.random.default_rng(5)
    points = [(f"c{i:02d}", [float(v) for v in rng.normal(size=3)] + [4.0]) for i in range(20)]
    df = spark.createDataFrame([(k, *p) for k, p in points], "carrier string, a double, b double, c double, d double")
    scaled = profiles.standard_scale(df, list("abcd"))
    expected = brute_cosine(points)
    full = {(r["a"], r["b"]): r["similarity"] for r in profiles.cosine_similarity(scaled, "carrier", list("abcd"), block_rows).collect()}
    assert full.keys() == expected.keys()
    assert all(full[k] == pytest.approx(v, abs=1e-9) for k, v in expected.items())
    top = [(r["a"], r["b"]) for r in profiles.top_similar_pairs(scaled, "carrier", list("abcd"), 6, block_rows).collect()]
    best = sorted(((-round(v, 4), a, b) for (a, b), v in expected.items() if a < b))[:6]
    assert top == [(a, b) for _, a, b in best]


def test_text_stop_ids_with_one_prefix_are_split(spark):
    ids = [f"STOP-{i:05d}" for i in range(3000)]
    stops = spark.createDataFrame([("R", s, "O", "F", None, float(i), 0.0, -1.0, -1.0) for i, s in enumerate(ids)], "route_id string, stop_id string, origin string, fill_dc string, route_date date, dest_lat double, dest_lon double, origin_lat double, origin_lon double")
    got = {r["stop_id"]: r["prev_lat"] for r in geography.previous_stop(stops).collect()}
    assert got == {s: float(i - 1) for i, s in enumerate(ids)}


def test_class_narrative(spark):
    columns = "`Market Name` string, `Market / Xdock` string, `Signal / Classification` string, `CPS Gap vs Expected %` double, `Actual CPS` double, `Expected CPS` double, `Records With CPS` bigint, `Cleansheet Aggressive` double, `Gap vs Aggressive Cleansheet %` double, `Normalization Sensitivity` double"
    rows = [("Low", "L", "X", 0.1, 11.0, 10.0, 5, None, None, None), (None, "H", "X", 0.5, 1500.0, 1000.0, 1200, 900.0, 0.25, 0.41)]
    text = views.class_narrative(spark.createDataFrame(rows, columns), "X").first()[0]
    assert text.startswith("For X, the largest gap is H at +50.0% versus expected CPS. Top actual CPS is $1,500.00 versus")
    assert "records with CPS count is 1,200. Against aggressive cleansheet, the top group is +25.0% from benchmark. The top group is sensitive" in text
    assert views.class_narrative(spark.createDataFrame(rows, columns), "Y").first()[0] == "No market groups currently fall into Y."


def test_one_part_of_a_period_filters(spark):
    df = spark.createDataFrame([(2025, 1), (2026, 1), (2026, 2)], "year int, month int")
    assert prepare.filter_period_dc_type(df, year=2026).count() == 2 and prepare.filter_period_dc_type(df, month=1).count() == 2


def test_no_run_is_longer_than_asked_whatever_the_ids(spark):
    """Twenty thousand ids with one beginning and a single other one."""
    ids = [f"STOP-{i:06d}" for i in range(20_000)] + ["X1"]
    stops = spark.createDataFrame([("R", s, "O", "F", None, float(i), 0.0, -1.0, -1.0) for i, s in enumerate(ids)], "route_id string, stop_id string, origin string, fill_dc string, route_date date, dest_lat double, dest_lon double, origin_lat double, origin_lon double")
    runs = geography._sequenced(stops, 1000).groupBy(*geography.ROUTE_DAY, "__part", "__run").count()
    assert runs.agg(F.max("count")).first()[0] <= 1000 and runs.count() >= 20
    got = {r["stop_id"]: r["prev_lat"] for r in geography.previous_stop(stops).collect()}
    assert got == {s: float(i - 1) for i, s in enumerate(ids)}


def test_stops_are_spread_and_joined_to_written_tables(spark):
    """The lag runs on as many partitions as the session names, which stay apart; run starts are a written table."""
    stops = spark.createDataFrame([("R", str(i), "O", "F", None, float(i), 0.0, -1.0, -1.0) for i in range(50)], "route_id string, stop_id string, origin string, fill_dc string, route_date date, dest_lat double, dest_lon double, origin_lat double, origin_lon double")
    out = geography.previous_stop(stops, 10)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert {r["stop_id"]: r["prev_lat"] for r in out.collect()} == {str(i): float(i - 1) for i in range(50)}


def test_multipliers_are_written_before_rows_meet_them(spark):
    """Their size is known then, so the rows are not shuffled for them."""
    rows = spark.createDataFrame([("D", 2026, 5, 1.0)], "dc string, year int, month int, cost double")
    table = rows.groupBy(F.col("dc").alias("xdock"), "year", "month").agg(F.max("cost").alias("m"))
    plan = lookups.join_multiplier(rows, table, "m")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "Aggregate" not in plan


STOPS = "route_id string, stop_id string, origin string, fill_dc string, route_date date, dest_lat double, dest_lon double, origin_lat double, origin_lon double"


def test_run_starts_meet_the_rows_as_the_lag_leaves_them(spark):
    """However large the table of run starts is, rows are neither shuffled nor sorted again for it."""
    stops = spark.createDataFrame([("R", str(i), "O", None, None, float(i), None if i % 10 == 9 else 0.0, -1.0, -2.0) for i in range(50)], STOPS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = geography.previous_stop(stops, 10)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r["stop_id"]: (r["prev_lat"], r["prev_lon"]) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # one of the rows, one of the run starts
    assert plan.count("Exchange") == 2 and plan.count("Sort [") == 2 and "struct(" not in plan
    assert got == {str(i): (float(i - 1), -2.0 if i % 10 == 0 else 0.0) for i in range(50)}


def test_partitions_follow_the_rows(spark, monkeypatch):
    """More rows than the session's partitions should hold go to more of them."""
    assert partitions_of(spark, 0) == partitions_of(spark, 750_000) == 3 and partitions_of(spark, 750_001) == 4
    monkeypatch.setattr(geography, "partitions_of", lambda session, rows: partitions_of(session, rows, 10))
    stops = spark.createDataFrame([("R", f"{i:03d}", "O", "F", None, float(i), 0.0, -1.0, -1.0) for i in range(200)], STOPS)
    parts = geography._sequenced(stops, 1000).groupBy("__part").count()
    assert parts.count() > 10 and parts.agg(F.max("count")).first()[0] < 40
    assert {r["stop_id"]: r["prev_lat"] for r in geography.previous_stop(stops).collect()} == {f"{i:03d}": float(i - 1) for i in range(200)}


def test_shipments_stay_spread_when_texts_are_added(spark, tmp_path):
    """A supplier table beyond the broadcast limit is joined before the rows are spread, not after."""
    day = "TIMESTAMP '1997-03-05 00:00:00'"
    given = {
        "lineitem": f"SELECT id AS l_orderkey, id % 4 AS l_suppkey, {day} AS l_shipdate FROM range(40)",
        "orders": "SELECT id AS o_orderkey, id % 5 + 1 AS o_custkey FROM range(30)",
        "customer": "SELECT id + 1 AS c_custkey FROM range(5)",
        "supplier": "SELECT id AS s_suppkey, id AS s_nationkey FROM range(3) UNION ALL SELECT 1, 0",
        "nation": "SELECT id AS n_nationkey, 7L AS n_regionkey, concat('N', id) AS n_name FROM range(3)",
    }
    for name, text in given.items():
        spark.sql(text).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = bindings.geo_shipments(spark, str(tmp_path))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        got = rows.groupBy("route_id", "origin").count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.index("REPARTITION_BY_NUM") < plan.index("hashpartitioning(l_suppkey")
    # supplier 1 comes twice, supplier 3 is unknown
    assert {tuple(r) for r in got} == {("R0", "PLANT_N0", 16), ("R1", "XD_7_N1", 8), ("R2", "XD_7_N2", 7)}


def test_scorecard_steps_read_written_rows(spark, monkeypatch, tmp_path):
    """Counts and quantiles of market groups read rows that were written once."""
    met = []
    monkeypatch.setattr(rollups, "market_counts", lambda rows, *a, of=rollups.market_counts: (met.append(rows), of(rows, *a))[1])
    df = spark.range(40).selectExpr("concat('D', id % 2) AS xdock", "CAST(id AS DOUBLE) AS cost_per_stop")
    assert {r["records"] for r in rollups.market_groups(df, ["xdock"], []).collect()} == {20}
    assert "FileScan parquet" in met[0]._jdf.queryExecution().executedPlan().toString()
