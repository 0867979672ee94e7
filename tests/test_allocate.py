"""Hand-made charge rows with hand-computed results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dockledger.operators import allocate

SCHEMA = (
    "n int, route_id string, dc string, fill_dc string, delivered_at timestamp, delivery_seq string, charge_type string, "
    "stop_id string, total_rate double, topside_cost double, leg_total_cost double"
)
MON, SUN, NEXT = dt.datetime(2026, 5, 4, 9), dt.datetime(2026, 5, 10, 9), dt.datetime(2026, 5, 11, 9)


def rows(spark, data):
    """(n, route, time, seq, type, stop, rate, topside) in load order."""
    full = [(n, route, "D1", "F1", t, seq, kind, stop, rate, top, 99.0) for n, route, t, seq, kind, stop, rate, top in data]
    df = spark.createDataFrame(full, SCHEMA)
    return df.withColumns({"year": F.year("delivered_at"), "month": F.month("delivered_at")})


def costs(df):
    return {r["n"]: r["cost_per_stop"] for r in df.collect()}


@pytest.fixture(scope="module")
def events(spark):
    return rows(
        spark,
        [
            (1, "A", MON, "1", "FM", "s1", 10.0, None),
            (2, "A", MON, "2", "FM", "s2", 11.0, None),
            (3, "A", MON, "3", "FM", "s3", 12.0, None),
            (4, "A", MON, "1", "FM", "s1", 10.0, None),  # the same stop again
            (5, "A", MON, "0", "RC", None, 30.0, None),
            (6, "A", MON, "4", "OV", "s4", 5.0, None),
            (7, "B", SUN, "1", "FM", "s1", 20.0, None),  # no route charge here
            (8, "B", SUN, "1", "FM", "s1", 20.0, None),
            (9, "B", SUN, "2", "OV", "s6", 7.0, None),
            (10, "A", MON, None, "TS", None, 0.0, 14.0),  # the week's surcharge
            (11, "C", NEXT, "1", "FM", "s9", 8.0, None),  # the week after: no surcharge
            (12, "D", MON, "1", "OV", "s7", 4.0, None),  # first row of the stop is OV
            (13, "D", MON, "1", "FM", "s8", 6.0, None),
            (14, "D", MON, "0", "RC", None, 9.0, None),
        ],
    )


def test_route_charge_is_spread_over_first_rows(events):
    out = costs(allocate.cost_per_stop(events, ["n"]))
    assert [out[i] for i in (1, 2, 3)] == [20.0, 21.0, 22.0]
    assert out[4] == 0.0 and out[5] == 0.0 and out[6] == 5.0
    # without a route charge: rate for FM, even when repeated, last-mile total for OV
    assert (out[7], out[8], out[9]) == (20.0, 20.0, 99.0)


def test_leading_overflow_row_hides_the_stop(events):
    all_types = costs(allocate.cost_per_stop(events, ["n"]))
    assert all_types[13] == 0.0  # the route charge of D is lost
    eligible = costs(allocate.cost_per_stop(events, ["n"], scope="eligible"))
    assert eligible[13] == 15.0
    lost = {r["group_key"]: r["lost"] for r in allocate.allocation_audit(events, ["n"]).filter("level = 'route'").collect()}
    assert lost["D|D1|20260504"] == 9.0 and lost["A|D1|20260504"] == 0.0


def test_surcharge_share(events):
    out = {r["n"]: r for r in allocate.topside_share(events, ["n"]).collect()}
    # stops s1 s2 s3 s4 s6 s7 s8 of that Monday-Sunday week
    assert out[1]["topside_stops"] == 7 and out[1]["topside_share"] == 2.0
    assert out[4]["topside_share"] == 0.0 and out[7]["topside_share"] == 0.0
    assert out[6]["topside_share"] == 2.0 and out[11]["topside_share"] == 0.0


def test_null_stop_gets_an_uncounted_share(spark):
    df = rows(spark, [(1, "A", MON, "1", "FM", None, 1.0, None), (2, "A", MON, "2", "FM", "s2", 1.0, None), (3, "A", MON, None, "TS", "t", 0.0, 6.0)])
    out = {r["n"]: r["topside_share"] for r in allocate.topside_share(df, ["n"]).collect()}
    assert out[1] == 6.0 and out[2] == 6.0


def test_whole_allocation_and_stop_counts(events):
    out = {r["n"]: r for r in allocate.allocate_costs(events, ["n"]).collect()}
    assert 10 not in out and out[5]["cost_per_stop"] == 0.0
    assert out[1]["cost_per_stop"] == 22.0
    assert out[1]["route_stop_count"] == 4 and out[7]["route_stop_count"] == 2
    assert out[1]["fill_dc_stop_count"] == 4 + 2 + 1 + 1


def test_rows_without_a_time_keep_their_rate(spark):
    df = rows(spark, [(1, "A", None, "1", "FM", "s1", 3.0, None), (2, "A", None, "1", "RC", "s1", 9.0, None)])
    out = costs(allocate.cost_per_stop(df, ["n"]))
    assert out == {1: 3.0, 2: 0.0}


def test_hot_route_and_partitioning_do_not_matter(spark):
    """One route holds most rows; the result is the same however rows lie."""
    data = [(i, "HOT" if i % 5 else "COLD", MON, str(i % 40), "RC" if i % 17 == 0 else "FM", f"s{i % 60}", i / 8.0, None) for i in range(600)]
    data.append((1000, "HOT", MON, None, "TS", None, 0.0, 77.0))
    df = rows(spark, data)
    first = costs(allocate.allocate_costs(df, ["n"]))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert costs(allocate.allocate_costs(df.repartition(5, "charge_type").orderBy(F.rand(3)), ["n"])) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    charged = sum(r[6] for r in data if r[4] == "RC" and r[1] == "HOT")
    audit = allocate.allocation_audit(df, ["n"]).filter("group_key LIKE 'HOT%'").first()
    assert audit["charged"] == pytest.approx(charged) and audit["allocated"] == pytest.approx(charged)


def test_missing_route_or_dock_still_spreads_its_charge(spark):
    data = [
        (1, None, MON, "1", "FM", "s1", 10.0, None),
        (2, None, MON, "2", "FM", "s2", 10.0, None),
        (3, None, MON, None, "RC", None, 30.0, None),
        (4, "Z", None, "1", "FM", "s3", 10.0, None),  # no day, no key: its charge is lost and the audit says so
        (5, "Z", None, "NaN", "RC", None, 12.0, None),
    ]
    df = rows(spark, data)
    out = costs(allocate.cost_per_stop(df, ["n"]))
    assert (out[1], out[2], out[3], out[4]) == (25.0, 25.0, 0.0, 10.0)
    audit = {r["group_key"]: (r["charged"], r["allocated"], r["lost"]) for r in allocate.allocation_audit(df, ["n"]).filter("level = 'route'").collect()}
    assert audit[None] == (12.0, 0.0, 12.0) and audit["nan|D1|20260504"] == (30.0, 30.0, 0.0)


def test_repeated_rows_share_the_charge_once(spark):
    """Two rows equal in every column: one of them is the first."""
    data = [(1, "A", MON, "1", "FM", "s1", 10.0, None)] * 2 + [(2, "A", MON, "0", "RC", None, 30.0, None), (3, "A", MON, None, "TS", None, 0.0, 8.0)]
    df = rows(spark, data)
    out = sorted(r["cost_per_stop"] for r in allocate.allocate_costs(df, ["n"]).filter("n = 1").collect())
    assert out == [0.0, 48.0]
    audit = {r["level"]: (r["charged"], r["allocated"]) for r in allocate.allocation_audit(df, ["n"]).filter("charged > 0").collect()}
    assert audit == {"route": (30.0, 30.0), "week": (8.0, 8.0)}


def test_charge_rows_are_hashed_not_sorted(events):
    narrow = allocate.placed(allocate.numbered(allocate.with_week_key(allocate._with_keys(events))), ["n"], allocate.ROUTE_COLUMNS + allocate.WEEK_COLUMNS)
    for stats in (allocate.sequence_stats(narrow), narrow.groupBy("week_key", "stop_id").agg(F.min("__place"), F.max(F.col("charge_type") == "FM"))):
        plan = stats._jdf.queryExecution().sparkPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_charge_rows_are_joined_once_by_their_place(events):
    """Whatever holds for a route, week or month is a small table that was written before."""
    plan = allocate.flag_all(events, ["n"])._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") <= 1 and plan.count("BroadcastHashJoin") >= 3


def test_stop_key_and_flags_of_rows_that_tie(spark):
    """Rows equal in load order: each stop, sequence and week still has one first row."""
    data = [(1, "A", MON, "1", "FM", "s1", 10.0, None)] * 3 + [(1, "A", MON, "2", "OV", "s2", 5.0, None)] * 2
    out = allocate.flag_all(rows(spark, data), ["n"]).collect()
    for flag in ("first_of_stop", "delivery_stop", "first_of_week"):
        assert sorted((r["stop_key"], r[flag]) for r in out if r[flag]) == [("A|D1|20260504|1", 1), ("A|D1|20260504|2", 1)]
    assert {r["route_stop_count"] for r in out} == {2} and {r["fill_dc_stop_count"] for r in out} == {2}


def test_inputs_are_all_the_allocation_reads(events):
    """Rows cut down to them and the order cost what whole rows cost."""
    narrow = events.select("n", *[c for c in events.columns if c in allocate.INPUTS])
    assert costs(allocate.allocate_costs(narrow, ["n"])) == costs(allocate.allocate_costs(events, ["n"]))
