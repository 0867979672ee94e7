import datetime as dt

import pytest
from pyspark.sql import functions as F

from dockledger.functions import columns as fx
from dockledger.operators import prepare


def one(spark, column, **values):
    """The value of ``column`` over one row of literals."""
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    "text, number",
    [("1,234.50", 1234.5), (" 7 ", 7.0), ("nan", None), ("None", None), ("", None), ("12x", None), ("10d", None), ("-3", -3.0), ("Infinity", None)],
)
def test_numeric_text(spark, text, number):
    assert one(spark, fx.numeric_text("c"), c=text) == number


def test_codes_and_names(spark):
    assert one(spark, fx.clean_code("c"), c=" 8170.0") == "8170"
    assert one(spark, fx.dc_from_dock("c"), c="XD_8170_AZ_Yuma.AVBV") == "8170"
    assert one(spark, fx.dc_from_dock("c"), c="PLANT_1") is None
    assert one(spark, fx.market_name("c"), c="XD_8170_AZ_Yuma.AVBV") == "Az Yuma"
    assert one(spark, fx.group_label("a", "b", "m"), a="X", b="Y", m=3) == "X | Y | M3"
    assert one(spark, fx.dock_code("a", "b"), a="X", b=None) is None


def test_job_key_parts(spark):
    parts = [one(spark, fx.job_key_part("j", i), j="8170- r1 -2-c9-2026-05-04") for i in range(5)]
    assert parts == ["8170", "R1", "2", "C9", "2026-05-04"]
    assert one(spark, fx.job_key_part("j", 3), j="8170-r1") is None


def test_periods(spark):
    sunday, monday = dt.datetime(2026, 5, 3, 23), dt.datetime(2026, 5, 4, 1)
    assert one(spark, fx.week_key("d", "t"), d="X", t=sunday) == "X|2026-04-27"
    assert one(spark, fx.week_key("d", "t"), d="X", t=monday) == "X|2026-05-04"
    assert one(spark, fx.weekday_name("t"), t=monday) == "Monday"
    assert one(spark, fx.weekday_order("t"), t=monday) == 0
    assert one(spark, fx.parse_time(fx.strip_zone("t")), t="2026-05-04 08:00:00 MST") == dt.datetime(2026, 5, 4, 8)
    assert one(spark, fx.parse_time("t"), t="not a time") is None


@pytest.mark.parametrize("seq, label", [("0", "RETURN"), (None, "RETURN"), ("x", "RETURN"), ("2", "2"), ("3.0", "3")])
def test_stop_label(spark, seq, label):
    assert one(spark, fx.stop_label("s"), s=seq) == label


def test_division_and_clip(spark):
    assert one(spark, fx.safe_div("a", "b"), a=1.0, b=0.0) is None
    assert one(spark, fx.safe_div("a", "b"), a=1.0, b=None) is None
    assert one(spark, fx.clip("a", F.lit(1.0), F.lit(2.0)), a=5.0) == 2.0
    assert one(spark, fx.clip(F.lit(None).cast("double"), F.lit(1.0), F.lit(2.0))) is None
    assert one(spark, fx.is_paid(F.lit(None).cast("double"))) is False


def test_leg_miles_of_identical_points(spark):
    here = [F.lit(33.4), F.lit(-112.0)]
    assert one(spark, fx.leg_miles(*here, *here)) == pytest.approx(0.0, abs=1e-3)


def test_conform_schema_takes_first_present(spark):
    raw = spark.createDataFrame([("a", "b", 1.0)], "` XDOCK_x ` string, DC_CD string, `cost per stop` double")
    out = prepare.conform_schema(raw, prepare.SCORED_INPUT_NAMES, required=["xdock"])
    assert out.columns == ["xdock", "cost_per_stop"]
    assert out.first()["xdock"] == "a"
    with pytest.raises(KeyError):
        prepare.conform_schema(raw, prepare.SCORED_INPUT_NAMES, required=["year"])


def test_prepare_scored(spark):
    raw = spark.createDataFrame(
        [("XD_1_A_B.C", "2026.0", "5", "1,000.5", None), (None, "2026", "5", "", "T"), ("XD_2_Q.C", None, "5", "3", "T")],
        "XDOCK string, YEAR string, MONTH string, `cost per stop` string, CUST_BUS_TYP_DSCR string",
    )
    rows = {r["xdock"]: r for r in prepare.prepare_scored(raw).collect()}
    assert set(rows) == {"XD_1_A_B.C", "Unknown"}
    known = rows["XD_1_A_B.C"]
    assert (known["year"], known["fill_dc"], known["cost_per_stop"], known["customer_type"]) == (2026, "1", 1000.5, "Unknown")
    assert known["paid"] and rows["Unknown"]["zero_cost"] and rows["Unknown"]["paid_cost"] is None


def test_text_numbers_and_missing_values(spark):
    rows = [("NaN", float("nan")), ("2d", 2.0), ("3", None), (None, 4.0), ("1,200", float("inf")), ("x", -1.0)]
    df = spark.createDataFrame(rows, "seq string, cost double")
    got = df.select(fx.stop_number("seq").alias("n"), fx.stop_label("seq").alias("label"), fx.is_paid("cost").alias("paid")).collect()
    assert [r["n"] for r in got] == [0, 0, 3, 0, 1200, 0]
    assert [r["label"] for r in got] == ["RETURN", "RETURN", "3", "RETURN", "1200", "RETURN"]
    assert [r["paid"] for r in got] == [False, True, False, True, False, False]
    assert df.limit(2).agg(fx.money_avg("cost")).first()[0] == 2.0 and df.limit(2).agg(fx.ratio_avg("cost")).first()[0] == 2.0


def test_written_times(spark):
    texts = ["05/14/2026 08:30:00 AM", "5/1/2026", "5/1/2026 14:05", "2026-05-14 08:30:00", "2026", "31/12/1999", "", None, "soon"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] and r[0].strftime("%Y-%m-%d %H:%M") for r in df.select(fx.parse_time("t")).collect()]
    assert got == ["2026-05-14 08:30", "2026-05-01 00:00", "2026-05-01 14:05", "2026-05-14 08:30", None, None, None, None, None]
    assert df.agg(fx.unread_times("t")).first()[0] == 3


def test_one_order_of_day_and_month_for_a_column(spark):
    rows = [("05/04/2026", "05/04/2026", "05/04/2026", None), ("31/12/2026 07:30", "12/31/2026", "06/04/2026", " "), (" ", None, "13/13/2026", ""), (None, "2026-05-06", "x", None)]
    df = spark.createDataFrame(rows, "day_first string, month_first string, neither string, blank string")
    out = prepare.uniform_times(df, *df.columns).collect()
    days = [[None if v is None else v.strftime("%m-%d") for v in r] for r in out]
    assert [d[0] for d in days] == ["04-05", "12-31", None, None]
    assert [d[1] for d in days] == ["05-04", "12-31", None, "05-06"]
    assert [d[2] for d in days] == ["05-04", "06-04", None, None] and all(d[3] is None for d in days)


def test_only_formats_of_the_text_s_shape_are_tried(spark):
    """Each format keeps reading what it read; others are not tried in vain."""
    read = {"5/4/2026 1:02:03 PM": "13:02:03", "5/4/2026 13:02:03": "13:02:03", "05/04/2026 1:02 am": "01:02:00", "5/4/2026 13:02": "13:02:00", " 5/4/2026 ": "00:00:00"}
    df = spark.createDataFrame([(t,) for t in (*read, "13/4/2026", "5/32/2026", "5/4/2026 25:00", "5/4", "0/4/2026")], "t string")
    got = {r["t"]: r["p"] and r["p"].strftime("%m-%d %H:%M:%S") for r in df.select("t", fx.parse_time("t").alias("p")).collect()}
    assert got == {t: f"05-04 {read[t]}" if t in read else None for t in got}
    plan = df.select(fx.parse_time("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") + plan.count("rlike") >= 6
