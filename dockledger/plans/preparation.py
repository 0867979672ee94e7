"""Registered queries: sources, preparation, allocation, set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockledger.functions import columns as fx
from dockledger.operators import allocate, lookups, prepare
from dockledger.plans import bindings as b
from dockledger.plans.bindings_sql import ORD, msum, msum0, units
from dockledger.plans.registry import query
from dockledger.session import scratch_path
from dockledger.sources import readers, writers

KEYS = "l_orderkey l_linenumber l_partkey l_suppkey l_extendedprice"


def scratch(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, reachable from every executor."""
    return scratch_path(spark)


# ---- sources and sinks ------------------------------------------------------


@query("scan_table", "SELECT * FROM orders", "o_orderkey o_custkey o_orderstatus o_totalprice o_orderpriority", text="o_orderdate")
def scan_table(spark: SparkSession, sf: str) -> DataFrame:
    b.table(spark, sf, "orders").createOrReplaceTempView("dockledger_orders")
    return readers.scan_table(spark, "dockledger_orders")


@query(
    "scan_filtered",
    "SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-05-01 00:00:00'",
    KEYS,
    text="l_shipdate",
)
def scan_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return readers.scan_filtered(b.table(spark, sf, "lineitem"), "l_shipdate", "2000-05-01 00:00:00")


DISTINCT_COLS = "fill_dc_id account_id route_no stop_no customer_type customer_name"


@query("scan_distinct", "SELECT DISTINCT * FROM cust", DISTINCT_COLS)
def scan_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return readers.scan_distinct(b.customers(spark, sf), DISTINCT_COLS.split())


@query("read_parquet", "SELECT * FROM part", "p_partkey p_name p_brand p_type p_size p_retailprice")
def read_parquet(spark: SparkSession, sf: str) -> DataFrame:
    return readers.read_parquet(spark, f"{sf}/part.parquet")


@query("read_csv", "SELECT * FROM customer", "c_custkey c_name c_nationkey c_acctbal c_mktsegment")
def read_csv(spark: SparkSession, sf: str) -> DataFrame:
    customer = b.table(spark, sf, "customer")
    path = writers.write_csv(customer, scratch(spark) + ".csv.gz", compression="gzip")
    return readers.read_csv(spark, path, schema=customer.schema)


@query("resolve_source", "SELECT * FROM supplier", "s_suppkey s_name s_nationkey s_acctbal")
def resolve_source(spark: SparkSession, sf: str) -> DataFrame:
    b.table(spark, sf, "supplier").createOrReplaceTempView("dockledger_supplier")
    return readers.source(spark, table="dockledger_supplier", path=f"{sf}/nation.parquet", default=f"{sf}/region.parquet")


MONTHLY = "year month carrier_name route_id"


@query("write_parquet", "SELECT * FROM monthly", MONTHLY, "leg_total_cost routes stops totes")
def write_parquet(spark: SparkSession, sf: str) -> DataFrame:
    path = writers.write_parquet(b.monthly_summary(spark, sf), scratch(spark) + ".parquet")
    return readers.read_parquet(spark, path)


@query("write_csv", "SELECT * FROM monthly", MONTHLY, "leg_total_cost avg_cost_per_stop")
def write_csv(spark: SparkSession, sf: str) -> DataFrame:
    monthly = b.monthly_summary(spark, sf)
    return readers.read_csv(spark, writers.write_csv(monthly, scratch(spark)), schema=monthly.schema)


@query(
    "write_slim_extract",
    f"""SELECT fill_dc AS "FILL_DC_CD", xdock AS "XDOCK", year AS "YEAR", month AS "MONTH", COUNT(*) AS row_count,
    {msum0('cost_per_stop')} AS total_cost, {msum0('normalized_cost')} AS total_normalized FROM slim GROUP BY 1, 2, 3, 4""",
    "FILL_DC_CD XDOCK YEAR MONTH row_count",
    "total_cost total_normalized",
)
def write_slim_extract(spark: SparkSession, sf: str) -> DataFrame:
    slim = b.slim_extract(spark, sf)
    path = scratch(spark)
    missing = writers.write_slim_extract(slim, path)
    if missing != ["CUST_ACCT_NAM"]:
        raise ValueError(f"unexpected missing columns {missing}")
    back = readers.read_csv(spark, path, schema=writers.slim_columns(slim)[0].schema)
    return back.groupBy("FILL_DC_CD", "XDOCK", "YEAR", "MONTH").agg(
        F.count(F.lit(1)).alias("row_count"),
        fx.money_sum0(F.col("cost per stop")).alias("total_cost"),
        fx.money_sum0("normalized_cost").alias("total_normalized"),
    )


@query(
    "write_report_set",
    """SELECT 'classes' AS report, classification AS item, COUNT(*) AS amount FROM sc GROUP BY classification
    UNION ALL SELECT 'markets', xdock, COUNT(*) FROM sc GROUP BY xdock""",
    "report item amount",
)
def write_report_set(spark: SparkSession, sf: str) -> DataFrame:
    from dockledger.plans.scorecards import scored

    cards = scored(spark, sf)
    counts = {
        "classes": cards.groupBy(F.lit("classes").alias("report"), F.col("classification").alias("item")),
        "markets": cards.groupBy(F.lit("markets").alias("report"), F.col("xdock").alias("item")),
    }
    folder = scratch(spark)
    paths = writers.write_report_set({n: g.agg(F.count(F.lit(1)).alias("amount")) for n, g in counts.items()}, folder)
    return lookups.union_sources([readers.read_parquet(spark, p) for p in paths.values()])


# ---- preparation ------------------------------------------------------------


@query(
    "conform_schema",
    "SELECT dc AS xdock, year, month, fill_dc, stop_id, total_rate AS cost_per_stop, distance FROM evd",
    "xdock year month fill_dc stop_id",
    "cost_per_stop distance",
)
def conform_schema(spark: SparkSession, sf: str) -> DataFrame:
    raw = b.events_with_distance(spark, sf).select(
        F.col("dc").alias(" XDOCK_x "),
        F.col("year").alias("ROUTE_YEAR"),
        F.col("month").alias("month"),
        F.col("fill_dc").alias("FILL_DC_CD"),
        F.col("stop_id").alias("TRACKING_ID"),
        F.col("total_rate").alias("cost per stop "),
        F.col("distance").alias("DISTANCE_VAL"),
        F.lit("x").alias("unused"),
    )
    return prepare.conform_schema(raw, prepare.SCORED_INPUT_NAMES, required=["xdock", "year", "month"])


@query(
    "numeric_coerce",
    "SELECT *, CASE WHEN amount = 'nan' THEN NULL ELSE TRY_CAST(REPLACE(TRIM(amount), ',', '') AS DOUBLE) END AS number FROM messy",
    KEYS,
    "number",
)
def numeric_coerce(spark: SparkSession, sf: str) -> DataFrame:
    return b.messy_text(spark, sf).withColumn("number", fx.numeric_text("amount"))


@query("fill_unknown", "SELECT *, COALESCE(customer_type, 'Unknown') AS filled FROM slim", KEYS + " filled")
def fill_unknown(spark: SparkSession, sf: str) -> DataFrame:
    return b.slim_extract(spark, sf).withColumn("filled", fx.fill_unknown("customer_type"))


@query(
    "clean_dc_code",
    """SELECT *, TRIM(REGEXP_REPLACE(fill_dc, '\\.0$', '')) AS cleaned,
    COALESCE(NULLIF(REGEXP_EXTRACT(dc, 'XD_([0-9]+)_', 1), ''), 'Unknown') AS from_dock FROM messy""",
    KEYS + " cleaned from_dock",
)
def clean_dc_code(spark: SparkSession, sf: str) -> DataFrame:
    messy = b.messy_text(spark, sf).withColumnRenamed("dc", "xdock")
    cleaned = prepare.clean_dc_code(messy).withColumnRenamed("fill_dc", "cleaned")
    return prepare.clean_dc_code(cleaned).withColumnRenamed("fill_dc", "from_dock")


@query(
    "require_int_period",
    """SELECT *, CAST(EXTRACT(YEAR FROM d) AS INTEGER) AS year, CAST(EXTRACT(MONTH FROM d) AS INTEGER) AS month
    FROM (SELECT *, TRY_CAST(day_text AS DATE) AS d FROM messy) t WHERE d IS NOT NULL""",
    KEYS + " year month",
)
def require_int_period(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.parse_time("day_text")
    raw = b.messy_text(spark, sf).withColumns({"year": F.year(d).cast("double"), "month": F.month(d).cast("double")})
    return prepare.require_int_period(raw.withColumnRenamed("dc", "xdock"))


@query("market_name", "SELECT DISTINCT xdock, market_name FROM sc", "xdock market_name")
def market_name(spark: SparkSession, sf: str) -> DataFrame:
    return b.slim_extract(spark, sf).select("xdock").distinct().withColumn("market_name", fx.market_name("xdock"))


@query(
    "group_label",
    "SELECT DISTINCT dc || ' | ' || carrier_cd AS label, dc || ' | ' || carrier_cd || ' | M' || CAST(month AS VARCHAR) AS month_label FROM ev",
    "label month_label",
)
def group_label(spark: SparkSession, sf: str) -> DataFrame:
    events = b.delivery_events(spark, sf).select("dc", "carrier_cd", "month").distinct()
    return events.select(
        fx.group_label("dc", "carrier_cd").alias("label"), fx.group_label("dc", "carrier_cd", "month").alias("month_label")
    )


@query("normalize_key", "SELECT *, UPPER(TRIM(route_text)) AS route_norm FROM messy", KEYS + " route_norm")
def normalize_key(spark: SparkSession, sf: str) -> DataFrame:
    return b.messy_text(spark, sf).withColumn("route_norm", fx.normalize_key("route_text"))


@query("split_job_key", "SELECT * FROM job_parts", KEYS + " job_dc job_route job_stop job_customer job_date")
def split_job_key(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.split_job_key(b.job_events(spark, sf))


@query(
    "paid_flags",
    "SELECT *, NOT paid AS zero_cost, CASE WHEN paid THEN cost_per_stop END AS paid_cost FROM slim",
    KEYS + " paid zero_cost",
    "paid_cost",
)
def paid_flags(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.paid_flags(b.slim_extract(spark, sf))


@query(
    "period_columns",
    """SELECT *, CAST(EXTRACT(YEAR FROM d) AS INTEGER) AS year, CAST(EXTRACT(MONTH FROM d) AS INTEGER) AS month,
    STRFTIME(d, '%Y%m%d') AS day_key, d AS day FROM (SELECT *, TRY_CAST(day_text AS DATE) AS d FROM messy) t""",
    KEYS + " day_key",
    text="year month day",
)
def period_columns(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.period_columns(b.messy_text(spark, sf), "day_text")


@query(
    "uniform_times",
    f"""SELECT {KEYS.replace(' ', ', ')}, CASE WHEN l_orderkey % 7 <> 0 THEN STRFTIME(l_shipdate, '%Y%m%d') END AS day_first,
    CASE WHEN l_orderkey % 9 <> 0 THEN STRFTIME(l_shipdate, '%Y%m%d') END AS month_first,
    STRFTIME(l_shipdate, '%Y%m%d') AS early_days FROM lineitem WHERE EXTRACT(DAY FROM l_shipdate) <= 12 OR l_linenumber > 1""",
    KEYS + " day_first month_first early_days",
)
def uniform_times(spark: SparkSession, sf: str) -> DataFrame:
    """One column written day first, one month first, one in ISO."""
    rows = b.table(spark, sf, "lineitem").filter("day(l_shipdate) <= 12 OR l_linenumber > 1")
    written = rows.select(
        *b.ORDER_COLS,
        F.expr("IF(l_orderkey % 7 = 0, ' ', date_format(l_shipdate, 'dd/MM/yyyy HH:mm'))").alias("day_first"),
        F.expr("IF(l_orderkey % 9 = 0, NULL, date_format(l_shipdate, 'M/d/yyyy'))").alias("month_first"),
        F.expr("date_format(l_shipdate, 'yyyy-MM-dd')").alias("early_days"),
    )
    names = ["day_first", "month_first", "early_days"]
    return prepare.uniform_times(written, *names).withColumns({c: F.date_format(c, "yyyyMMdd") for c in names})


@query(
    "strip_tz_suffix",
    "SELECT *, SUBSTR(eta_text, 1, 19) AS stripped, STRFTIME(CAST(SUBSTR(eta_text, 1, 19) AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS parsed FROM messy",
    KEYS + " stripped parsed",
)
def strip_tz_suffix(spark: SparkSession, sf: str) -> DataFrame:
    out = b.messy_text(spark, sf).withColumn("stripped", fx.strip_zone("eta_text"))
    return out.withColumn("parsed", F.date_format(fx.parse_time("stripped"), "yyyy-MM-dd HH:mm:ss"))


@query("month_start", "SELECT *, MAKE_DATE(year, month, 1) AS month_start FROM monthly", MONTHLY, text="month_start")
def month_start(spark: SparkSession, sf: str) -> DataFrame:
    return b.monthly_summary(spark, sf).withColumn("month_start", fx.month_start("year", "month"))


@query("week_key", f"SELECT {ORD}, week_key FROM reg", KEYS + " week_key")
def week_key(spark: SparkSession, sf: str) -> DataFrame:
    events = prepare.filter_codes(b.delivery_events(spark, sf))
    return events.withColumn("week_key", fx.week_key("dc", "delivered_at"))


@query(
    "weekday_name",
    """SELECT DISTINCT CAST(delivered_at AS DATE) AS day, STRFTIME(delivered_at, '%A') AS weekday,
    CAST((EXTRACT(ISODOW FROM delivered_at)) - 1 AS INTEGER) AS weekday_no FROM ev""",
    "weekday weekday_no",
    text="day",
)
def weekday_name(spark: SparkSession, sf: str) -> DataFrame:
    days = b.delivery_events(spark, sf).select("delivered_at").distinct()
    return days.select(
        F.to_date("delivered_at").alias("day"),
        fx.weekday_name("delivered_at").alias("weekday"),
        fx.weekday_order("delivered_at").alias("weekday_no"),
    ).distinct()


@query(
    "zip5",
    "SELECT DISTINCT zip, REGEXP_EXTRACT(zip, '[0-9]{5}') AS zip5 FROM zships WHERE REGEXP_EXTRACT(zip, '[0-9]{5}') <> ''",
    "zip zip5",
)
def zip5(spark: SparkSession, sf: str) -> DataFrame:
    zips = b.zip_shipments(spark, sf).select("zip").distinct().withColumn("zip5", fx.zip5("zip"))
    return zips.filter(F.col("zip5").isNotNull())


@query("filter_codes", f"SELECT {ORD}, charge_type FROM reg", KEYS + " charge_type")
def filter_codes(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.filter_codes(b.delivery_events(spark, sf))


@query(
    "filter_period_dc_type",
    """SELECT * FROM slim WHERE year = 1998 AND month = 6 AND fill_dc IN ('1', '2', '4')
    AND customer_type IN ('TYPE_1', 'TYPE_5', 'TYPE_9', 'TYPE_11')""",
    KEYS + " xdock customer_type",
)
def filter_period_dc_type(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.filter_period_dc_type(
        b.slim_extract(spark, sf), 1998, 6, ["1", "2", "4"], ["TYPE_1", "TYPE_5", "TYPE_9", "TYPE_11"]
    )


@query("filter_paid_delivery_rows", "SELECT * FROM ev WHERE total_rate > 50 AND delivery_seq IS DISTINCT FROM 0", KEYS)
def filter_paid_delivery_rows(spark: SparkSession, sf: str) -> DataFrame:
    # rates here are all positive, so cost is the part above 50
    events = b.delivery_events(spark, sf).withColumn("cost_per_stop", F.col("total_rate") - 50)
    return prepare.filter_paid_deliveries(events)


@query(
    "filter_positive_pair",
    "SELECT * FROM slim WHERE cost_per_stop > 0 AND distance > 0",
    KEYS,
    "cost_per_stop distance",
)
def filter_positive_pair(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.filter_positive_pair(b.slim_extract(spark, sf), "cost_per_stop", "distance")


@query("filter_nonblank_state", "SELECT * FROM zships WHERE TRIM(state) <> ''", "state zip", "rate", "del_date")
def filter_nonblank_state(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.filter_nonblank(b.zip_shipments(spark, sf), "state")


@query("safe_div", "SELECT *, total_rate / NULLIF(route_tote_count, 0) AS ratio FROM ev", KEYS, "ratio")
def safe_div(spark: SparkSession, sf: str) -> DataFrame:
    return b.delivery_events(spark, sf).withColumn("ratio", fx.safe_div("total_rate", "route_tote_count"))


@query(
    "route_stop_keys",
    """SELECT r.l_orderkey, r.l_linenumber, r.l_partkey, r.l_suppkey, r.l_extendedprice, route_key,
    route_key || '|' || CASE WHEN COALESCE(TRY_CAST(seq_text AS DOUBLE), 0) = 0 THEN 'RETURN' ELSE seq_text END AS stop_key
    FROM reg r JOIN messy m ON r.l_orderkey = m.l_orderkey AND r.l_linenumber = m.l_linenumber AND r.l_partkey = m.l_partkey
      AND r.l_suppkey = m.l_suppkey AND r.l_extendedprice = m.l_extendedprice""",
    KEYS + " route_key stop_key",
)
def route_stop_keys(spark: SparkSession, sf: str) -> DataFrame:
    events = prepare.filter_codes(b.delivery_events(spark, sf))
    kind = F.col("l_partkey") % 7
    seq = F.when(kind == 5, "x").when(kind == 6, None).otherwise(F.col("delivery_seq").cast("string"))
    return prepare.route_stop_keys(events.withColumn("delivery_seq", seq))


@query("xdock_code", "SELECT DISTINCT x_dock, scac, xdock FROM tele2", "x_dock scac xdock")
def xdock_code(spark: SparkSession, sf: str) -> DataFrame:
    codes = lookups.carrier_codes(b.delivery_events(spark, sf))
    return lookups.add_dock_code(b.telemetry(spark, sf), codes).select("x_dock", "scac", "xdock").distinct()


# ---- allocation -------------------------------------------------------------


def reg_events(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.filter_codes(b.delivery_events(spark, sf))


@query("first_stop_flag", f"SELECT {ORD}, stop_key, first_of_stop FROM flag", KEYS + " stop_key first_of_stop")
def first_stop_flag(spark: SparkSession, sf: str) -> DataFrame:
    return allocate.flag_stops(reg_events(spark, sf), b.ORDER_COLS)


@query("route_charge_total", "SELECT DISTINCT route_key, rc_total FROM routed", "route_key", "rc_total")
def route_charge_total(spark: SparkSession, sf: str) -> DataFrame:
    return allocate.flag_stops(reg_events(spark, sf), b.ORDER_COLS).select("route_key", "rc_total").distinct()


@query("fm_stop_count", "SELECT DISTINCT route_key, fm_count FROM routed", "route_key fm_count")
def fm_stop_count(spark: SparkSession, sf: str) -> DataFrame:
    return allocate.flag_stops(reg_events(spark, sf), b.ORDER_COLS).select("route_key", "fm_count").distinct()


@query("cost_per_stop", "SELECT * FROM costed", KEYS + " charge_type", "route_cost")
def cost_per_stop(spark: SparkSession, sf: str) -> DataFrame:
    return allocate.cost_per_stop(reg_events(spark, sf), b.ORDER_COLS).withColumnRenamed("cost_per_stop", "route_cost")


@query("topside_total", "SELECT week_key, topside_total FROM weeks", "week_key", "topside_total")
def topside_total(spark: SparkSession, sf: str) -> DataFrame:
    return allocate.week_stats(allocate.with_week_key(reg_events(spark, sf)))[1]


@query("topside_stop_count", "SELECT week_key, topside_stops FROM weeks", "week_key topside_stops")
def topside_stop_count(spark: SparkSession, sf: str) -> DataFrame:
    return allocate.week_stats(allocate.with_week_key(reg_events(spark, sf)))[1]


@query("topside_share", "SELECT * FROM shared", KEYS + " first_of_week", "topside_share")
def topside_share(spark: SparkSession, sf: str) -> DataFrame:
    return allocate.topside_share(reg_events(spark, sf), b.ORDER_COLS)


@query("drop_topside_rows", "SELECT * FROM alloc", KEYS + " charge_type", "cost_per_stop")
def drop_topside_rows(spark: SparkSession, sf: str) -> DataFrame:
    return allocate.allocate_costs(reg_events(spark, sf), b.ORDER_COLS)


@query(
    "delivery_stop_counts",
    "SELECT * FROM routed WHERE charge_type <> 'TS'",
    KEYS + " delivery_stop route_stop_count fill_dc_stop_count",
)
def delivery_stop_counts(spark: SparkSession, sf: str) -> DataFrame:
    return allocate.drop_topside_rows(allocate.flag_stops(reg_events(spark, sf), b.ORDER_COLS))


@query("cost_per_stop_base_basis", "SELECT * FROM costed", KEYS + " charge_type", "base_basis_cost")
def cost_per_stop_base_basis(spark: SparkSession, sf: str) -> DataFrame:
    rows = allocate.cost_per_stop(reg_events(spark, sf), b.ORDER_COLS, basis="base")
    return rows.withColumnRenamed("cost_per_stop", "base_basis_cost")


@query(
    "allocation_audit",
    """SELECT *, charged - allocated AS lost FROM (
    SELECT 'route' AS level, route_key AS group_key, MAX(rc_total) AS charged, MAX(fm_count) AS stops,
      COALESCE(SUM(CASE WHEN rc_total > 0 AND fm_count > 0 AND charge_type = 'FM' AND first_of_stop = 1 THEN 1 ELSE 0 END)
        * MAX(rc_total / NULLIF(fm_count, 0)), 0) AS allocated FROM routed GROUP BY route_key
    UNION ALL SELECT 'week', s.week_key, MAX(topside_total), MAX(topside_stops),
      COALESCE(SUM(first_of_week) * MAX(topside_total / NULLIF(topside_stops, 0)), 0) FROM shared s GROUP BY s.week_key) t""",
    "level group_key stops",
    "charged allocated lost",
)
def allocation_audit(spark: SparkSession, sf: str) -> DataFrame:
    return allocate.allocation_audit(reg_events(spark, sf), b.ORDER_COLS)


# ---- set operations and row dedup -------------------------------------------


@query(
    "union_sources",
    "SELECT fill_dc, x_dock, courier_name, stop_id, NULL AS distance_text FROM tele WHERE fill_dc = '1' UNION ALL "
    "SELECT fill_dc, x_dock, courier_name, stop_id, distance_text FROM tele WHERE fill_dc <> '1'",
    "fill_dc x_dock courier_name stop_id distance_text",
)
def union_sources(spark: SparkSession, sf: str) -> DataFrame:
    feed = b.telemetry(spark, sf)
    one, rest = feed.filter(F.col("fill_dc") == "1").drop("distance_text"), feed.filter(F.col("fill_dc") != "1")
    return lookups.union_sources([one, rest])


@query("distinct_rows", "SELECT DISTINCT carrier_name, carrier_cd, dc FROM ev", "carrier_name carrier_cd dc")
def distinct_rows(spark: SparkSession, sf: str) -> DataFrame:
    return b.delivery_events(spark, sf).select("carrier_name", "carrier_cd", "dc").dropna().distinct()


@query(
    "first_row_dedup",
    f"SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY dc, stop_id ORDER BY {ORD}) AS rn FROM ev) t WHERE rn = 1",
    KEYS + " dc stop_id charge_type",
)
def first_row_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.first_row_dedup(b.delivery_events(spark, sf), ["dc", "stop_id"], b.ORDER_COLS, ["charge_type"])
