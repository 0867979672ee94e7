"""The star-schema test tables read as delivery entities.

Each function gives one entity of the domain, derived from the given tables row
by row, so that work grows with them. ``bindings_sql`` holds the same mappings
as SQL for the cross-check.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dockledger.session import cut_lineage, spread

ORDER_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
# Columns of charge rows that neither the allocation nor the cost rollups read.
BESIDE_COST = [
    "carrier_cd", "carrier_name", "base_cost", "leg_base_cost", "leg_fuel_cost", "leg_misc_cost",
    "tote_count", "route_count", "stop_count", "route_tote_count",
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _supplied(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return rows.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))


def lines(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """Order lines (or ``rows`` made of them) with route, fill DC, dock and dock carrier of
    their supplier. Two joins with plain tables, whose size Spark knows beforehand; texts
    are formed after all joins."""
    found = table(spark, sf, "lineitem") if rows is None else rows
    found = found if "s_nationkey" in found.columns else _supplied(spark, sf, found)
    joined = found.join(table(spark, sf, "nation").select("n_nationkey", "n_regionkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    carrier = F.concat(F.lit("C"), (F.col("s_nationkey") % 6).cast("string"))
    place = F.concat(F.lit("XD_"), F.col("n_regionkey").cast("string"), F.lit("_"), F.col("n_name"))
    return joined.select(
        *[c for c in found.columns if c != "s_nationkey"],
        F.col("s_nationkey").alias("nation"),
        F.concat(F.lit("R"), F.col("s_nationkey").cast("string")).alias("route_id"),
        F.col("n_regionkey").cast("string").alias("fill_dc"),
        place.alias("place"),
        "n_name",
        carrier.alias("dock_carrier"),
        F.concat(place, F.lit("."), carrier).alias("dc"),
    )


def delivery_events(spark: SparkSession, sf: str, rows: DataFrame | None = None, more: Sequence[str] = ()) -> DataFrame:
    """Charge rows. Service day is the month's first, so that routes have many stops.
    ``rows`` are order lines joined with something, of which ``more`` stays."""
    flag = F.concat("l_returnflag", "l_linestatus")
    total = F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1000
    carrier_no = (F.col("l_suppkey") % 6).cast("string")
    return lines(spark, sf, rows).select(
        *ORDER_COLS,
        *more,
        F.when(flag == "RF", "RC").when(flag == "RO", "TS").when(flag == "NO", "OV").otherwise("FM").alias("charge_type"),
        F.when(F.col("l_tax") < 0.07, "REG").otherwise("STAT").alias("delivery_type"),
        "route_id",
        "dc",
        F.col("dc").alias("xdock"),
        "fill_dc",
        F.col("l_shipdate").alias("delivered_at"),
        F.date_trunc("month", "l_shipdate").cast("date").alias("service_date"),
        F.year("l_shipdate").alias("year"),
        F.month("l_shipdate").alias("month"),
        (F.col("l_linenumber") - 1).alias("delivery_seq"),
        F.col("l_partkey").alias("stop_id"),
        F.concat(F.lit("C"), carrier_no).alias("carrier_cd"),
        F.concat(F.lit("Carrier "), carrier_no).alias("carrier_name"),
        (F.col("l_extendedprice") / 1000).alias("total_rate"),
        F.col("l_quantity").alias("topside_cost"),
        (F.col("l_extendedprice") / 2000).alias("base_cost"),
        total.alias("leg_total_cost"),
        (total * 0.8).alias("leg_base_cost"),
        (total * 0.15).alias("leg_fuel_cost"),
        (total * 0.05).alias("leg_misc_cost"),
        F.col("l_quantity").alias("tote_count"),
        F.col("l_linenumber").cast("double").alias("route_count"),
        (F.col("l_partkey") % 40).cast("double").alias("stop_count"),
        (F.col("l_orderkey") % 90).cast("double").alias("route_tote_count"),
    )


def _lines_with_size(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_size")
    return table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"), "left").drop("p_partkey")


def _distance(events: DataFrame) -> DataFrame:
    return events.withColumn("distance", F.col("tote_count") * (1 + F.col("p_size"))).drop("p_size")


def events_with_distance(spark: SparkSession, sf: str) -> DataFrame:
    return _distance(delivery_events(spark, sf, _lines_with_size(spark, sf), ["p_size"]))


def _lines_of_customers(spark: SparkSession, sf: str, columns: Sequence[str], of_customer: Sequence[str] = ()) -> DataFrame:
    """Order lines with their supplier and the customer of their order, joined while rows
    are narrow and spread, as texts are added to them: that is the last shuffle, since a
    supplier table beyond the broadcast limit would have them merged again."""
    given = table(spark, sf, "lineitem")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    known = table(spark, sf, "customer").select("c_custkey", *of_customer)
    of_order = orders.join(known, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey")
    rows = _supplied(spark, sf, given.select("l_orderkey", *columns))
    return spread(rows, "l_orderkey", rows=given.count()).join(of_order, F.col("l_orderkey") == F.col("o_orderkey"))


def dirty_events(spark: SparkSession, sf: str) -> DataFrame:
    """Charge rows as feeds deliver them: rows without route, dock, day, stop or sequence,
    rates that are no number, and rows that come twice."""
    key = F.col("l_orderkey")

    def lost(every: int, *columns: str) -> dict[str, Column]:
        return {c: F.when(key % every != 0, F.col(c)) for c in columns}

    rows = delivery_events(spark, sf).withColumns(
        {
            **lost(71, "route_id"),
            **lost(73, "dc", "xdock"),
            **lost(79, "service_date", "delivered_at", "year", "month"),
            **lost(67, "delivery_seq"),
            **lost(61, "stop_id"),
            "total_rate": F.when(key % 83 == 0, float("nan")).when(key % 89 == 0, None).otherwise(F.col("total_rate")),
        }
    )
    return rows.unionByName(rows.filter(key % 5 == 0))


def job_events(spark: SparkSession, sf: str, distance: bool = False) -> DataFrame:
    """Charge rows with the compound job key instead of customer columns."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    rows = _lines_with_size(spark, sf) if distance else table(spark, sf, "lineitem")
    rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    # two joins of all order lines: written, so that their shuffles do not last through what follows
    rows = cut_lineage(rows) if distance else rows
    joined = delivery_events(spark, sf, rows, ["o_custkey", *(["p_size"] if distance else [])])
    joined = _distance(joined) if distance else joined
    job = F.concat_ws(
        "-", "fill_dc", F.concat(F.lower("route_id"), F.lit(" ")), F.col("delivery_seq").cast("string"),
        F.col("o_custkey").cast("string"), F.date_format("delivered_at", "yyyy-MM-dd"),
    )
    # every 101st order came without a job key, every 97th with a short one
    short = F.concat_ws("-", "fill_dc", "route_id")
    key = F.when(F.col("l_orderkey") % 101 == 0, None).when(F.col("l_orderkey") % 97 == 0, short).otherwise(job)
    return joined.withColumn("job_id", key).drop("o_custkey")


def customers(spark: SparkSession, sf: str) -> DataFrame:
    """Account, route and stop per customer; some accounts are missing, some twice."""
    rows = _lines_of_customers(spark, sf, ["l_suppkey", "l_linenumber"], ["c_mktsegment", "c_name"])
    joined = lines(spark, sf, rows)
    found = joined.filter(F.col("c_custkey") % 10 != 3).select(
        F.col("fill_dc").alias("fill_dc_id"),
        F.concat(F.lit(" "), F.col("c_custkey").cast("string")).alias("account_id"),
        F.col("route_id").alias("route_no"),
        (F.col("l_linenumber") - 1).cast("string").alias("stop_no"),
        F.col("c_mktsegment").alias("customer_type"),
        F.col("c_name").alias("customer_name"),
    ).distinct()
    twice = found.filter(F.trim("account_id").cast("bigint") % 17 == 0)
    return found.unionByName(twice.withColumn("customer_name", F.concat("customer_name", F.lit(" ALT"))))


def geo_shipments(spark: SparkSession, sf: str) -> DataFrame:
    """Stops with coordinates; every fifth nation ships from a plant, no crossdock."""
    joined = lines(spark, sf, _lines_of_customers(spark, sf, ["l_suppkey", "l_shipdate"]))
    stop = F.col("c_custkey").cast("string")
    return joined.select(
        "route_id",
        F.when(F.col("c_custkey") % 211 == 0, None)
        .when(F.col("c_custkey") % 50 == 0, F.concat(F.lit("S"), stop))
        .otherwise(stop)
        .alias("stop_id"),
        F.when(F.col("nation") % 5 == 0, F.concat(F.lit("PLANT_"), F.col("n_name"))).otherwise(F.col("place")).alias("origin"),
        F.col("dock_carrier").alias("carrier_cd"),
        "fill_dc",
        F.date_trunc("month", "l_shipdate").alias("contract_time"),
        (25 + (F.col("c_custkey") % 2400) / 100.0).alias("dest_lat"),
        (-120 + (F.col("c_custkey") * 7 % 5000) / 100.0).alias("dest_lon"),
        # route 3 has no origin coordinates
        F.when(F.col("nation") != 3, 30.0 + F.col("nation")).alias("origin_lat"),
        (-100.0 + F.col("nation") / 2.0).alias("origin_lon"),
    )


def dock_shipments(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select(
        F.col("dc").alias("xdock"), F.col("l_shipdate").alias("shipped_at"), F.col("l_orderkey").alias("record_key")
    )


def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    """Courier feed as text: zone suffixes, unreadable and far distances, unknown
    couriers and missing docks."""
    miles = F.col("l_quantity").cast("bigint") * (1 + F.col("l_suppkey") % 10)
    miles = F.when(F.col("l_orderkey") % 97 == 0, miles * 50).otherwise(miles)
    carrier = F.concat(F.lit("Carrier "), (F.col("nation") % 6).cast("string"))
    return lines(spark, sf).select(
        "fill_dc",
        F.when(F.col("l_orderkey") % 101 != 0, F.col("place")).alias("x_dock"),
        F.when(F.col("l_partkey") % 53 == 0, "Carrier 9").otherwise(carrier).alias("courier_name"),
        "route_id",
        F.col("l_partkey").cast("string").alias("stop_id"),
        F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit(" 08:00:00 MST")).alias("eta_start"),
        F.when(F.col("l_partkey") % 89 == 0, "n/a").otherwise(miles.cast("string")).alias("distance_text"),
    )


def benchmarks(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark costs per DC and month; some docks and some measures are missing."""
    units = F.floor(F.col("l_extendedprice") * 10 + 0.5)
    mean = F.sum(units) / F.count("l_extendedprice") / 10000.0
    grouped = lines(spark, sf).groupBy(
        F.col("dc").alias("distribution_center"), "nation", F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")
    ).agg(mean.alias("mean_rate"))
    return grouped.filter(F.col("nation") % 7 != 3).select(
        "distribution_center",
        "year",
        "month",
        (F.col("mean_rate") * 1.05).alias("benchmark_conservative"),
        F.when(F.col("month") != 2, F.col("mean_rate") * 0.9).alias("benchmark_aggressive"),
    )


def monthly_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Costs and volumes per carrier, route and month."""
    from dockledger.functions import columns as fx

    parts = ["leg_base_cost", "leg_fuel_cost", "leg_misc_cost", "leg_total_cost"]
    grouped = delivery_events(spark, sf).groupBy("year", "month", "carrier_name", "route_id").agg(
        *[fx.money_sum(c).alias(c) for c in parts],
        fx.money_sum("route_count").alias("routes"),
        F.count(F.lit(1)).cast("double").alias("stops"),
        fx.money_sum("tote_count").alias("totes"),
    )
    return grouped.withColumns(
        {f"avg_cost_per_{n}": fx.safe_div("leg_total_cost", f"{n}s") for n in ("route", "stop", "tote")}
    )


def zip_shipments(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as shipments with messy zip text and blank states."""
    key = F.col("c_custkey")
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    joined = orders.join(table(spark, sf, "customer"), F.col("o_custkey") == key).join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    code = F.lpad((key * 37 % 100000).cast("string"), 5, "0")
    return joined.select(
        F.when(key % 41 == 0, "  ").when(key % 43 == 0, None).otherwise(F.concat(F.lit("S"), (F.col("n_nationkey")).cast("string"))).alias("state"),
        F.when(key % 29 == 0, "ON K1A").when(key % 3 == 0, F.concat(code, F.lit("-1234"))).otherwise(code).alias("zip"),
        F.col("o_orderdate").cast("date").alias("del_date"),
        (F.col("o_totalprice") / 100).alias("rate"),
    )


def zip_reference(spark: SparkSession, sf: str) -> DataFrame:
    """One row per known zip; every ninth customer's zip is unknown."""
    key = F.col("c_custkey")
    code = F.lpad((key * 37 % 100000).cast("string"), 5, "0")
    return (
        table(spark, sf, "customer").filter(key % 9 != 0).groupBy(code.alias("postal_code"))
        .agg(F.min(key).alias("k"))
        .select("postal_code", (25 + (F.col("k") % 2400) / 100.0).alias("latitude"), (-120 + (F.col("k") * 7 % 5000) / 100.0).alias("longitude"))
    )


def messy_text(spark: SparkSession, sf: str) -> DataFrame:
    """Text as it comes out of spreadsheets, built from the order lines."""
    q = F.col("l_quantity").cast("bigint")
    dollars = F.concat((q % 9 + 1).cast("string"), F.lit(","), F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0"), F.lit(".50"))
    kind = F.col("l_partkey") % 7
    return lines(spark, sf).select(
        *ORDER_COLS,
        F.when(kind == 0, dollars).when(kind == 1, "nan").when(kind == 2, "").when(kind == 3, "12x")
        .when(kind == 4, None).when(kind == 5, F.concat(F.lit(" "), q.cast("string"), F.lit(" "))).otherwise(q.cast("string")).alias("amount"),
        F.when(kind == 0, None).when(kind == 1, F.concat(F.lit(" "), F.col("fill_dc"), F.lit(".0"))).otherwise(F.col("fill_dc")).alias("fill_dc"),
        "dc",
        F.when(kind == 2, "31/12/1999").when(kind == 3, None).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("day_text"),
        F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit(" 08:30:00"), F.when(kind < 3, " MST").otherwise("")).alias("eta_text"),
        F.when(kind == 4, None).otherwise(F.concat(F.lit(" "), F.lower("route_id"), F.lit(" "))).alias("route_text"),
        F.when(kind == 5, "x").when(kind == 6, None).otherwise((F.col("l_linenumber") - 1).cast("string")).alias("seq_text"),
    )


def slim_extract(spark: SparkSession, sf: str) -> DataFrame:
    """The scored input of the scorecard: one row per delivery with its cost,
    multipliers and benchmark. Markets and carriers differ in level."""
    nation, month = F.col("nation"), F.month("l_shipdate")
    flag = F.concat("l_returnflag", "l_linestatus")
    level = (0.6 + (nation % 9) * 0.1) * (0.9 + (F.col("l_suppkey") % 6) * 0.05)
    cost = F.when(flag.isin("RF"), 0.0).when((flag == "NF") & (F.col("l_linenumber") == 7), None).otherwise(
        F.col("l_extendedprice") / 1000 * level
    )
    kind = F.col("l_orderkey") % 13
    low = 40.0 + (nation % 7) * 4.0
    out = lines(spark, sf).filter(F.col("l_tax") < 0.07).select(
        *ORDER_COLS,
        F.col("dc").alias("xdock"),
        "dc",
        "fill_dc",
        F.year("l_shipdate").alias("year"),
        month.alias("month"),
        F.concat(F.lit("C"), (F.col("l_suppkey") % 6).cast("string")).alias("carrier_cd"),
        F.when(kind < 12, F.concat(F.lit("TYPE_"), kind.cast("string"))).alias("customer_type"),
        cost.alias("cost_per_stop"),
        (1.0 + (nation % 5) / 20.0).alias("geography_multiplier"),
        (0.8 + month / 20.0).alias("shipment_multiplier"),
        (0.7 + ((nation * 7 + month) % 10) / 12.0).alias("density_multiplier"),
        F.when(nation % 11 != 6, low).alias("benchmark_conservative"),
        F.when(nation % 8 != 5, low * 0.9).alias("benchmark_aggressive"),
        (F.col("l_quantity") * 3).alias("distance"),
        ((F.col("l_orderkey") % 30) + 5).cast("double").alias("route_stop_count"),
        ((F.col("l_orderkey") % 90) + 10).cast("double").alias("route_tote_count"),
    )
    from dockledger.operators import multipliers

    return multipliers.normalized_costs(multipliers.geo_mean(out))
