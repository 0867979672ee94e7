"""Joins (J1-J12). All are equi joins; Spark picks broadcast or shuffle by size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockledger.functions import columns as fx
from dockledger.functions.stats import join_back
from dockledger.operators.prepare import split_job_key
from dockledger.session import cut_lineage

CUSTOMER_KEYS = {"job_dc": "fill_dc_id", "job_customer": "account_id", "job_route": "route_no", "job_stop": "stop_no"}


def equi_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", null_safe: bool = False
) -> DataFrame:
    """Join on equally named keys. ``null_safe`` lets null keys meet each other."""
    return join_back(left, right, keys, how, null_safe)


def join_customers(events: DataFrame, customers: DataFrame, null_safe: bool = False) -> DataFrame:
    """Customer type and name by the four parts of the job key; a key that
    several customers share multiplies the row."""
    right = customers.select(
        *[fx.normalize_key(c).alias(k) for k, c in CUSTOMER_KEYS.items()], "customer_type", "customer_name"
    )
    left = events if "job_dc" in events.columns else split_job_key(events)
    return equi_join(left.drop("customer_type", "customer_name"), right, list(CUSTOMER_KEYS), "left", null_safe)


def join_audit(events: DataFrame, customers: DataFrame) -> DataFrame:
    """Rows after the join, customer keys held more than once, match rate."""
    duplicates = (
        customers.groupBy(*[fx.normalize_key(c).alias(k) for k, c in CUSTOMER_KEYS.items()])
        .count()
        .agg(F.count_if(F.col("count") > 1).alias("n"))
        .scalar()
    )
    return join_customers(events, customers).agg(
        F.count(F.lit(1)).alias("rows"),
        duplicates.alias("duplicate_key_groups"),
        F.avg(F.col("customer_name").isNotNull().cast("int")).alias("match_rate"),
    )


def join_multiplier(
    rows: DataFrame, multipliers: DataFrame, value: str, dock: str = "xdock", null_safe: bool = False
) -> DataFrame:
    """Inner join of a dock-month multiplier; rows of docks without one
    vanish (``dropped_markets`` reports them). The multipliers are written first, so that
    Spark knows their size before it decides whether the rows have to be shuffled."""
    right = cut_lineage(multipliers.select(fx.normalize_key(dock).alias("__dock"), "year", "month", value))
    left = rows.withColumn("__dock", fx.normalize_key("dc"))
    return equi_join(left, right, ["__dock", "year", "month"], "inner", null_safe).drop("__dock")


def dropped_markets(rows: DataFrame, multipliers: DataFrame, dock: str = "xdock") -> DataFrame:
    """Dock-months, with their rows, that ``join_multiplier`` would lose."""
    right = multipliers.select(fx.normalize_key(dock).alias("dock_key"), "year", "month")
    left = rows.groupBy(fx.normalize_key("dc").alias("dock_key"), "year", "month").agg(F.count(F.lit(1)).alias("rows"))
    return left.join(right, ["dock_key", "year", "month"], "left_anti")


def join_benchmark(rows: DataFrame, benchmarks: DataFrame, null_safe: bool = False) -> DataFrame:
    """Benchmark costs of the DC-month, null where there are none. They are written
    first, as the multipliers are."""
    right = cut_lineage(benchmarks.withColumnRenamed("distribution_center", "dc"))
    return equi_join(rows, right, ["dc", "year", "month"], "left", null_safe)


def carrier_codes(events: DataFrame) -> DataFrame:
    """One code per carrier name (the largest, if a name has several)."""
    return (
        events.select("carrier_name", "carrier_cd").dropna().groupBy("carrier_name").agg(F.max("carrier_cd").alias("carrier_cd"))
    )


def add_dock_code(telemetry: DataFrame, codes: DataFrame) -> DataFrame:
    """Telemetry rows with carrier code and dock code, null if either is unknown."""
    named = cut_lineage(codes.select(F.col("carrier_name").alias("courier_name"), F.col("carrier_cd").alias("scac")))
    joined = equi_join(telemetry, named, ["courier_name"])
    return joined.withColumn("xdock", fx.dock_code("x_dock", "scac"))


def zip_geocode(zip_rates: DataFrame, zip_reference: DataFrame) -> DataFrame:
    """Coordinates by zip; unmatched zips and zero rates are dropped."""
    places = zip_reference.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    return (
        zip_rates.join(places.withColumnRenamed("postal_code", "zip5"), "zip5", "inner")
        .filter(F.col("avg_daily_rate") > 0)
    )


def keep_top_groups(df: DataFrame, key: str, weight: Column, n: int = 8) -> DataFrame:
    """Rows whose key is among the ``n`` with the largest total weight."""
    top = (
        df.groupBy(F.col(key).alias("__key")).agg(F.sum(weight).alias("__w"))
        .orderBy(F.desc("__w"), F.asc("__key")).limit(n)
    )
    return df.join(top, df[key].eqNullSafe(top["__key"]), "left_semi")


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack extracts of the same kind; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
