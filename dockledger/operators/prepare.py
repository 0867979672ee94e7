"""Boundary steps: names, types, filters and derived keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockledger.functions import columns as fx
from dockledger.functions.stats import scalars

# Canonical name -> accepted input names, first present wins. Give
# ``conform_schema`` a mapping of your own for other headers.
SCORED_INPUT_NAMES: dict[str, list[str]] = {
    "xdock": ["XDOCK", "XDOCK_x", "XDOCK_y", "DC_CD"],
    "year": ["YEAR", "ROUTE_YEAR", "year"],
    "month": ["MONTH", "ROUTE_MONTH", "month"],
    "fill_dc": ["FILL_DC_CD"],
    "carrier_cd": ["CARRIER_SCAC_CD"],
    "charge_type": ["ASN_TYPE_CD"],
    "delivery_type": ["DELIVERY_TYPE"],
    "customer_type": ["CUST_BUS_TYP_DSCR"],
    "customer_name": ["CUST_ACCT_NAM"],
    "stop_id": ["CNSLDTN_ID", "TRACKING_ID"],
    "cost_per_stop": ["cost per stop"],
    "normalized_cost": ["normalized_cost"],
    "normalized_cost_geography": ["normalized_cost_geography"],
    "normalized_cost_shipment": ["normalized_cost_shipment"],
    "normalized_cost_density": ["normalized_cost_density"],
    "geography_multiplier": ["GEOGRAPHY_MULTIPLIER"],
    "shipment_multiplier": ["shipment_norm_multiplier_qt"],
    "density_multiplier": ["miles_per_stop_norm_multiplier_qt"],
    "geo_mean": ["geo_mean"],
    "route_stop_count": ["STOP_COUNT_VAL_ROUTE_LVL"],
    "route_tote_count": ["TOTE_COUNT_VAL_ROUTE_LVL"],
    "stop_count": ["STOP_COUNT_VAL"],
    "tote_count": ["TOTE_COUNT_VAL"],
    "route_count": ["ROUTE_COUNT_VAL"],
    "distance": ["DISTANCE_VAL"],
    "leg_total_cost": ["LEG_TOTAL_COST"],
    "leg_base_cost": ["LEG_BASE_COST"],
    "leg_fuel_cost": ["LEG_FUEL_COST"],
    "leg_misc_cost": ["LEG_MISC_COST"],
    "benchmark_conservative": ["Cleansheet Cost Per Stop Conservative"],
    "benchmark_aggressive": ["Cleansheet Cost Per Stop Aggressive"],
}
EVENT_NAMES: dict[str, list[str]] = {
    "job_id": ["JOB_ID"],
    "route_id": ["ROUTE_ID"],
    "dc": ["DC_CD"],
    "fill_dc": ["FILL_DC_CD"],
    "delivered_at": ["DLVRY_ACTL_DATETIME"],
    "delivery_seq": ["DELIVERY_SEQ"],
    "charge_type": ["ASN_TYPE_CD"],
    "delivery_type": ["DELIVERY_TYPE"],
    "stop_id": ["CNSLDTN_ID", "TRACKING_ID"],
    "carrier_cd": ["CARRIER_SCAC_CD"],
    "carrier_name": ["CARRIER_SCAC_NAME"],
    "total_rate": ["TOTAL_RATE"],
    "topside_cost": ["TOPSIDE_COST"],
    "base_cost": ["BASE_COST"],
    "leg_total_cost": ["LEG_TOTAL_COST"],
    "leg_base_cost": ["LEG_BASE_COST"],
    "leg_fuel_cost": ["LEG_FUEL_COST"],
    "leg_misc_cost": ["LEG_MISC_COST"],
    "distance": ["DISTANCE_VAL"],
    "stop_count": ["STOP_COUNT_VAL"],
    "tote_count": ["TOTE_COUNT_VAL"],
    "route_count": ["ROUTE_COUNT_VAL"],
    "route_stop_count": ["STOP_COUNT_VAL_ROUTE_LVL"],
    "route_tote_count": ["TOTE_COUNT_VAL_ROUTE_LVL"],
}
SCORED_TEXT = ["xdock", "fill_dc", "carrier_cd", "charge_type", "delivery_type", "customer_type"]
SCORED_NOT_NUMERIC = [*SCORED_TEXT, "customer_name", "stop_id"]
CHARGE_TYPES = ["FM", "RC", "OV", "TS"]
DELIVERY_TYPES = ["REG"]


def conform_schema(
    df: DataFrame,
    names: Mapping[str, Sequence[str]],
    required: Sequence[str] = (),
    keep_rest: bool = False,
) -> DataFrame:
    """Rename the first present candidate of each name, in one projection.

    Header names are trimmed. Names without a candidate are left out; a missing
    ``required`` name is an error. ``keep_rest`` keeps unlisted columns under a
    cleaned name (lower case, blanks, slashes and dashes as underscores).
    """
    headers = {c.strip(): c for c in reversed(df.columns)}
    picked = {target: next((c for c in options if c in headers), None) for target, options in names.items()}
    missing = [t for t in required if picked.get(t) is None]
    if missing:
        raise KeyError(f"required columns not found: {missing}; have {sorted(headers)}")
    selected = [F.col(f"`{headers[c]}`").alias(t) for t, c in picked.items() if c is not None]
    if keep_rest:
        used = {c for c in picked.values() if c is not None}
        selected += [F.col(f"`{raw}`").alias(clean_name(h)) for h, raw in headers.items() if h not in used]
    return df.select(*selected)


def clean_name(name: str) -> str:
    table = str.maketrans({" ": "_", "/": "_", "-": "_", "(": None, ")": None})
    return name.strip().lower().translate(table)


def coerce_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: fx.numeric_text(c) for c in columns if c in df.columns})


def fill_unknown(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: fx.fill_unknown(c) for c in columns if c in df.columns})


def clean_dc_code(df: DataFrame, default: str | None = "Unknown") -> DataFrame:
    """``fill_dc`` without a float tail, or taken from the dock when absent."""
    if "fill_dc" in df.columns:
        return df.withColumn("fill_dc", fx.clean_code("fill_dc"))
    from_dock = fx.dc_from_dock("xdock")
    return df.withColumn("fill_dc", F.coalesce(from_dock, F.lit(default)) if default else from_dock)


def require_int_period(df: DataFrame) -> DataFrame:
    """Rows with year, month and dock; year and month as int."""
    periods = [c for c in ("year", "month") if c in df.columns]
    return df.dropna(subset=[*periods, "xdock"]).withColumns({c: F.col(c).cast("int") for c in periods})


def first_row_dedup(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], columns: Sequence[str] = ()) -> DataFrame:
    """The first row of each key in the order of ``order_cols``, with ``columns``.

    A minimum over the ordering struct combines before the shuffle; a row number
    would bring all rows of a key into one task.
    """
    first = F.min(F.struct(*order_cols, *columns)).alias("__first")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col("__first")[c].alias(c) for c in (*order_cols, *columns)])


def paid_flags(df: DataFrame, cost: str = "cost_per_stop") -> DataFrame:
    paid = fx.is_paid(cost)
    return df.withColumns({"paid": paid, "zero_cost": ~paid, "paid_cost": F.when(paid, F.col(cost))})


def period_columns(df: DataFrame, ts: str = "delivered_at") -> DataFrame:
    """year, month, day and yyyyMMdd of a timestamp or text column."""
    t = fx.parse_time(ts)
    return df.withColumns(
        {"year": F.year(t), "month": F.month(t), "day": F.to_date(t), "day_key": F.date_format(t, "yyyyMMdd")}
    )


def uniform_times(df: DataFrame, *columns: str) -> DataFrame:
    """Text columns to timestamps, each in one order of day and month for all its rows:
    month first unless only day first reads every value. A column that neither reads in
    full is read month first, and what that does not read is null.

    The order is a scalar subquery over the column, known before any row is parsed."""
    orders = scalars(df, **{c: fx.time_orders(c) for c in columns})
    return df.withColumns({c: F.when(orders[c] == 2, fx.parse_time(c, fx.DAY_FIRST_FORMATS)).otherwise(fx.parse_time(c)) for c in columns})


def prepare_scored(df: DataFrame) -> DataFrame:
    """Raw slim extract -> typed table with market name and paid flags."""
    out = conform_schema(df, SCORED_INPUT_NAMES, required=["xdock", "cost_per_stop"])
    out = coerce_numbers(out, [c for c in out.columns if c not in SCORED_NOT_NUMERIC])
    # text is filled before the null filter, so a row without a dock is kept as "Unknown"
    out = require_int_period(clean_dc_code(fill_unknown(out, SCORED_TEXT)))
    return paid_flags(out.withColumn("market", fx.market_name("xdock")))


def filter_codes(
    df: DataFrame,
    charge_types: Sequence[str] = CHARGE_TYPES,
    delivery_types: Sequence[str] | None = DELIVERY_TYPES,
) -> DataFrame:
    out = df.filter(F.col("charge_type").isin(*charge_types))
    return out.filter(F.col("delivery_type").isin(*delivery_types)) if delivery_types else out


def filter_period_dc_type(
    df: DataFrame,
    year: int | None = None,
    month: int | None = None,
    fill_dcs: Sequence[str] = (),
    customer_types: Sequence[str] = (),
    carriers: Sequence[str] = (),
) -> DataFrame:
    """Optional filters; what is not given does not filter."""
    for column, value in (("year", year), ("month", month)):
        if value is not None:
            df = df.filter(F.col(column) == value)
    for column, values in (("fill_dc", fill_dcs), ("customer_type", customer_types), ("carrier_cd", carriers)):
        if values:
            df = df.filter(F.col(column).isin(*values))
    return df


def filter_paid_deliveries(df: DataFrame, cost: str = "cost_per_stop") -> DataFrame:
    """Paid rows that are not the return leg; a null sequence is kept."""
    return df.filter(fx.is_true(F.col(cost) > 0) & ~F.col("delivery_seq").eqNullSafe(0))


def filter_positive_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter((F.col(a) > 0) & (F.col(b) > 0))


def filter_nonblank(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.trim(F.col(column)) != "")


def stop_key() -> Column:
    """``route|dc|yyyyMMdd|stop``, a function of route key and sequence."""
    return F.concat(F.col("route_key"), F.lit("|"), fx.stop_label("delivery_seq"))


def route_stop_keys(df: DataFrame) -> DataFrame:
    """Route-day key and stop key of each charge row."""
    key = fx.route_key("route_id", "dc", "service_date" if "service_date" in df.columns else "delivered_at")
    return df.withColumn("route_key", key).withColumn("stop_key", stop_key())


def split_job_key(df: DataFrame) -> DataFrame:
    parts = ["job_dc", "job_route", "job_stop", "job_customer", "job_date"]
    return df.withColumns({name: fx.job_key_part("job_id", i) for i, name in enumerate(parts)})
