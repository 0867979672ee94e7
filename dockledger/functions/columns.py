"""Column expressions shared by the operators. All of them stay JVM-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Money is summed as whole 1/10000 units: integer addition does not depend on
# the order in which partitions arrive.
MONEY_UNITS = 10000.0


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def units(c: str | Column) -> Column:
    """A money amount as a whole number of 1/10000 units; NaN and infinities are null."""
    return F.floor(finite(col(c).cast("double")) * F.lit(MONEY_UNITS) + F.lit(0.5))


def money_sum(c: str | Column) -> Column:
    return F.sum(units(c)) / F.lit(MONEY_UNITS)


def money_sum0(c: str | Column) -> Column:
    """Sum that is 0 instead of null for a group without values."""
    return F.coalesce(money_sum(c), F.lit(0.0))


def money_avg(c: str | Column) -> Column:
    return F.sum(units(c)) / F.count(units(c)) / F.lit(MONEY_UNITS)


def ratio_avg(c: str | Column) -> Column:
    """Mean of quotients, which are not rounded first. Twelve decimals make the sum
    independent of the order in which partitions arrive."""
    exact = finite(col(c).cast("double")).cast("decimal(38,12)")
    return F.sum(exact).cast("double") / F.count(exact)


def safe_div(a: str | Column, b: str | Column) -> Column:
    """a / b, null when b is null or zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def ratio_gap(a: str | Column, b: str | Column) -> Column:
    """a / b - 1."""
    return safe_div(a, b) - F.lit(1.0)


def is_true(condition: Column) -> Column:
    """Comparison with null counts as false, also under negation."""
    return F.coalesce(condition, F.lit(False))


def clip(x: str | Column, low: Column, high: Column) -> Column:
    """Clip to [low, high]; a null stays null (least/greatest would skip it)."""
    return F.when(col(x).isNotNull(), F.least(F.greatest(col(x), low), high))


def finite(c: str | Column) -> Column:
    """NaN (which sorts above every number) and infinities become null."""
    c = col(c)
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def numeric_text(c: str | Column) -> Column:
    """Text to number: thousands commas dropped, anything unreadable is null."""
    text = F.trim(F.translate(col(c).cast("string"), ",", ""))
    # a Java number may carry a type suffix (``10d``); here that is not a number
    return F.when(~F.right(text, F.lit(1)).isin("d", "D", "f", "F"), finite(text.try_cast("double")))


def fill_unknown(c: str | Column) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit("Unknown"))


def clean_code(c: str | Column) -> Column:
    """A code that went through a float column: ``8170.0`` -> ``8170``."""
    return F.trim(F.regexp_replace(col(c).cast("string"), r"\.0$", ""))


def dc_from_dock(c: str | Column) -> Column:
    """The digits of ``XD_<digits>_...``; null without them."""
    return F.nullif(F.regexp_extract(col(c), r"XD_(\d+)_", 1), F.lit(""))


def market_name(c: str | Column) -> Column:
    """Readable market name: no ``XD_<n>_`` prefix, no ``.<carrier>`` suffix."""
    bare = F.regexp_replace(F.regexp_replace(col(c), r"^XD_\d+_", ""), r"\.[A-Za-z0-9]+$", "")
    return F.initcap(F.regexp_replace(bare, "_", " "))


def group_label(dock: str | Column, carrier: str | Column | None = None, month: str | Column | None = None) -> Column:
    parts = [col(dock)]
    if carrier is not None:
        parts.append(col(carrier))
    if month is not None:
        parts.append(F.concat(F.lit("M"), col(month).cast("string")))
    return F.concat_ws(" | ", *parts)


def normalize_key(c: str | Column) -> Column:
    return F.upper(F.trim(col(c).cast("string")))


def job_key_part(c: str | Column, index: int) -> Column:
    """Part of ``dc-route-stop-customer-date``; the date keeps its hyphens."""
    part = F.get(F.split(col(c), "-", 5), F.lit(index))
    return F.trim(part) if index == 4 else normalize_key(part)


# Written dates that are read besides ISO ones, month first.
TIME_FORMATS = ("M/d/yyyy h:mm:ss a", "M/d/yyyy H:mm:ss", "M/d/yyyy h:mm a", "M/d/yyyy H:mm", "M/d/yyyy")


def _written_time(text: Column, formats: Sequence[str]) -> Column:
    """Text to timestamp by the first format that reads it. Only a format whose shape the
    text has is tried: the colons, and AM or PM at the end. A try in vain costs far more
    than the test."""
    month, day = r"0*(?:[1-9]|1[0-2])/", r"0*(?:[1-9]|[12]\d|3[01])/"
    tries: dict[str, list[Column]] = {}
    for f in formats:
        start = month + day if f.startswith("M/d/") else day + month
        shape = r"[^:]*" + r":[^:]*" * f.count(":") + ("[mM]$" if f.endswith("a") else r"\d$")
        tries.setdefault(start, []).append(F.when(text.rlike(f"^{shape}"), F.try_to_timestamp(text, F.lit(f))))
    return F.coalesce(*[F.when(text.rlike(f"^{start}"), F.coalesce(*own)) for start, own in tries.items()])


def _iso_time(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), text.try_cast("timestamp"))


def parse_time(c: str | Column, formats: Sequence[str] = TIME_FORMATS) -> Column:
    """Text to timestamp, null when unreadable. A bare year is no time. ``formats`` all
    begin with ``M/d/`` or ``d/M/``."""
    text = F.trim(col(c).cast("string"))
    return F.coalesce(_iso_time(text), _written_time(text, formats))


def unread_times(c: str | Column, formats: Sequence[str] = TIME_FORMATS) -> Column:
    """Aggregate: how many values that are not blank could not be read."""
    text = F.trim(col(c).cast("string"))
    return F.count_if((text != "") & parse_time(c, formats).isNull())


# The same with the day first.
DAY_FIRST_FORMATS = tuple(f.replace("M/d/", "d/M/") for f in TIME_FORMATS)


def time_orders(c: str | Column) -> Column:
    """Aggregate: 1 if month-first (and ISO) formats read every value that is not blank,
    plus 2 if day-first ones do. A bitwise and over rows, so it combines anywhere."""
    text = F.trim(col(c).cast("string"))
    orders = (TIME_FORMATS, DAY_FIRST_FORMATS)
    reads = sum((F.when(_written_time(text, formats).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, formats in enumerate(orders)), F.lit(0))
    reads = F.when(_iso_time(text).isNotNull(), F.lit(3)).otherwise(reads)
    return F.coalesce(F.bit_and(F.when(text != "", reads)), F.lit(1))


def strip_zone(c: str | Column) -> Column:
    """Drop a trailing zone token such as `` MST``."""
    return F.regexp_replace(col(c), r"\s+[A-Z]{2,4}$", "")


def month_start(year: str | Column, month: str | Column) -> Column:
    return F.make_date(col(year), col(month), F.lit(1))


def week_start(ts: str | Column) -> Column:
    """Monday of the Monday-Sunday week."""
    return F.date_trunc("week", col(ts)).cast("date")


def week_key(dc: str | Column, ts: str | Column) -> Column:
    """``dc|week``; rows without a time share one key per dc."""
    week = F.coalesce(F.date_format(week_start(ts), "yyyy-MM-dd"), F.lit("NaT"))
    return F.concat(col(dc), F.lit("|"), week)


def weekday_name(ts: str | Column) -> Column:
    return F.date_format(col(ts), "EEEE")


def weekday_order(ts: str | Column) -> Column:
    """0 for Monday .. 6 for Sunday."""
    return F.weekday(col(ts))


def zip5(c: str | Column) -> Column:
    return F.nullif(F.regexp_extract(col(c).cast("string"), r"(\d{5})", 1), F.lit(""))


def dock_code(origin: str | Column, carrier: str | Column) -> Column:
    """``ORIGIN.CARRIER``, null when either part is."""
    return F.concat(col(origin), F.lit("."), col(carrier))


def route_key(route: str | Column, dc: str | Column, day: str | Column) -> Column:
    """``route|dc|yyyyMMdd``, null without a day. Rows without a route or dock share a
    key of their own, so that their charges are spread too."""
    known = [F.coalesce(col(c).cast("string"), F.lit("nan")) for c in (route, dc)]
    return F.concat(known[0], F.lit("|"), known[1], F.lit("|"), F.date_format(col(day), "yyyyMMdd"))


def stop_number(seq: str | Column) -> Column:
    """Whole stop number, 0 for the return leg (0, null or unreadable)."""
    return F.coalesce(numeric_text(seq).try_cast("bigint"), F.lit(0))


def stop_label(seq: str | Column) -> Column:
    raw = F.coalesce(numeric_text(seq), F.lit(0.0))
    return F.when(raw == 0, F.lit("RETURN")).otherwise(F.coalesce(raw.try_cast("bigint").cast("string"), F.lit("RETURN")))


def is_paid(cost: str | Column) -> Column:
    """A null or NaN cost is not paid."""
    return F.coalesce(finite(col(cost).cast("double")), F.lit(0.0)) > 0


def leg_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 3959.0) -> Column:
    """Great-circle miles by the spherical law of cosines."""
    cosine = F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon2) - F.radians(lon1)) + F.sin(
        F.radians(lat1)
    ) * F.sin(F.radians(lat2))
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))) * F.lit(radius)
