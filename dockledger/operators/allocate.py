"""Spreading route charges and weekly surcharges over stops.

"First row" means first in load order over all charge types. Spark has no row order, so
``order_cols`` names columns that order the rows. The charge rows are range-partitioned
by them, numbered and written once, so that the place of a row in load order is one whole
number, unique even among rows that are equal in every column. "First row of a stop" is
then the least number of the stop; with the kind of the charge in its lowest bits it also
says what the first row charges. Such minima and sums are hash aggregates that combine
before the shuffle: a route or week that holds a large part of all rows is one row per
task. A row is the first of something if its place is one of these minima, so the charge
rows are joined once, by their unique place, to the places that are; what holds for a
whole route, week or month is a small table beside it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockledger.functions import columns as fx
from dockledger.functions.stats import join_back
from dockledger.operators.prepare import route_stop_keys, stop_key
from dockledger.session import cut_lineage

DELIVERY_CHARGES = ("FM", "OV")


def _charge(*types: str) -> Column:
    return F.col("charge_type").isin(*types)


def _with_keys(events: DataFrame) -> DataFrame:
    return events if "stop_key" in events.columns else route_stop_keys(events)


def _with_route_key(events: DataFrame) -> DataFrame:
    return events if "stop_key" in events.columns else route_stop_keys(events).drop("stop_key")


def with_week_key(events: DataFrame) -> DataFrame:
    return events.withColumn("week_key", fx.week_key("dc", "delivered_at"))


def _in_scope(scope: str, types: Sequence[str]) -> Column:
    """Rows that compete for "first": all of them, or only the eligible charges."""
    if scope not in ("all", "eligible"):
        raise ValueError(f"scope must be 'all' or 'eligible', not {scope!r}")
    return F.lit(True) if scope == "all" else _charge(*types)


# What the lowest three bits of a place say about the row's charge.
KINDS = {"FM": 1, "OV": 2}


def _is_kind(place: str, *types: str) -> Column:
    return fx.is_true(F.pmod(F.col(place), F.lit(8)).isin(*[KINDS[t] for t in types]))


def numbered(events: DataFrame) -> DataFrame:
    """Charge rows with ``__row``, which orders rows that are equal in load order."""
    return events.withColumn("__row", F.monotonically_increasing_id())


def placed(
    rows: DataFrame, order_cols: Sequence[str], columns: Sequence[str] | None = None, derive: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Numbered rows, of them ``columns``, with ``__place``, ascending in load order;
    written once so that the places stay. What ``derive`` adds is not shuffled."""
    kept = [c for c in rows.columns if c != "__row"] if columns is None else list(dict.fromkeys(["charge_type", *columns]))
    needed = rows.select("__row", *dict.fromkeys([*order_cols, *kept]))
    ordered = needed.repartitionByRange(*order_cols, "__row").sortWithinPartitions(*order_cols, "__row")
    kind = F.coalesce(*[F.when(_charge(t), F.lit(k)) for t, k in KINDS.items()], F.lit(0))
    place = F.monotonically_increasing_id() * 8 + kind
    chosen = ordered.withColumn("__place", place).select(*kept, "__place")
    return cut_lineage(derive(chosen) if derive else chosen)


ROUTE_COLUMNS = ["route_key", "delivery_seq", "fill_dc", "year", "month", "total_rate"]
WEEK_COLUMNS = ["week_key", "stop_id", "topside_cost"]
MONTH = ["fill_dc", "year", "month"]
# The columns of charge rows that the allocation reads.
INPUTS = [
    "charge_type", "route_id", "dc", "service_date", "delivered_at", "delivery_seq", "stop_id", *MONTH,
    "total_rate", "topside_cost", "leg_total_cost",
]


def sequence_stats(narrow: DataFrame, scope: str = "all") -> DataFrame:
    """One row per (route, raw sequence) with everything C1-C4 and C9 need.

    The stop key is a function of these two, so the stop and route levels are built from
    this reduced table.
    """
    place = F.col("__place")
    stats = narrow.groupBy("route_key", "delivery_seq").agg(
        F.min(F.when(_in_scope(scope, ("FM",)), place)).alias("head"),
        F.min(F.when(~_charge("TS") & _in_scope(scope, DELIVERY_CHARGES), place)).alias("delivery_head"),
        F.sum(F.when(_charge("RC"), fx.units("total_rate"))).alias("rc_units"),
    )
    delivers = fx.is_true(_is_kind("delivery_head", *DELIVERY_CHARGES) & (fx.numeric_text("delivery_seq") > 0))
    return stats.withColumns({"stop_key": stop_key(), "delivery_head": F.when(delivers, F.col("delivery_head"))})


# What a marked place is the first of.
MARKS = {"first_of_stop": 1, "delivery_stop": 2, "first_of_week": 4}


def _marked(places: DataFrame, column: str, name: str) -> DataFrame:
    found = places.filter(F.col(column).isNotNull())
    return found.select(F.col(column).alias("__place"), F.lit(MARKS[name]).alias("mark"))


def _flagged(rows: DataFrame, marks: Sequence[DataFrame], names: Sequence[str]) -> DataFrame:
    """``rows`` with 0/1 columns ``names``, by one join on the place."""
    one = reduce(DataFrame.unionByName, marks).groupBy("__place").agg(F.bit_or("mark").alias("__marks"))
    bits = F.coalesce("__marks", F.lit(0))
    joined = join_back(rows, one, ["__place"], null_safe=False)
    return joined.withColumns({n: (bits.bitwiseAND(F.lit(MARKS[n])) > 0).cast("int") for n in names}).drop("__marks")


def route_marks(rows: DataFrame, scope: str = "all") -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """C1-C3 and the stop counts of C9: marked places, routes, months."""
    sequences = cut_lineage(sequence_stats(rows, scope))
    # rows without a service day share the null route; their stop is still ordered
    stops = cut_lineage(sequences.groupBy("route_key", "stop_key").agg(
        F.min("head").alias("head"), F.sum("rc_units").alias("rc_units"), F.count("delivery_head").alias("deliveries")
    ))
    routes = (
        stops.filter(F.col("route_key").isNotNull())
        .groupBy("route_key")
        .agg(
            (F.coalesce(F.sum("rc_units"), F.lit(0)) / F.lit(fx.MONEY_UNITS)).alias("rc_total"),
            F.count_if(_is_kind("head", "FM")).alias("fm_count"),
            F.sum("deliveries").alias("route_stop_count"),
        )
    )
    heads = sequences.select(F.col("delivery_head").alias("__place"))
    delivered = rows.select("__place", *MONTH).join(heads, "__place", "left_semi").dropna(subset=MONTH)
    months = delivered.groupBy(*MONTH).agg(F.count(F.lit(1)).alias("fill_dc_stop_count"))
    marks = [_marked(stops, "head", "first_of_stop"), _marked(sequences, "delivery_head", "delivery_stop")]
    return marks, cut_lineage(routes), cut_lineage(months)


def _with_routes(rows: DataFrame, routes: DataFrame, months: DataFrame) -> DataFrame:
    """What holds for the whole route and month, on each row."""
    known = F.col("fill_dc").isNotNull() & F.col("year").isNotNull()
    joined = join_back(join_back(rows, routes, ["route_key"], null_safe=False), months, MONTH, null_safe=False)
    return joined.withColumns(
        {
            "rc_total": F.coalesce("rc_total", F.lit(0.0)),
            "fm_count": F.coalesce("fm_count", F.lit(0)),
            "fill_dc_stop_count": F.when(known, F.coalesce("fill_dc_stop_count", F.lit(0))),
        }
    )


def _named_stops(rows: DataFrame) -> DataFrame:
    """The stop key is formed last, as only the reader of the rows may want it."""
    return rows if "stop_key" in rows.columns else rows.withColumn("stop_key", stop_key())


def flag_stops(events: DataFrame, order_cols: Sequence[str], scope: str = "all") -> DataFrame:
    """C1-C3 and the stop counts of C9 on each row."""
    rows = placed(numbered(events), order_cols, derive=_with_route_key)
    marks, routes, months = route_marks(rows, scope)
    flagged = _flagged(rows, marks, ["first_of_stop", "delivery_stop"])
    return _named_stops(_with_routes(flagged, routes, months)).drop("__place")


def route_cost(rate: str = "total_rate", overflow: str = "leg_total_cost") -> Column:
    """C4: what one row costs once the route charge is spread."""
    share = F.when(F.col("fm_count") > 0, F.col("rc_total") / F.col("fm_count")).otherwise(0.0)
    first_fm = _charge("FM") & (F.col("first_of_stop") == 1)
    return (
        F.when(_charge("RC", "TS"), F.lit(0.0))
        .when((F.col("rc_total") <= 0) & _charge("OV"), F.col(overflow))
        .when(F.col("rc_total") <= 0, F.col(rate))
        .when(first_fm, F.col(rate) + share)
        .when(_charge("FM"), F.lit(0.0))
        .otherwise(F.col(rate))
    )


# The two cost bases, (rate column, overflow column).
COST_BASES = {"rate": ("total_rate", "leg_total_cost"), "base": ("base_cost", "leg_misc_cost")}


def _on_basis(events: DataFrame, basis: str) -> DataFrame:
    return events if basis == "rate" else events.withColumn("total_rate", F.col(COST_BASES[basis][0]))


def cost_per_stop(events: DataFrame, order_cols: Sequence[str], basis: str = "rate", scope: str = "all") -> DataFrame:
    """C1-C4 (and C10 with ``basis='base'``): rows with ``cost_per_stop``."""
    flagged = flag_stops(_on_basis(events, basis), order_cols, scope)
    return flagged.withColumn("cost_per_stop", route_cost("total_rate", COST_BASES[basis][1]))


def week_stats(events: DataFrame, scope: str = "all", first: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Surcharge tables per (week, stop) and per week. ``first`` is the column whose
    minimum tells the first row of a week and stop."""
    extra = [] if first is None else [F.min(F.when(_in_scope(scope, DELIVERY_CHARGES), first)).alias("week_first")]
    stops = cut_lineage(events.groupBy("week_key", "stop_id").agg(
        *extra,
        F.max(_charge(*DELIVERY_CHARGES)).alias("has_delivery"),
        F.sum(F.when(_charge("TS"), fx.units("topside_cost"))).alias("ts_units"),
    ))
    weeks = (
        stops.filter(F.col("week_key").isNotNull())
        .groupBy("week_key")
        .agg(
            (F.coalesce(F.sum("ts_units"), F.lit(0)) / F.lit(fx.MONEY_UNITS)).alias("topside_total"),
            F.sum(F.when(F.col("has_delivery") & F.col("stop_id").isNotNull(), 1).otherwise(0)).alias("topside_stops"),
        )
    )
    return stops, weeks


def week_marks(rows: DataFrame, scope: str = "all") -> tuple[list[DataFrame], DataFrame]:
    """Marked places, weeks."""
    stops, weeks = week_stats(rows, scope, F.col("__place"))
    delivers = stops.filter(_is_kind("week_first", *DELIVERY_CHARGES))
    return [_marked(delivers, "week_first", "first_of_week")], cut_lineage(weeks)


def _with_weeks(rows: DataFrame, weeks: DataFrame) -> DataFrame:
    """The week's surcharge on each row, and the share of it."""
    share = F.when(F.col("topside_stops") > 0, F.col("topside_total") / F.col("topside_stops")).otherwise(0.0)
    return join_back(rows, weeks, ["week_key"], null_safe=False).withColumns(
        {
            "topside_total": F.coalesce("topside_total", F.lit(0.0)),
            "topside_stops": F.coalesce("topside_stops", F.lit(0)),
            "topside_share": F.when(F.col("first_of_week") == 1, share).otherwise(0.0),
        }
    )


def topside_share(events: DataFrame, order_cols: Sequence[str], scope: str = "all") -> DataFrame:
    """Each row with its share of the week's surcharge."""
    rows = placed(numbered(events), order_cols, derive=with_week_key)
    marks, weeks = week_marks(rows, scope)
    return _with_weeks(_flagged(rows, marks, ["first_of_week"]), weeks).drop("__place")


def flag_all(events: DataFrame, order_cols: Sequence[str], scope: str = "all") -> DataFrame:
    """``flag_stops`` and ``topside_share`` in one: one numbering, one join back."""
    rows = placed(numbered(events), order_cols, derive=lambda rows: with_week_key(_with_route_key(rows)))
    of_stops, routes, months = route_marks(rows, scope)
    of_weeks, weeks = week_marks(rows, scope)
    flagged = _flagged(rows, of_stops + of_weeks, list(MARKS))
    return _named_stops(_with_weeks(_with_routes(flagged, routes, months), weeks)).drop("__place")


def drop_topside_rows(events: DataFrame) -> DataFrame:
    """Surcharge rows are no stops; route-charge rows stay, at cost 0."""
    return events.filter(~_charge("TS"))


def allocate_costs(events: DataFrame, order_cols: Sequence[str], basis: str = "rate", scope: str = "all") -> DataFrame:
    """The whole allocation: route charges, weekly surcharges, stop counts."""
    rows = flag_all(_on_basis(events, basis), order_cols, scope)
    cost = route_cost("total_rate", COST_BASES[basis][1]) + F.col("topside_share")
    return drop_topside_rows(rows.withColumn("cost_per_stop", cost))


def allocation_audit(events: DataFrame, order_cols: Sequence[str], scope: str = "all") -> DataFrame:
    """C11: charged against allocated amounts per route and per week."""
    rows = flag_all(events, order_cols, scope)
    spread = (F.col("rc_total") > 0) & (F.col("fm_count") > 0) & _charge("FM") & (F.col("first_of_stop") == 1)
    spread_week = F.col("first_of_week") == 1
    parts = [
        # level, key, charged, hits, share, stops, the row's own charge
        ("route", "route_key", "rc_total", spread, fx.safe_div("rc_total", "fm_count"), "fm_count", F.when(_charge("RC"), F.col("total_rate"))),
        ("week", "week_key", "topside_total", spread_week, fx.safe_div("topside_total", "topside_stops"), "topside_stops", F.when(_charge("TS"), F.col("topside_cost"))),
    ]
    # both levels from one pass over the rows
    entries = [
        F.struct(
            F.lit(level).alias("level"), F.col(key).alias("group_key"), F.col(total).alias("charged"),
            fx.is_true(hit).cast("int").alias("hit"), share.alias("share"), F.col(stops).cast("bigint").alias("stops"),
            own.cast("double").alias("own"),
        )
        for level, key, total, hit, share, stops, own in parts
    ]
    allocated = F.coalesce(F.sum("hit") * F.max("share"), F.lit(0.0))
    # rows without a key share nothing: what they charge is all lost
    charged = F.when(F.col("group_key").isNull(), fx.money_sum0("own")).otherwise(F.max("charged"))
    return (
        rows.select(F.inline(F.array(*entries)))
        .groupBy("level", "group_key")
        .agg(charged.alias("charged"), allocated.alias("allocated"), F.max("stops").alias("stops"))
        .withColumn("lost", F.col("charged") - F.col("allocated"))
    )
