"""Geography multiplier from route geometry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockledger.functions import columns as fx
from dockledger.functions.stats import join_back
from dockledger.session import cut_lineage, partitions_of, spread

ROUTE_DAY = ["route_id", "origin", "fill_dc", "route_date"]
COORDS = ["dest_lat", "dest_lon"]


def route_stops(shipments: DataFrame, since: str | None = None) -> DataFrame:
    """G1: distinct located stops per route-day; origin becomes the dock code."""
    located = shipments.dropna(subset=["route_id", "stop_id", "dest_lat", "dest_lon", "carrier_cd"])
    if since is not None:
        located = located.filter(F.col("contract_time") >= F.lit(since).cast("timestamp"))
    return located.select(
        "route_id",
        "stop_id",
        fx.dock_code("origin", "carrier_cd").alias("origin"),
        "fill_dc",
        F.to_date("contract_time").alias("route_date"),
        *COORDS,
        "origin_lat",
        "origin_lon",
    ).distinct()


def _sequenced(stops: DataFrame, chunk: int) -> DataFrame:
    """Stops with ``__at``, ascending in the order of their route-day, and their run:
    ``__part`` and ``__run``, at most ``chunk`` neighbours of one range partition. They are
    written first: sampling split points would form them again, and their number gives
    that of the range partitions, which adaptive execution then does not merge."""
    order = [*ROUTE_DAY, F.col("__num").isNull(), "__num", "stop_id", *COORDS]
    kept = cut_lineage(stops)
    ranged = kept.withColumn("__num", fx.numeric_text("stop_id"))
    ranged = ranged.repartitionByRange(partitions_of(kept.sparkSession, kept.count()), *order)
    ranged = ranged.sortWithinPartitions(*order).drop("__num")
    placed = cut_lineage(ranged.withColumn("__at", F.monotonically_increasing_id()))
    local = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumns({"__part": F.shiftrightunsigned("__at", 33), "__run": F.floor(local / chunk)})


def previous_stop(stops: DataFrame, chunk: int = 1000) -> DataFrame:
    """Coordinates of the previous stop on the route-day, else the origin's.

    Stops are ordered by numeric id, then text; ids that are no numbers come last. They
    are range-partitioned in that order by sampled split points and cut into runs of
    neighbours, so a very long route-day is spread over tasks whatever its ids look
    like: inside a run the previous row is a plain lag, and the first row of a run
    continues from the last stop of the run before it.
    """
    rows, run = _sequenced(stops, chunk), ["__part", "__run"]
    ends = rows.groupBy(*ROUTE_DAY, *run).agg(*[F.max_by(c, "__at").alias(c) for c in COORDS])
    across = Window.partitionBy(*ROUTE_DAY).orderBy(*run)
    before = {c: f"__before_{c}" for c in COORDS}
    # only the first route-day of a run goes on from an earlier one: at most one row a run
    starts = cut_lineage(ends.select(*run, *[F.lag(c).over(across).alias(b) for c, b in before.items()]).dropna("all", subset=[*before.values()]))
    # a lag of plain columns widens no row that is sorted, and the join needs the rows as the lag leaves them
    last = {c: f"__last_{c}" for c in [*ROUTE_DAY, *COORDS, "__at"]}
    within = Window.partitionBy(*run).orderBy("__at")
    rows = spread(rows, *run, rows=rows.count()).withColumns({name: F.lag(c).over(within) for c, name in last.items()})
    rows = join_back(rows, starts, run, null_safe=False)
    same_day = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(last[c])) for c in ROUTE_DAY])

    def previous(c: str) -> Column:
        return F.when(F.col(last["__at"]).isNull(), F.col(before[c])).when(same_day, F.col(last[c]))

    return rows.withColumns(
        {
            "prev_lat": F.coalesce(previous("dest_lat"), F.col("origin_lat")),
            "prev_lon": F.coalesce(previous("dest_lon"), F.col("origin_lon")),
        }
    ).drop("__at", *run, *last.values(), *before.values())


def leg_miles(sequenced: DataFrame) -> DataFrame:
    """Miles from the previous stop; rows without a previous point are dropped."""
    known = sequenced.dropna(subset=["prev_lat", "prev_lon"])
    return known.withColumn(
        "leg_miles", fx.leg_miles(F.col("prev_lat"), F.col("prev_lon"), F.col("dest_lat"), F.col("dest_lon"))
    )


def route_day_summary(legs: DataFrame) -> DataFrame:
    """Distinct stops, miles and miles per stop of each route-day."""
    return (
        legs.groupBy(*ROUTE_DAY)
        .agg(F.count_distinct("stop_id").alias("distinct_stops"), F.sum("leg_miles").alias("total_miles"))
        .withColumn("miles_per_stop", fx.safe_div("total_miles", "distinct_stops"))
    )


def origin_month_summary(route_days: DataFrame) -> DataFrame:
    """Per origin and month over route-days with more than one stop."""
    per_stop = F.col("miles_per_stop")
    return (
        route_days.filter(F.col("distinct_stops") > 1)
        .groupBy(F.year("route_date").alias("year"), F.month("route_date").alias("month"), "origin")
        .agg(
            F.count(F.lit(1)).alias("route_days"),
            F.sum("distinct_stops").alias("total_stops"),
            F.round(F.sum("total_miles"), 2).alias("total_leg_miles"),
            F.round(fx.safe_div(F.sum("total_miles"), F.sum("distinct_stops")), 2).alias("weighted_miles_per_stop"),
            F.round(F.median(per_stop), 2).alias("median_miles_per_stop"),
            F.round(F.percentile(per_stop, F.lit(0.75)), 2).alias("p75_miles_per_stop"),
            F.round(F.max(per_stop), 2).alias("max_miles_per_stop"),
        )
    )


def monthly_minimum(origins: DataFrame, value: str = "median_miles_per_stop") -> DataFrame:
    """Smallest value of the month among origins that are no crossdock.

    In the pattern the underscore stands for any one character. The table has one
    row per origin and month, so a window holds one month's origins.
    """
    plain = ~F.col("origin").like("XD_%")
    month = Window.partitionBy("year", "month")
    return origins.withColumn("baseline", F.min(F.when(plain, F.col(value))).over(month))


def geography_multiplier(origins: DataFrame, cap: float = 1.5, power: float = 0.3) -> DataFrame:
    """Damped ratio to the baseline; null in a month without a baseline."""
    ratio = F.pow(fx.safe_div("median_miles_per_stop", "baseline"), F.lit(power))
    capped = F.when(ratio.isNotNull(), F.least(F.lit(cap), ratio))
    return monthly_minimum(origins).withColumn("geography_multiplier", F.round(capped, 2))


def geography_table(shipments: DataFrame, since: str | None = None) -> DataFrame:
    """G1-G5 in one go."""
    legs = leg_miles(previous_stop(route_stops(shipments, since)))
    return geography_multiplier(origin_month_summary(route_day_summary(legs)))
