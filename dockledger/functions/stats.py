"""Statistics over groups, written so that no task has to hold a whole group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockledger.session import cut_lineage

# Value bands of the first pass of group_quantiles: bands per unit of ln|x|. The offset
# keeps the numbers of positive values above 0 and of negative ones below, down to 1e-308.
BANDS_PER_LOG = 512
BAND_OFFSET = 400_000
# Later passes cut an interval of values into so many parts, until it has few rows.
PARTS = 1024
INTERVAL_ROWS = 20_000


def scalars(df: DataFrame, **aggregates: Column) -> Column:
    """Global aggregates of ``df`` as one struct column for another frame.

    It becomes an uncorrelated scalar subquery: one row, computed once, read as
    a constant by every task.
    """
    return df.agg(F.struct(*[c.alias(n) for n, c in aggregates.items()]).alias("s")).scalar()


def join_back(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "left", null_safe: bool = True) -> DataFrame:
    """Attach per-group ``stats`` (one row per key) to the rows of ``df``.

    Rows stay on the probe side, so adaptive execution can split a hot key over
    several tasks; a window over the same key could not be split.
    """
    renamed = stats.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in stats.columns if c not in keys])
    pairs = [df[k].eqNullSafe(renamed[f"__{k}"]) if null_safe else df[k] == renamed[f"__{k}"] for k in keys]
    return df.join(renamed, reduce(lambda a, b: a & b, pairs), how).drop(*[f"__{k}" for k in keys])


def group_transform(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Aggregates of each row's group, on each row."""
    return join_back(df, df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()]), keys)


def long_values(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, metric, value) for the given numeric columns; nulls, NaN and
    infinities dropped."""
    pairs = ", ".join(f"struct('{c}' AS metric, CAST(`{c}` AS DOUBLE) AS value)" for c in columns)
    exploded = df.selectExpr(*[f"`{k}`" for k in keys], f"inline(array({pairs}))")
    return exploded.filter("value IS NOT NULL AND NOT isnan(value) AND abs(value) < DOUBLE('Infinity')")


def _holding_ranks(counted: DataFrame, group: Sequence[str], within: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Of counted value intervals (``lo``, ``hi``, ``n``, ``skip`` rows before the first
    of them and, but for the first pass, ``total``) those that hold a wanted rank."""
    part = Window.partitionBy(*group, *within)
    placed = counted.withColumn("upto", F.col("skip") + F.sum("n").over(part.orderBy("lo")))
    if "total" not in counted.columns:
        placed = placed.withColumn("total", F.sum("n").over(part))
    ranks = f"flatten(transform(array({', '.join(f'{p}D' for p in probs)}), p -> array(floor(p * (total - 1)), ceil(p * (total - 1)))))"
    kept = placed.filter(f"exists({ranks}, r -> r >= upto - n AND r < upto)")
    return kept.select(*group, "lo", "hi", "n", (F.col("upto") - F.col("n")).alias("before"), "total")


def _in_intervals(long: DataFrame, group: Sequence[str], intervals: DataFrame) -> DataFrame:
    """The values that lie in an interval of their group, with it as ``at``. A group has
    at most two intervals for each wanted probability, and they do not meet."""
    own = intervals.groupBy(*group).agg(F.collect_list(F.struct("lo", "hi", "before", "total")).alias("own"))
    met = join_back(long, own, group, how="inner")
    return met.withColumn("at", F.expr("get(filter(own, i -> value >= i.lo AND value <= i.hi), 0)")).filter("at IS NOT NULL").drop("own")


def quantile_intervals(long: DataFrame, group: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Value intervals that hold the wanted ranks of each group: ``lo``, ``hi``, ``n`` rows,
    ``before`` rows below, ``total`` rows. Each is a single value or has at most
    ``INTERVAL_ROWS`` rows.

    A selection by digits: a pass counts rows by (group, digit), which combines before
    the shuffle, and only the digits that hold a wanted rank are cut further. The first
    digit is a band of ln|x|; within a band the next ones are equal parts of what its
    values span, so doubles are told apart after a few passes."""
    band = F.expr(f"CASE WHEN value = 0 THEN 0 ELSE CAST(signum(value) AS BIGINT) * ({BAND_OFFSET} + floor(ln(abs(value)) * {BANDS_PER_LOG})) END")
    ends = [F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")]
    bands = long.groupBy(*group, band.alias("band")).agg(*ends).drop("band").withColumn("skip", F.lit(0).cast("long"))
    chosen = cut_lineage(_holding_ranks(bands, group, [], probs))
    wide = (F.col("lo") < F.col("hi")) & (F.col("n") > INTERVAL_ROWS)
    while not chosen.filter(wide).isEmpty():
        rows = _in_intervals(long, group, chosen.filter(wide))
        part = F.least(F.floor((F.col("value") - F.col("at.lo")) / (F.col("at.hi") - F.col("at.lo")) * PARTS), F.lit(PARTS - 1))
        parts = rows.groupBy(*group, F.col("at.lo").alias("from"), F.col("at.before").alias("skip"), F.col("at.total").alias("total"), part.alias("part")).agg(*ends)
        chosen = cut_lineage(chosen.filter(~wide).unionByName(_holding_ranks(parts.drop("part"), group, ["from"], probs)))
    return chosen


def group_quantiles(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, float]], written: bool = False) -> DataFrame:
    """Exact linear-interpolated quantiles of raw columns per group.

    ``wanted`` maps an output name to ``(column, probability)``. Meant for groups
    of any size and values of any distribution: the needed columns are written once
    (unless ``df`` is ``written`` already), ``quantile_intervals`` narrows down where the
    wanted ranks lie, and only the few rows there are put in order. Nulls are skipped.
    """
    group = [*keys, "metric"]
    columns = sorted({c for c, _ in wanted.values()})
    probs = sorted({float(p) for _, p in wanted.values()})
    needed = df.select(*dict.fromkeys([*keys, *columns]))
    long = long_values(needed if written else cut_lineage(needed), keys, columns)
    intervals = quantile_intervals(long, group, probs)

    single = intervals.filter("lo = hi").select(*group, F.col("lo").alias("value"), "n", (F.col("before") + F.col("n")).alias("last"), "total")
    counts = _in_intervals(long, group, intervals.filter("lo < hi")).groupBy(*group, "at", "value").agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy(*group, "at.lo").orderBy("value")
    several = counts.select(*group, "value", "n", (F.col("at.before") + F.sum("n").over(within)).alias("last"), F.col("at.total").alias("total"))
    ordered = single.unionByName(several)

    # what the value adds to the quantile: 1, or the share of the lower or upper neighbour
    weights = {}
    for i, p in enumerate(probs):
        at = f"({p}D * (total - 1))"
        low, high = (f"({f}{at} >= last - n AND {f}{at} < last)" for f in ("floor", "ceil"))
        share = f"({at} - floor{at})"
        weights[f"__w{i}"] = F.expr(
            f"CASE WHEN {low} AND {high} THEN 1D WHEN {low} THEN 1 - {share} WHEN {high} THEN {share} END"
        )
    parts = [
        F.expr(f"sum(CASE WHEN metric = '{c}' THEN value * __w{probs.index(float(p))} END) AS `{name}`")
        for name, (c, p) in wanted.items()
    ]
    return ordered.withColumns(weights).groupBy(*keys).agg(*parts)


def with_before(df: DataFrame, keys: Sequence[str], order: str, weight: Column, name: str = "before") -> DataFrame:
    """Adds to each row the sum of ``weight`` over the rows of its group that come before
    it in ``order``, whose values differ within a group.

    The rows are range-partitioned and written once, so a group of any size lies in
    consecutive partitions; sums run within each, and what the partitions before hold of
    the group is added. Only those sums, one a partition and group, meet in one task.
    """
    by = [F.col(k) for k in (*keys, order)]
    ranged = cut_lineage(df.withColumn("__w", weight).repartitionByRange(*by).withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy(*keys, "__part").agg(F.sum("__w").alias("__s"))
    earlier = Window.partitionBy(F.lit(0), *keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "__part", F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__offset"))
    within = Window.partitionBy("__part", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    running = ranged.withColumn(name, F.coalesce(F.sum("__w").over(within), F.lit(0)))
    return join_back(running, offsets, [*keys, "__part"]).withColumn(name, F.col(name) + F.col("__offset")).drop("__w", "__part", "__offset")


def average_ranks(df: DataFrame, value: str, keys: Sequence[str], name: str) -> DataFrame:
    """Adds the rank of ``value`` in its group with ties averaged, for groups of any
    size. Equal values are counted before they are ordered, so a hot value is one row;
    nulls come first and tie with each other."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    placed = with_before(counts, keys, value, F.col("__n"), name)
    ranks = placed.select(*keys, value, (F.col(name) + (F.col("__n") + 1) / F.lit(2.0)).alias(name))
    return join_back(df, ranks, [*keys, value])


def average_rank(value: str, keys: Sequence[str]) -> Column:
    """The same as a window column, where a group is some rows: one per market and
    period. ``average_ranks`` takes groups of any size."""
    ordered = Window.partitionBy(*keys).orderBy(value)
    ties = Window.partitionBy(*keys, value)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)


def describe_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: counts, range, moments and quartiles."""
    quartiles = {f"{c}__{int(p * 100)}": (c, p) for c in columns for p in (0.25, 0.5, 0.75)}
    spread = group_quantiles(df, [], quartiles).agg(
        F.struct(*[F.max(name).alias(name) for name in quartiles]).alias("s")
    ).scalar()
    moments = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[f(c).alias(f"{n}__{c}") for c in columns for n, f in
          (("count", F.count), ("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_samp))],
    )
    types = dict(df.dtypes)
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(types[c]).alias("dtype"),
            F.col("rows"),
            F.col(f"count__{c}").alias("non_null"),
            *[F.col(f"{n}__{c}").cast("double").alias(n) for n in ("min", "max", "mean", "std")],
            *[spread[f"{c}__{q}"].alias(f"p{q}") for q in (25, 50, 75)],
        )
        for c in columns
    ]
    return moments.select(F.inline(F.array(*rows)))
