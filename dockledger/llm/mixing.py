"""Mixing sources to target weights by Sainte-Lague apportionment of token blocks.

1. Sources are ordered by code point (null last) and weigh 5, 2, 1, repeating. They
   share ``share`` times all tokens by weight; a target stops at ``most`` times its
   source's size and the excess is shared again by weight until none is above.
2. The total is cut into blocks of equal size, ``block`` words or the smallest positive
   target if that is less, so that each source can come near its target. A source's quota is the number of its
   quotients target / (2k + 1) among the highest, which for one divisor d is
   round(target / d); the divisor that gives the wanted number is found by bisection
   over sums, so no list of quotients is made.
3. A source is dealt out by a hash of the id to shards of about ``shard_tokens``; its
   blocks are apportioned to them the same way. In a shard documents follow a seeded
   order, end to end, and blocks are consecutive runs of tokens in it. A quota of q
   blocks takes the whole shard as often as it fits and then the first blocks of the
   order, which is a seeded draw of blocks without replacement. So a shard is told by
   a few numbers: full rounds, the document where the last round ends, and how many
   words of it are taken.

DataFrame operations only. What passes through the driver is one row of sums in each
round of a bisection. The hot source is many shards; rows that agree in source, id and
size are counted before they are shuffled. Documents then meet two small tables, one
row per source and one per shard, so texts need not move.

Defined results: null and empty texts have size 0 and take 0; an empty table gives no
rows; a source of size 0 has target 0; rows that agree in source, id and size take the
same number of words; input columns other than id, source and text are ignored. No
document is taken more than ``most`` times. The same rows give the same result in any
order and partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockledger.llm.common import words
from dockledger.session import cut_lineage

WEIGHTS = (5, 2, 1)


def source_targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source``, ``source_size`` -> with ``weight`` and ``target``.

    ``sources`` has one row per source. Its code point order is the binary order of
    Spark's strings. The level L solves sum(min(most * size, weight * L)) = share * total:
    each round caps the sources that are above it, as the sharing of the excess does.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    listed = sources.withColumn("_n", F.row_number().over(order) - 1)
    weigh = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("_n", F.lit(len(weights))) + 1).cast("int"))
    listed = cut_lineage(listed.select("source", "source_size", weigh.cast("double").alias("weight"), (F.col("source_size") * most).alias("_cap")))
    goal = share * (listed.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        capped = F.col("_cap") <= F.col("weight") * level
        fixed, free = listed.agg(F.sum(F.when(capped, F.col("_cap"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if not free or (new := (goal - (fixed or 0.0)) / free) <= level:
            break
        level = new
    return listed.withColumn("target", F.least("_cap", F.col("weight") * F.lit(level))).drop("_cap")


def _rounded(c: str, divisor: float) -> Column:
    """Quotas at one divisor: how many odd quotients reach it."""
    return F.floor(F.col(c) / F.lit(divisor) + 0.5).cast("long")


def source_quotas(targets: DataFrame, block: int) -> DataFrame:
    """Adds ``quota``: Sainte-Lague seats for round(total / block) blocks in all.

    Bisection narrows the divisor until the sum of quotas is the wanted number; if
    equal quotients make that impossible, the sources next in line (largest quotient,
    then smallest name) get the remaining seats.
    """
    rows = cut_lineage(targets)
    total, top, listed = rows.agg(F.sum("target"), F.max("target"), F.count("*")).first()
    seats = round((total or 0.0) / block)
    if not seats:
        return rows.withColumn("quota", F.lit(0).cast("long"))
    # Each quota is within 1/2 of target / d, which brackets the divisor.
    low = total / (seats + listed / 2 + 1.0)
    high = total / (seats - listed / 2 - 1.0) if seats > listed / 2 + 1.0 else 4.0 * top + 1.0
    while not (rows.agg(F.sum(_rounded("target", low))).first()[0] or 0) >= seats:
        low /= 4.0
    for _ in range(70):
        mid = (low + high) / 2
        got = rows.agg(F.sum(_rounded("target", mid))).first()[0] or 0
        low, high = (mid, high) if got >= seats else (low, mid)
        if got == seats or high - low <= 1e-12 * high:
            break
    base = high if got != seats else low
    out = rows.withColumn("quota", _rounded("target", base))
    missing = seats - (out.agg(F.sum("quota")).first()[0] or 0)
    if missing > 0:
        turn = Window.orderBy((F.col("target") / (2 * F.col("quota") + 1)).desc(), F.col("source").asc_nulls_last())
        out = out.withColumn("quota", F.col("quota") + (F.row_number().over(turn) <= missing).cast("long"))
    return cut_lineage(out)


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source`` and ``size`` in words."""
    return rows_of(docs).drop("_row")


def _shard(source_rows: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col(source_rows)).cast("int")


def _order(seed: int) -> Column:
    return F.xxhash64(F.lit(seed + 1), "doc_id")


def plan(
    rows: DataFrame,
    share: float = 1.5,
    most: float = 2.0,
    weights: tuple[int, ...] = WEIGHTS,
    block: int = 256,
    shard_tokens: int = 1_000_000,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """From ``doc_id``, ``source`` and ``size``: a row per source (target, quota, number
    of shards) and a row per shard (full rounds, where the last round ends)."""
    units = cut_lineage(rows.groupBy("source", "doc_id", "size").agg(F.count("*").alias("_rows")))
    tokens = F.col("size") * F.col("_rows")
    sources = units.groupBy("source").agg(F.sum(tokens).alias("source_size"))
    targets = cut_lineage(source_targets(sources, share, most, weights))
    least = targets.filter("target > 0").agg(F.min("target")).first()[0]
    block = max(1, min(block, int(least or block)))
    quotas = source_quotas(targets, block)
    quotas = quotas.withColumn("_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_tokens)).cast("int"))

    named = quotas.select(F.col("source").alias("_source"), "_shards", "source_size", "quota")
    placed = units.filter("size > 0").join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("_shard", _shard("_shards", seed))
    sizes = placed.groupBy("source", "_shard").agg(
        F.sum(tokens).alias("_tokens"), F.max("quota").alias("_quota"), F.max("source_size").alias("_all")
    )
    wanted = F.least(F.col("_blocks") * block, F.floor(F.col("_tokens") * most).cast("long"))
    shards = apportion_shards(sizes).withColumn("_wanted", wanted)
    shards = shards.select(
        F.col("source").alias("_source"), F.col("_shard").alias("_number"), F.expr("_wanted DIV _tokens").alias("_full"), (F.col("_wanted") % F.col("_tokens")).alias("_rest")
    )
    order = Window.partitionBy("source", "_shard").orderBy(_order(seed), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    begun = placed.withColumn("_start", F.coalesce(F.sum(tokens).over(order), F.lit(0))).join(
        shards, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_shard") == F.col("_number"))
    )
    ends = begun.filter((F.col("_start") <= F.col("_rest")) & (F.col("_rest") < F.col("_start") + tokens))
    part = F.floor((F.col("_rest") - F.col("_start")) / F.col("_rows")).cast("long")
    ends = ends.select(
        F.col("source").alias("_in"), F.col("_shard").alias("_number"), "_full", F.struct(_order(seed).alias("o"), F.col("doc_id").alias("d"), F.col("size").alias("s")).alias("_end"), part.alias("_part")
    )
    return cut_lineage(quotas), cut_lineage(ends)


def taken(rows: DataFrame, quotas: DataFrame, ends: DataFrame, seed: int = 17) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``taken`` to ``doc_id``, ``source``, ``size``."""
    named = quotas.select(F.col("source").alias("_source"), "source_size", "target", "_shards")
    known = rows.join(named, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source").withColumn("_shard", _shard("_shards", seed))
    known = known.join(ends, F.col("source").eqNullSafe(F.col("_in")) & (F.col("_shard") == F.col("_number")), "left")
    me = F.struct(_order(seed).alias("o"), F.col("doc_id").alias("d"), F.col("size").alias("s"))
    last = F.when(me < F.col("_end"), F.col("size")).when(me == F.col("_end"), F.col("_part")).otherwise(F.lit(0))
    words_taken = F.when(F.col("size") > 0, F.col("_full") * F.col("size") + last).otherwise(F.lit(0))
    return known.withColumn("taken", words_taken.cast("long")).select(*rows.columns, "source_size", "target", "taken")


def mix(rows: DataFrame, seed: int = 17, **settings: object) -> DataFrame:
    """``doc_id``, ``source``, ``size`` -> with ``source_size``, ``target``, ``taken``."""
    return taken(rows, *plan(rows, seed=seed, **settings), seed=seed)


def apportion_shards(sizes: DataFrame) -> DataFrame:
    """Blocks of each shard: its source's quota by Sainte-Lague over the tokens.

    With t tokens of T and q blocks, the divisor T / q gives floor(q t / T + 1/2); what
    that misses or exceeds is settled by the quotients next in line, ranked within the
    source (one row per shard).
    """
    exact = F.col("_quota") * F.col("_tokens") / F.greatest(F.col("_all"), F.lit(1))
    first = sizes.withColumn("_blocks", F.floor(exact + 0.5).cast("long"))
    source = Window.partitionBy("source")
    off = first.withColumn("_off", F.col("_quota") - F.sum("_blocks").over(source))
    up = F.row_number().over(source.orderBy((F.col("_tokens") / (2 * F.col("_blocks") + 1)).desc(), "_shard"))
    down = F.row_number().over(source.orderBy(F.when(F.col("_blocks") > 0, F.col("_tokens") / (2 * F.col("_blocks") - 1)).asc_nulls_last(), "_shard"))
    step = F.when((F.col("_off") > 0) & (F.col("_up") <= F.col("_off")), 1).when((F.col("_off") < 0) & (F.col("_down") <= -F.col("_off")) & (F.col("_blocks") > 0), -1)
    return off.withColumns({"_up": up, "_down": down}).withColumn("_blocks", F.col("_blocks") + F.coalesce(step, F.lit(0))).drop("_up", "_down", "_off")


def rows_of(docs: DataFrame) -> DataFrame:
    """``sized`` rows that carry the document along."""
    size = F.size(words(F.col("text").cast("string"))).cast("long").alias("size")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size, F.struct("*").alias("_row"))


def mix_documents(docs: DataFrame, seed: int = 17, **settings: object) -> DataFrame:
    """The mixed documents: each row as often as it is taken whole, and the leading
    words of one more copy where a part is left (single spaces between them)."""
    columns = docs.columns
    rows = sized(docs)
    mixed = taken(rows_of(docs), *plan(rows, seed=seed, **settings), seed=seed)
    times = F.when(F.col("size") > 0, F.expr("taken DIV size")).otherwise(F.lit(0))
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0))
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), times.cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    each = mixed.select("_row", F.explode(copies).alias("_words"))
    head = F.array_join(F.slice(words(F.col("_row.text").cast("string")), F.lit(1), F.greatest(F.col("_words"), F.lit(1)).cast("int")), " ")
    text = F.when(F.col("_words") < 0, F.col("_row.text")).otherwise(head)
    out = each.withColumn("_text", text)
    changed = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return out.select(*[changed[c].alias(c) if c in changed else F.col("_row")[c].alias(c) for c in columns])
