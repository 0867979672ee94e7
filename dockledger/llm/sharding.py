"""Sharding by extendible hashing under a byte limit.

A document's address is the bits of a hash of its id. All start in one bucket; a bucket
above the limit, with more than one row, splits on its next bit; others stay. So a
document's shard is its shortest prefix whose bucket fits, and the directory maps every
prefix of the greatest depth to the shard that covers it.

DataFrame operations only. Depths are found from sums, not by splitting rows step by
step: bytes are summed by a prefix of a few bits more than the shards need, those sums
are rolled up to every shorter prefix, and the first that fits is the shard. Only rows of
cells that are still too large go on, by the following bits. The bits of the id are
followed by those of a row number that is fixed by writing the narrow rows once, so one
id that repeats without end splits as well. Texts are never moved.

Defined results: a null text has 0 bytes; a null id hashes like the empty text; one
row above the limit is a shard alone (``oversized``); repeated rows are placed each;
an empty table gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockledger.session import cut_lineage

LIMIT = 8 * 1024 * 1024
ID_BITS = 60


def bits_of(value: Column) -> Column:
    """60 bits of a hash as text."""
    hexes = F.substring(F.md5(F.coalesce(value.cast("string"), F.lit(""))), 1, ID_BITS // 4)
    return F.lpad(F.conv(hexes, 16, 2), ID_BITS, "0")


def _depths(cells: DataFrame, limit: int, known: int, depth: int) -> DataFrame:
    """``cell``, ``bytes``, ``rows`` of prefixes of ``depth`` bits -> with the first depth
    from ``known`` on whose prefix fits (null if none)."""
    levels = cells.select("cell", "bytes", "rows", F.explode(F.sequence(F.lit(known), F.lit(depth))).alias("d"))
    sums = levels.groupBy("d", F.expr("substring(cell, 1, d)").alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    fits = sums.filter((F.col("bytes") <= limit) | (F.col("rows") == 1)).select("d", "prefix")
    met = levels.select("cell", "d", F.expr("substring(cell, 1, d)").alias("prefix")).join(fits, ["d", "prefix"])
    return cells.select("cell").join(met.groupBy("cell").agg(F.min("d").alias("depth")), "cell", "left")


def assign(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, ``bytes``, ``shard`` (its prefix as text), ``depth``, ``oversized``; narrow
    columns to ``carry`` along follow."""
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), size.alias("bytes"), F.monotonically_increasing_id().alias("_row"), *carry)
    left = rows = cut_lineage(rows)
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    address = F.concat(bits_of(F.col("doc_id")), bits_of(F.col("_row")))
    known, width = 0, min(20, max(4, math.ceil(math.log2(max(total, 1) / limit + 1)) + 3))
    done = []
    while True:
        depth = min(known + width, 2 * ID_BITS)
        celled = left.withColumn("cell", F.substring(address, 1, depth))
        cells = celled.groupBy("cell").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"))
        found = cut_lineage(_depths(cut_lineage(cells), limit, known, depth))
        placed = celled.join(found, "cell")
        done.append(placed.filter("depth IS NOT NULL").select("doc_id", "bytes", F.expr("substring(cell, 1, depth)").alias("shard"), "depth", *carry))
        if depth == 2 * ID_BITS or found.filter("depth IS NULL").isEmpty():
            break
        left = cut_lineage(placed.filter("depth IS NULL").select("doc_id", "bytes", "_row", *carry))
        known, width = depth, 8
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "bytes", "shard", "depth", (F.col("bytes") > limit).alias("oversized"), *carry)


def directory(assigned: DataFrame) -> DataFrame:
    """One row per shard: its prefix, depth, rows and bytes, and how many of the
    2^(greatest depth) directory entries point to it."""
    shards = assigned.groupBy("shard", "depth").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes"))
    deepest = assigned.agg(F.max("depth")).first()[0] or 0
    return shards.withColumn("entries", F.pow(F.lit(2.0), F.lit(deepest) - F.col("depth")))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Whole rows of documents, one folder for each shard of ``assign``. Rows are numbered
    once and found again by that number, so repeated and null ids are written as often as
    they occur. The column names ``shard`` and ``_write_row`` are taken."""
    kept = cut_lineage(docs.withColumn("_write_row", F.monotonically_increasing_id()))
    placed = assign(kept, limit, carry=["_write_row"]).select("_write_row", F.concat(F.lit("s"), "shard").alias("shard"))
    kept.join(placed, "_write_row").drop("_write_row").repartition("shard").write.partitionBy("shard").parquet(path)


# The same shards in DuckDB's SQL, for unique ids.
SQL = f"""
WITH r AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes,
         lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)), 60, '0') AS bits
  FROM documents
),
p AS (SELECT doc_id, bytes, d, substr(bits, 1, d) AS shard FROM r, (SELECT unnest(range(0, 41)) AS d) x),
s AS (SELECT *, sum(bytes) OVER (PARTITION BY d, shard) AS total, count(*) OVER (PARTITION BY d, shard) AS n FROM p)
SELECT doc_id, bytes, arg_min(shard, d) AS shard, CAST(min(d) AS INTEGER) AS depth, bytes > {LIMIT} AS oversized
FROM s WHERE total <= {LIMIT} OR n = 1 GROUP BY doc_id, bytes
"""
