"""Approximate nearest neighbours by shifted Hilbert curves.

Equal vectors are one class. Each of ``curves`` orderings projects the classes to
``dims`` coordinates (random orthonormal directions), shifts and cuts them to ``bits``
bits and takes the Hilbert key. Rows of one cell are ordered by a second, fine Hilbert
key of the same coordinates (``fine`` bits each, far beyond the cells' range and far
below their width), so a tight group of vectors is ordered by place as the table is.
Spark range-partitions all (curve, key, fine key) rows; within a sorted partition each
query is compared with its neighbours on either side (at the edge of a partition or
curve with the nearest of twice as many). Rows carry the vector in the precision given,
by which the ``keep`` best of a window stay; the windows of a query merge, and its best
``rerank`` classes are measured exactly, in double precision, on the original vectors.
Both cuts keep all that tie with the last.

A class lists its k + 1 smallest ids, which is all that a result of k can need of it,
so a vector that a third of all rows share is one row among the candidates. Nothing
is collected but per-dimension moments.

Windows follow the number of classes n: ``window`` + n / ``share`` neighbours on either
side. What they find of the true neighbours depends on the intrinsic dimension: for
vectors spread evenly over all 64 dimensions no fixed window keeps its recall as the
table grows, so the comparisons of a query grow with the table.

Defined results: vectors that are null, zero, or hold null or non-finite components
take no part, nor do those of another length than the most common (the longest of
those if tied); equal distances go to the smaller id; with fewer candidates than k all
are returned; a repeated id is a candidate each time for others, never for itself; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from dockledger.session import cut_lineage


@dataclass(frozen=True)
class Curves:
    k: int = 10
    curves: int = 64
    dims: int = 16
    bits: int = 2
    fine: int = 32
    window: int = 256
    share: int = 400
    keep: int = 20
    rerank: int = 50
    seed: int = 5


def transposed(cells: np.ndarray, bits: int) -> list[np.ndarray]:
    """Skilling's transform, all points at once: the bits of a point's place on the
    Hilbert curve, dealt out to its coordinates."""
    axes = [cells[:, i].copy() for i in range(cells.shape[1])]
    kind = cells.dtype.type
    bit = 1 << (bits - 1)
    while bit > 1:
        low = kind(bit - 1)
        for i in range(len(axes)):
            on = (axes[i] & kind(bit)) != 0
            swap = (axes[0] ^ axes[i]) & low
            axes[0] = np.where(on, axes[0] ^ low, axes[0] ^ swap)
            if i:
                axes[i] = np.where(on, axes[i], axes[i] ^ swap)
        bit >>= 1
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    flip, bit = np.zeros_like(axes[0]), 1 << (bits - 1)
    while bit > 1:
        flip = np.where((axes[-1] & kind(bit)) != 0, flip ^ kind(bit - 1), flip)
        bit >>= 1
    return [x ^ flip for x in axes]


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points."""
    axes = transposed(cells.astype(np.uint64), bits)
    key = np.zeros_like(axes[0])
    for j in range(bits - 1, -1, -1):
        for x in axes:
            key = (key << np.uint64(1)) | ((x >> np.uint64(j)) & np.uint64(1))
    return key


def fine_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The same of ``bits`` up to 32, as rows of bytes that sort like the places."""
    axes = np.stack(transposed(cells.astype(np.uint32), bits), axis=1) << np.uint32(32 - bits)
    each = np.unpackbits(axes.astype(">u4").view(np.uint8).reshape(*axes.shape, 4), axis=2)[:, :, :bits]
    return np.packbits(each.transpose(0, 2, 1).reshape(len(axes), -1), axis=1)


FINE_RANGE = 256  # the fine key reaches so many times as far as the cells


def curve_keys(scaled: np.ndarray, block: np.ndarray, shift: np.ndarray, how: Curves) -> tuple[np.ndarray, np.ndarray]:
    """Key and fine key of standardized vectors on one curve."""
    place = (scaled @ block) / 6 + 0.5 + shift
    cells, ends = place * (1 << how.bits), (1 << how.bits) - 1
    fine, top = ((place - 0.5) / FINE_RANGE + 0.5) * 2.0**how.fine, 2.0**how.fine - 1
    return hilbert_keys(np.clip(cells, 0, ends).astype(np.uint64), how.bits), fine_keys(np.clip(fine, 0, top).astype(np.uint64), how.fine)


def curve_shifts(blocks: np.ndarray, how: Curves) -> np.ndarray:
    return np.random.default_rng(how.seed + 1).uniform(-0.08, 0.08, (len(blocks), blocks.shape[2]))


def directions(length: int, how: Curves) -> np.ndarray:
    """One block of ``dims`` orthonormal directions per curve, as far as the length
    allows."""
    r, dims = np.random.default_rng(how.seed), min(how.dims, length)
    blocks: list[np.ndarray] = []
    while len(blocks) < how.curves:
        basis, _ = np.linalg.qr(r.standard_normal((length, length)))
        blocks += [basis[:, i : i + dims] for i in range(0, length - dims + 1, dims)]
    return np.stack(blocks[: how.curves])


TIE = 1 + 1e-12


def distances(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Squared distances, in double precision: differences are taken before squares, so
    near copies are told apart."""
    apart = rows.astype(np.float64) - one
    return np.einsum("ij,ij->i", apart, apart)


def usable(c: str) -> Column:
    v = F.col(c)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def search(vectors: DataFrame, is_query: Column, how: Curves = Curves()) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` for the rows of ``vectors``
    (``vec_id``, ``embedding``) that ``is_query`` marks, against all rows."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    given = given.filter(F.col("vec_id").isNotNull()).filter(usable("embedding"))
    lengths = given.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if lengths is None:
        return empty
    length = lengths["n"]
    hashed = given.filter(F.size("embedding") == length).select("*", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    rows = cut_lineage(hashed.withColumn("_row", F.monotonically_increasing_id()))

    kinds = rows.groupBy("h1", "h2").agg(F.min("_row").alias("cid"), F.max("asks").alias("asks"))
    kinds = cut_lineage(kinds)
    classes = cut_lineage(rows.select(F.col("_row").alias("cid"), "embedding").join(kinds.select("cid", "asks"), "cid"))
    order = Window.partitionBy("h1", "h2").orderBy("vec_id", "_row")
    listed = rows.select("h1", "h2", "vec_id", "_row").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= how.k + 1)
    listed = listed.join(kinds.select("h1", "h2", "cid"), ["h1", "h2"]).groupBy("cid").agg(F.collect_list("vec_id").alias("ids"))

    count = kinds.count()
    side = how.window + count // how.share
    single = isinstance(getattr(vectors.schema["embedding"].dataType, "elementType", None), FloatType)
    kind = np.float32 if single else np.float64
    moments = classes.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()
    mean = np.zeros(length)
    spread = np.zeros(length)
    for r in moments:
        mean[r.i], spread[r.i] = r.m, r.s
    frame = spark.sparkContext.broadcast((mean, np.where(spread > 0, spread, 1.0), directions(length, how)))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, spread, blocks = frame.value
        shifts = curve_shifts(blocks, how)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            given = pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())
            scaled = (x - mean) / spread
            for c, block in enumerate(blocks):
                key, fine = curve_keys(scaled, block, shifts[c], how)
                fine = pa.array([v.tobytes() for v in fine], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, c, np.int32)), pa.array(key.astype(np.int64)), fine, batch.column(0), batch.column(2), given], names=["curve", "key", "fine", "cid", "asks", "vector"])

    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), count * how.curves // (16 * side)))
    placed = classes.select("cid", "embedding", "asks").mapInArrow(keyed, "curve int, key long, fine binary, cid long, asks boolean, vector binary")
    placed = placed.repartitionByRange(parts, "curve", "key", "fine", "cid").sortWithinPartitions("curve", "key", "fine", "cid").drop("key", "fine")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Holds 4 x side rows and the batch at hand."""
        w = side
        curve, cid, asks = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, bool)
        vector = np.empty((0, length), kind)

        def compare(at: np.ndarray, first: int, last: int) -> Iterator[pa.RecordBatch]:
            """Rows ``at`` against their windows within rows first..last of one curve."""
            found = ([], [], [])
            for q in at:
                low = max(first, min(q - w, last - 2 * w - 1))
                high = min(last, max(q + w + 1, first + 2 * w + 1))
                d = distances(vector[low:high], vector[q])
                d[q - low] = np.inf
                last_kept = np.partition(d, min(how.keep, len(d)) - 1)[min(how.keep, len(d)) - 1]
                best = np.flatnonzero((d <= last_kept * TIE) & (np.arange(low, high) != q))
                for column, value in zip(found, (np.full(len(best), cid[q]), cid[low:high][best], d[best]), strict=True):
                    column.append(value)
            if found[0]:
                arrays = [np.concatenate(c) for c in found]
                yield pa.RecordBatch.from_arrays([pa.array(arrays[0], pa.int64()), pa.array(arrays[1], pa.int64()), pa.array(arrays[2])], names=["asker", "cid", "near"])

        done = 0  # rows before it are answered

        def answer(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal done
            edges = [0, *(np.flatnonzero(np.diff(curve)) + 1).tolist(), len(curve)]
            for first, last in zip(edges[:-1], edges[1:], strict=True):
                ready = last if final or last < len(curve) else last - w
                at = np.flatnonzero(asks[first:last]) + first
                yield from compare(at[(at >= done) & (at < ready)], first, last)
                done = max(done, min(ready, last))

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            curve = np.concatenate([curve, batch.column(0).to_numpy()])
            cid = np.concatenate([cid, batch.column(1).to_numpy()])
            asks = np.concatenate([asks, batch.column(2).to_numpy(zero_copy_only=False)])
            vector = np.concatenate([vector, np.frombuffer(b"".join(batch.column(3).to_pylist()), kind).reshape(n, length)])
            if len(curve) < 4 * w:
                continue
            yield from answer(False)
            cut = max(0, min(done - 2 * w, len(curve) - 2 * w))
            curve, cid, asks, vector, done = curve[cut:], cid[cut:], asks[cut:], vector[cut:], done - cut
        if len(curve):
            yield from answer(True)

    near = placed.mapInArrow(windows, "asker long, cid long, near double")
    merged = near.groupBy("asker", "cid").agg(F.min("near").alias("near"))
    top = Window.partitionBy("asker").orderBy("near", "cid")
    cuts = merged.withColumn("_n", F.row_number().over(top)).filter(F.col("_n") == how.rerank).select("asker", F.col("near").alias("_cut"))
    within = F.col("_cut").isNull() | (F.col("near") <= F.col("_cut") * TIE)
    chosen = merged.join(cuts, "asker", "left").filter(within).select("asker", "cid")
    askers = kinds.filter("asks").select(F.col("cid").alias("asker"))
    chosen = cut_lineage(chosen.unionByName(askers.withColumn("cid", F.col("asker"))))

    vector = classes.select("cid", "embedding")
    paired = chosen.join(vector, "cid").join(vector.withColumnsRenamed({"cid": "asker", "embedding": "_query"}), "asker")
    square = F.aggregate(F.zip_with("embedding", "_query", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    measured = paired.select("asker", "cid", F.sqrt(square).alias("score")).join(listed, "cid")
    each = measured.select("asker", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("asker").orderBy("score", "vec_id")
    each = each.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= how.k + 1).drop("_n")
    queries = rows.filter("asks").select("vec_id", "h1", "h2").distinct().join(kinds.select("h1", "h2", F.col("cid").alias("asker")), ["h1", "h2"])
    found = queries.select(F.col("vec_id").alias("query_id"), "asker").join(each, "asker").filter("query_id <> vec_id")
    final = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= how.k).select("query_id", "rank", "vec_id", "score")
