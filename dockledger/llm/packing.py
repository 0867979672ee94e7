"""Best-fit packing of documents into training sequences (vector bin packing).

Every piece of a document needs three things of a sequence: tokens, one place among
its documents, and attention cost (length squared, as attention stays inside a
piece). A piece goes to the open sequence that can still take all three and fits
best, pieces by falling length.

How it runs: documents become pieces in one pass; pieces that fill a sequence alone
are sequences at once. All others are dealt out evenly, by row and not by key, to
groups of about ``group_rows`` pieces; each group is packed by itself, so a task never
holds more than one group, and the loss against one great group is about one
half-filled sequence in ``group_rows`` pieces.

Defined results: a null text is an empty document (the end token alone); an empty
table gives no rows; repeated rows are packed as often as they occur; columns other
than the id and the text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockledger.llm.common import row_groups
from dockledger.llm.tokens import default_path, encoder
from dockledger.session import cut_lineage

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
END = 2


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds. The defaults bind on tokens alone: a piece has at
    least one token, and squares of lengths that sum to 1024 sum to at most 1024^2."""

    tokens: int = 1024
    documents: int = 1024
    attention: float = 1024.0**2
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)
    rule: str = "norm"  # or "dot"


def cuts(length: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be short."""
    first = length % most or most
    return [(0, first)] + [(s, most) for s in range(first, length, most)]


def tokenized(docs: DataFrame, most: int = 1024, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece. ``with_ids`` adds the token ids, else only their checksum."""
    path = path or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    if with_ids:
        schema = schema.append(pa.field("ids", pa.list_(pa.int64())))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(enc.encode(text.as_py()), np.uint32(END)).astype("<u4")
                for i, (start, n) in enumerate(cuts(len(ids), most)):
                    part = ids[start : start + n]
                    row = (doc_id, i, start, n, zlib.crc32(part.tobytes()))
                    out.append((*row, part.tolist()) if with_ids else row)
            columns = zip(*out) if out else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, PIECE + (", ids array<long>" if with_ids else ""))


def best_fit(lengths: np.ndarray, cap: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece of one group.

    Among the bins with room in all three dimensions, "norm" takes the one whose
    weighted residual after placing is smallest, "dot" the one whose residual has the
    largest weighted product with the need; ties go to the older bin. Bins too full
    for the shortest piece are set aside.
    """
    full = np.array([cap.tokens, cap.documents, cap.attention], dtype=float)
    weights = np.array(cap.weights)
    order = np.argsort(-lengths, kind="stable")
    least = float(lengths.min()) if len(lengths) else 0.0
    need = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2], axis=1)
    room = np.empty((3, 1024))
    ids = np.empty(1024, dtype=np.int64)
    opened = count = 0
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    used: list[int] = []
    closed = 0
    for i in order:
        want = need[i]
        left = room[:, :opened]
        fits = np.flatnonzero((left[0] >= want[0]) & (left[1] >= want[1]) & (left[2] >= want[2]))
        if len(fits):
            cand = left[:, fits]
            if cap.rule == "dot":
                at = fits[np.argmax((weights * want / full**2) @ cand)]
            else:
                at = fits[np.argmin(weights @ ((cand - want[:, None]) / full[:, None]) ** 2)]
        else:
            if (want > full).any():
                raise ValueError("a piece needs more than an empty sequence holds")
            if opened == len(ids):
                ids, room = np.append(ids, np.empty_like(ids)), np.append(room, np.empty_like(room), axis=1)
            at, opened = opened, opened + 1
            ids[at], room[:, at] = count, full
            used.append(0)
            count += 1
        b = ids[at]
        bins[i], offsets[i] = b, used[b]
        used[b] += int(want[0])
        room[:, at] -= want
        if room[0, at] < least or room[1, at] < 1 or room[2, at] < least**2:
            room[0, at] = -1.0
            closed += 1
            if closed > 256 and 2 * closed > opened:
                stay = np.flatnonzero(room[0, :opened] >= 0)
                ids[: len(stay)], room[:, : len(stay)] = ids[stay], room[:, stay]
                opened, closed = len(stay), 0
    return bins, offsets


def pack(pieces: DataFrame, cap: Capacity = Capacity(), group_rows: int = 16_384) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (any columns with a ``length``).

    Row numbers are fixed by writing the narrow pieces once; groups are a hash of
    them, so neither a repeated id nor a common length makes a group large.
    """
    keep = pieces.columns
    rows = cut_lineage(pieces.withColumn("_row", F.monotonically_increasing_id()))
    alone = (F.col("length") == cap.tokens) & F.lit(cap.attention >= cap.tokens**2)
    whole = rows.filter(alone).select(*keep, (F.col("_row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    parts = rows.filter(~alone)
    groups = row_groups(parts.count(), group_rows)

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_row")
        bins, offsets = best_fit(group["length"].to_numpy(), cap)
        seq = (group["_group"].to_numpy().astype(np.int64) * 2**32 + bins) * 2
        return group[keep].assign(sequence_id=seq, offset=offsets)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema] + ["sequence_id long, offset long"])
    grouped = parts.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)).cast("int"))
    return whole.unionByName(grouped.groupBy("_group").applyInPandas(packed, schema))


def pack_documents(docs: DataFrame, cap: Capacity = Capacity(), path: str | None = None, group_rows: int = 16_384) -> DataFrame:
    return pack(tokenized(docs, cap.tokens, path), cap, group_rows)


def sequences(docs: DataFrame, cap: Capacity = Capacity(), path: str | None = None, group_rows: int = 16_384) -> DataFrame:
    """The sequences themselves: token ids in order, and where and which each document's
    pieces start. Ids go along with their pieces, so repeated and null document ids are
    no matter; one sequence has at most the capacity's tokens, so gathering is bounded."""
    packed = pack(tokenized(docs, cap.tokens, path, with_ids=True), cap, group_rows)
    gathered = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("_parts"))
    return gathered.select("sequence_id", F.flatten("_parts.ids").alias("ids"), F.col("_parts.offset").alias("starts"), F.col("_parts.doc_id").alias("doc_ids"))
