"""Near-duplicates by SimHash fingerprints and multi-index hashing.

A text's fingerprint has a bit for each bit of the 64-bit hashes of its word shingles
(repeats included): 1 if more than half of the hashes have it set.

1. One pass computes the fingerprints, written once with the ids. Equal fingerprints
   are one class, combined before the shuffle.
2. A fingerprint is cut into ``segments`` parts, each with a table of the fingerprints
   that hold a given value there. If two differ in at most ``distance`` bits, they
   differ in at most distance // segments bits of one of the first parts, or in fewer of
   one of the others. So each fingerprint looks up a small Hamming ball around each of
   its parts, and whom it meets is verified on the whole fingerprint. Of two equally
   near values the smaller one looks up the larger, so a pair meets once in a part.
3. A table entry with more than ``dense`` fingerprints is not expanded. Whoever looks it
   up goes, with its own 64 bits, to all centres in a ball of half the distance; of
   those that share a centre, all are linked to the smallest. Every link so made is
   within ``distance``, and two fingerprints within it share a centre, so no link
   between components is lost, and work stays linear in the size of such a group.
4. Components by alternating star steps over the links.

Defined results: null, empty and white-space texts have fingerprint zero and are linked
like any other; texts with fewer words than a shingle count as one shingle; repeated rows
and equal texts share a component; a null id is nobody's smallest id (a component of
null ids alone has a null ``component_id``); an empty table gives no rows; columns other
than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockledger.llm.near_dedup import connected
from dockledger.session import cut_lineage

BITS = 64
SEED = 42
SLICE = 1 << 16  # hashes counted at a time


@dataclass(frozen=True)
class Fingerprints:
    """Shingles of ``shingle`` words, linked at ``distance`` or fewer differing bits."""

    shingle: int = 3
    distance: int = 2
    segments: int = 2
    dense: int = 64

    def __post_init__(self) -> None:
        if not 0 <= self.distance < BITS or BITS % self.segments or self.segments < 2:
            raise ValueError("distance must be below 64, segments at least 2 and a divisor of 64")

    @property
    def width(self) -> int:
        return BITS // self.segments

    def radii(self) -> list[int]:
        """Radius of the ball to search around each segment; -1 for none."""
        each, more = divmod(self.distance, self.segments)
        return [each if i <= more else each - 1 for i in range(self.segments)]


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Unsigned fingerprint of a UTF-8 text; 0 for one without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    found = map(b" ".join, zip(*(words[i:] for i in range(size))))
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, found, repeat(SEED))), dtype=np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), SLICE):
        ones += np.unpackbits(hashes[at : at + SLICE], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint as a signed number) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return given.mapInArrow(run, "doc_id long, fp long")


def masks(width: int, radius: int) -> list[int]:
    """What to flip to reach every value of a Hamming ball, as signed 64-bit numbers."""
    found = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in found]


def _ball(centre: Column, width: int, radius: int) -> Column:
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks(width, radius)]), lambda m: centre.bitwiseXOR(m))


def _segment(fp: Column, i: int, how: Fingerprints) -> Column:
    return F.shiftrightunsigned(fp, i * how.width).bitwiseAND(F.lit((1 << how.width) - 1))


def _probes(fp: Column, i: int, radius: int, how: Fingerprints) -> Column:
    own = _segment(fp, i, how)
    return F.transform(_ball(own, how.width, radius), lambda k: F.struct(F.lit(i).alias("segment"), k.alias("key"), (k >= own).alias("up")))


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def segment_links(found: DataFrame, how: Fingerprints) -> DataFrame:
    """``a``, ``b`` for fingerprints ``fp`` that meet in a segment's table and are
    near on all bits; ``b`` is null once or more where ``a`` looks up a dense entry.

    Spark takes an exploded table to be as small as what it was made of, and would collect
    and broadcast it; the joins are therefore merge joins by name."""
    fp = F.col("fp")
    searched = [(i, r) for i, r in enumerate(how.radii()) if r >= 0]
    entries = found.select(F.explode(F.array(*[F.struct(F.lit(i).alias("segment"), _segment(fp, i, how).alias("key")) for i, _ in searched])).alias("e"), fp.alias("b")).select("e.*", "b")
    sizes = entries.groupBy("segment", "key").agg(F.count("*").alias("n"))
    listed = entries.hint("merge").join(sizes.filter(F.col("n") <= how.dense).drop("n"), ["segment", "key"])
    dense = sizes.filter(F.col("n") > how.dense).select("segment", "key", F.lit(None).cast("long").alias("b"))
    # a dense entry is met from both sides, as its whole neighbourhood changes its way
    probes = found.select(F.explode(F.concat(*[_probes(fp, i, r, how) for i, r in searched])).alias("p"), fp.alias("a")).select("p.*", "a")
    met = probes.hint("merge").join(listed.unionByName(dense), ["segment", "key"])
    near = F.col("b").isNull() | (F.col("up") & (F.col("a") != F.col("b")) & (_apart("a", "b") <= how.distance))
    return met.filter(near).select("a", "b")


def centre_links(found: DataFrame, how: Fingerprints) -> DataFrame:
    """``a``, ``b`` so that the fingerprints of ``found`` within the distance of each
    other are connected, in work linear in their number."""
    inner = how.distance // 2
    outer = how.distance - inner

    def spread(radius: int) -> DataFrame:
        return found.select(F.explode(_ball(F.col("fp"), BITS, radius)).alias("centre"), F.col("fp").alias("a"))

    rows = spread(outer).repartition("centre")
    least = (rows if inner == outer else spread(inner)).groupBy("centre").agg(F.min("a").alias("b"))
    return rows.hint("merge").join(least, "centre").filter((F.col("a") != F.col("b")) & (_apart("a", "b") <= how.distance)).select("a", "b").distinct()


def components(docs: DataFrame, how: Fingerprints = Fingerprints()) -> DataFrame:
    """``doc_id``, ``fp``, ``fingerprint`` (16 hex digits), ``component_id``."""
    rows = cut_lineage(fingerprints(docs, how.shingle))
    classes = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    met = cut_lineage(segment_links(classes.select("fp"), how))
    dense = cut_lineage(met.filter("b IS NULL").select(F.col("a").alias("fp")).distinct())
    links = met.filter("b IS NOT NULL").unionByName(centre_links(dense, how))
    roots = connected(links).withColumnRenamed("node", "fp")
    labelled = cut_lineage(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = labelled.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_class = labelled.join(least, "root").select("fp", "component_id")
    return rows.join(of_class, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
