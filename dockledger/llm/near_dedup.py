"""Near-duplicates by fast similarity sketching, banding and exact verification.

Sets are the distinct word shingles of a whole text. A sketch of t coordinates fills
in rounds: round i throws every element into bin h_i(x) mod t with the value
(i, h_i(x)), so a bin holds the smallest value of the first round that reached it;
rounds t to 2t - 1 throw all elements into one fixed bin each, so every coordinate is
filled in the end. Coordinates of two sets agree with probability J each, and their
share is concentrated about J.

1. One pass computes set size, set signature and band hashes of every text. Texts with
   the same signature are one class (its members are exact copies as sets).
2. Classes that share a band meet its head, the one of them that shares most bands with
   others. Pairs are verified on the full sets, made anew from the texts. Verified links
   join classes.
3. The classes whose bands have the same head are a family, which holds every pair of
   one band. Classes of a family that are still apart are compared within tasks, block
   by block, on their whole sets; a class joined on the way is not compared again with
   its own kind, so a block gives fewer links than it has rows. These links are verified
   too. Jaccard distance is a metric, so a class that is x from the head needs no
   comparison with those nearer to it than x - 0.2. So heads save work but lose no link.
   A family beyond one block is first dealt out to the rarest shingles of its members,
   where that makes fewer copies of sets (see ``rarest_shared``), and then cut by set
   size: only classes whose sizes allow a link meet.
4. Components by alternating large-star and small-star steps over the links.

With 48 bands of 6 coordinates a pair at the threshold of 0.8 shares no band with
probability (1 - 0.8^6)^48 < 5e-7.

Nothing is collected but counts. A text goes to the check of a head in salted portions;
equal sets are pre-aggregated; joins on a hot band or head can be split.

Defined results: null, empty and white-space texts have no set, are linked with
nothing and are their own component; repeated rows are copies of each other; a null id
is nobody's smallest id, and such a row is not kept; an empty table gives no rows;
input columns other than id and text are ignored by ``components``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockledger.llm.common import mix, shingle_hashes, word_bytes, word_hashes
from dockledger.session import cut_lineage


@dataclass(frozen=True)
class Similarity:
    """``shingle`` words, linked if 100 * intersection >= ``percent`` * union."""

    shingle: int = 5
    percent: int = 80
    bands: int = 48
    rows: int = 6


def text_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(word_hashes(word_bytes(text)), size))


_SEEDS = mix(np.arange(1, 8193, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """The t coordinates of a set that is not empty."""
    n = len(elements)
    values = np.full(t, np.iinfo(np.uint64).max, dtype=np.uint64)
    at, chunk = 0, max(1, -(-3 * t // n))
    while at < 2 * t:
        rounds = np.arange(at, min(at + chunk, t if at < t else 2 * t))
        h = mix(elements[None, :] ^ _SEEDS[rounds][:, None])
        where = (h % np.uint64(t)).astype(np.int64) if at < t else np.broadcast_to((rounds - t)[:, None], h.shape)
        key = (rounds.astype(np.uint64)[:, None] << np.uint64(48)) | (mix(h) >> np.uint64(16))
        np.minimum.at(values, where.ravel(), key.ravel())
        if values.max() != np.iinfo(np.uint64).max:
            break
        at += len(rounds)
    return values


def band_hashes(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = mix(np.arange(1, bands + 1, dtype=np.uint64))
    for column in values.reshape(bands, rows).T:
        out = mix(out ^ column) * np.uint64(0x9E3779B97F4A7C15)
    return out


SETS = "doc_id long, tkey long, n_shingles long, sig binary, bands array<long>"


def sets(docs: DataFrame, how: Similarity) -> DataFrame:
    """One row per document: set size, signature and band hashes."""
    schema = pa.schema([("doc_id", pa.int64()), ("tkey", pa.int64()), ("n_shingles", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sigs, bands = [], [], []
            for text in batch.column(2):
                s = text_set(text.as_py(), how.shingle)
                sizes.append(len(s))
                sigs.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                values = sketch(s, how.bands * how.rows) if len(s) else None
                bands.append([] if values is None else band_hashes(values, how.bands, how.rows).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=schema
            )

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text), text).mapInArrow(run, SETS)


PORTION = 128
KEY_SLOTS = 1 << 20


def verify(pairs: DataFrame, texts: DataFrame, how: Similarity) -> DataFrame:
    """The pairs (``head``, ``node``) with their Jaccard distance and whether they reach
    the threshold.

    ``texts`` has ``node`` and ``text``. A head's text goes with portions of about
    ``PORTION`` partners, in front of them, so a task holds one head's set at a time.
    """
    heads = pairs.groupBy("head").agg(F.count("*").alias("_n"))
    salted = pairs.join(heads, "head").select("head", "node", F.pmod(F.xxhash64("node"), F.ceil(F.col("_n") / PORTION)).cast("int").alias("salt"))
    first = salted.select("head", "salt").distinct().join(texts.withColumnRenamed("node", "head"), "head")
    rows = first.select("head", "salt", F.lit(None).cast("long").alias("node"), "text").unionByName(salted.join(texts, "node").select("head", "salt", "node", "text"))
    schema = pa.schema([("head", pa.int64()), ("node", pa.int64()), ("distance", pa.float64()), ("linked", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        for batch in batches:
            found: tuple[list, ...] = ([], [], [], [])
            for head, node, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                s = text_set(text.as_py(), how.shingle)
                if node is None:
                    current = s
                    continue
                common = len(np.intersect1d(current, s, assume_unique=True))
                union = len(current) + len(s) - common
                for column, value in zip(found, (head, node, 1.0 - common / union, 100 * common >= how.percent * union), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(found, schema, strict=True)], schema=schema)

    ordered = rows.repartition("head", "salt").sortWithinPartitions("head", "salt", F.col("node").asc_nulls_first())
    return ordered.mapInArrow(run, "head long, node long, distance double, linked boolean")


# Rows and hashes of a block; a task holds two of them.
BLOCK = 1024
BLOCK_HASHES = 1 << 20


def spanning_links(rows: list[tuple], percent: int) -> tuple[list[int], list[int]]:
    """Links between the rows (side, node, root, n, set of 32-bit hashes) of one pair of
    blocks, or of one block with itself, that join different components.

    Hashes of 32 bits may miscount by as many as collide among those of both sets, so a
    link joins its components here only if it holds with that many more and less; the
    others are reported as well."""
    left = [i for i, r in enumerate(rows) if r[0] == 0]
    right = [i for i, r in enumerate(rows) if r[0] == 1]
    same = not right
    right = np.array(right or left)
    sets = [np.frombuffer(r[4], dtype="<u4") for r in rows]
    vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    own = [ids[starts[i] : starts[i + 1]] for i in range(len(rows))]
    others = np.concatenate([own[i] for i in right])
    cut = np.concatenate([[0], np.cumsum([len(own[i]) for i in right])[:-1]])
    n = np.array([r[3] for r in rows], dtype=np.int64)
    label = np.array([r[2] for r in rows], dtype=np.int64)
    mark = np.zeros(len(vocabulary), dtype=bool)
    found: tuple[list[int], list[int]] = ([], [])
    for k, i in enumerate(left):
        sized = 100 * np.minimum(n[i], n[right]) >= percent * np.maximum(n[i], n[right])
        open_ = sized & (label[right] != label[i])
        if same:
            open_[: k + 1] = False
        if not open_.any():
            continue
        mark[own[i]] = True
        common = np.add.reduceat(mark[others].astype(np.int32), cut)
        mark[own[i]] = False
        total = n[i] + n[right]
        expected = total.astype(np.float64) ** 2 / 2**33
        slack = 1 + np.floor(expected + 6 * np.sqrt(expected)).astype(np.int64)
        near = open_ & (100 * (common + slack) >= percent * (total - common - slack))
        sure = 100 * (common - slack) >= percent * (total - common + slack)
        for j in np.flatnonzero(near):
            other = right[j]
            if label[other] == label[i]:
                continue
            found[0].append(rows[i][1])
            found[1].append(rows[other][1])
            if sure[j]:
                label[label == label[other]] = label[i]
    return found


def _blocks_of(count: Column, hashes: Column) -> Column:
    return F.ceil(F.greatest(count / BLOCK, hashes / BLOCK_HASHES)).cast("int")


def rarest_shared(members: DataFrame, texts: DataFrame, how: Similarity) -> DataFrame:
    """``fam``, ``head``, ``node``, ``root``, ``n``: the members of each family dealt out
    to their rarest shingles, a sub-family each.

    Two sets of n and m elements can be linked only if they share ``percent`` % of n and
    of m, hence one of the n - ceil(n * percent / 100) + 1 elements that come first in any
    common order. The order is by how many members of the family have an element; those
    that only one has count, but lead to nobody. So texts whose own parts exceed the
    share drop out here, however much of a template they have in common."""
    schema = pa.schema([("head", pa.int64()), ("node", pa.int64()), ("root", pa.int64()), ("n", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_set(t.as_py(), how.shingle).view(np.int64) for t in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, schema.field("shingles").type)], schema=schema)

    whole = members.join(texts, "node").select("head", "node", "root", "n", "text").mapInArrow(run, "head long, node long, root long, n long, shingles array<long>")
    each = cut_lineage(whole).withColumn("shingle", F.explode("shingles")).drop("shingles")
    common = each.groupBy("head", "shingle").agg(F.count("*").alias("c")).filter("c > 1")
    own = Window.partitionBy("head", "node")  # the shingles of one text
    place = F.row_number().over(own.orderBy("c", "shingle")) + F.col("n") - F.count("*").over(own)
    first = F.col("n") - F.ceil(F.col("n") * how.percent / F.lit(100)) + 1
    placed = each.join(common, ["head", "shingle"]).withColumn("_place", place).filter(F.col("_place") <= first)
    return placed.select(F.xxhash64("head", "shingle").alias("fam"), "head", "node", "root", "n")


def to_compare(members: DataFrame, texts: DataFrame, how: Similarity) -> DataFrame:
    """Families (``fam``) within which all pairs are to be compared: ``members`` as they
    are, or, where that makes fewer copies of sets, the sub-families of a large one."""
    apart = [F.count("*").alias("_c"), F.sum("n").alias("_s"), F.min("root").alias("_a"), F.max("root").alias("_b")]
    sizes = cut_lineage(members.groupBy("head").agg(*apart).filter("_a <> _b").withColumn("_k", _blocks_of(F.col("_c"), F.col("_s"))))
    whole = members.select(F.col("head").alias("fam"), "head", "node", "root", "n")
    if sizes.filter("_k > 1").isEmpty():
        return whole.join(sizes.select("head"), "head", "leftsemi").drop("head")
    large = members.join(sizes.filter("_k > 1").select("head"), "head", "leftsemi")
    parts = cut_lineage(rarest_shared(large, texts, how))
    kept = parts.groupBy("fam").agg(F.min("head").alias("head"), *apart).filter("_a <> _b").withColumn("_copies", F.col("_c") * _blocks_of(F.col("_c"), F.col("_s")))
    kept = cut_lineage(kept.select("fam", "head", "_copies"))
    cost = kept.groupBy("head").agg(F.sum("_copies").alias("_parts"))
    judged = sizes.join(cost, "head", "left").withColumn("_split", (F.col("_k") > 1) & (F.coalesce("_parts", F.lit(0)) < F.col("_c") * F.col("_k")))
    judged = cut_lineage(judged.select("head", "_split"))
    split = parts.join(judged.filter("_split").select("head"), "head", "leftsemi").join(kept.select("fam"), "fam", "leftsemi")
    return whole.join(judged.filter("NOT _split").select("head"), "head", "leftsemi").unionByName(split).drop("head").distinct()


def block_sides(families: DataFrame, how: Similarity) -> DataFrame:
    """``fam``, ``g``, ``step``, ``i``, ``j``, ``side``, ``node``, ``root``, ``n``: each member
    once for each pair of blocks that it takes part in.

    A family that exceeds a block, in rows or in hashes, is cut by set size first: a class
    of sizes spans the ratio that a link allows, so members meet their own class and the
    next (``step``), and classes are cut into blocks."""
    bound = _blocks_of(F.count("*"), F.sum("n"))
    ratio = float(np.log(100 / how.percent * (1 + 1e-9)))
    level = F.when(F.col("_k") > 1, F.floor(F.log(F.col("n").cast("double")) / ratio)).otherwise(0).cast("long")
    rows = families.join(families.groupBy("fam").agg(bound.alias("_k")), "fam").withColumn("g", level)
    rows = cut_lineage(rows.drop("_k"))
    blocks = rows.groupBy("fam", "g").agg(bound.alias("k"))
    above = blocks.select("fam", (F.col("g") - 1).alias("g"), F.col("k").alias("up"))
    below = blocks.select("fam", (F.col("g") + 1).alias("g"), F.col("k").alias("down"))
    around = blocks.join(above, ["fam", "g"], "left").join(below, ["fam", "g"], "left")
    placed = rows.join(around, ["fam", "g"]).withColumn("_own", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    own = "transform(sequence(0, k - 1), o -> struct(g, 0 AS step, least(_own, o) AS i, greatest(_own, o) AS j, if(_own <= o, 0, 1) AS side))"
    up = "transform(sequence(0, up - 1), o -> struct(g, 1 AS step, _own AS i, o AS j, 0 AS side))"
    down = "transform(sequence(0, down - 1), o -> struct(g - 1 AS g, 1 AS step, o AS i, _own AS j, 1 AS side))"
    none = f"filter({own}, x -> false)"
    return placed.selectExpr("fam", "node", "root", "n", f"inline(concat({own}, coalesce({up}, {none}), coalesce({down}, {none})))")


def alike(members: DataFrame, texts: DataFrame, how: Similarity) -> DataFrame:
    """Pairs (``head``, ``node``) of one family that are likely to be linked and join
    different components. ``members``: ``head``, ``node``, ``root``, ``n``.

    Each pair of blocks is compared by itself. Rows come sorted, so a task holds one pair
    of blocks."""
    sides = cut_lineage(block_sides(to_compare(members, texts, how), how))
    kept = pa.schema([("node", pa.int64()), ("set", pa.binary())])

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique((text_set(t.as_py(), how.shingle) >> np.uint64(32)).astype("<u4")).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], schema=kept)

    hashed = texts.join(sides.select("node"), "node", "leftsemi").select("node", "text").mapInArrow(with_sets, "node long, set binary")
    key = ["fam", "g", "step", "i", "j"]
    rows = sides.join(cut_lineage(hashed), "node").select(*key, "side", "node", "root", "n", "set")
    schema = pa.schema([("head", pa.int64()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for (_, _, step, i, j), group in groupby(each, key=lambda r: r[:5]):
            pair = [r[5:] for r in group]
            if (step or i != j) and not (pair[0][0] == 0 and pair[-1][0] == 1):
                continue
            found = spanning_links(pair, how.percent)
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], schema=schema)

    ordered = rows.repartition(*key).sortWithinPartitions(*key, "side", "node")
    return ordered.mapInArrow(run, "head long, node long").distinct()


def connected(links: DataFrame) -> DataFrame:
    """``a``, ``b`` -> each linked node with the smallest node of its component
    (``node``, ``root``; roots themselves are not listed)."""

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both if large else both.filter("b < a")
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        met = near.join(least, "a")
        out = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else met.select("b", "m").unionByName(least.select(F.col("a").alias("b"), "m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.filter("a <> b").distinct()

    edges = cut_lineage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        edges = cut_lineage(star(star(edges, True), False))
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def _labelled(classes: DataFrame, roots: DataFrame) -> DataFrame:
    return classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def components(docs: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """``doc_id``, ``tkey`` (hash of the text), ``n_shingles``, ``node`` (the class),
    ``root`` (its component), ``component_id`` (the smallest id in it), ``kept``."""
    rows = cut_lineage(sets(docs, how).withColumn("_row", F.monotonically_increasing_id()))
    full = rows.filter("n_shingles > 0")
    classes = cut_lineage(full.groupBy("sig").agg(F.min("_row").alias("node"), F.min("doc_id").alias("least_id"), F.max("n_shingles").alias("n")))

    # Bands that more than one class has, dealt out once for the counts and the join.
    reps = full.join(classes.select(F.col("node").alias("_row")), "_row", "leftsemi")
    spread = reps.select(F.explode("bands").alias("band"), F.col("_row").alias("node")).repartition("band")
    shared = spread.groupBy("band").agg(F.count("*").alias("c")).filter("c > 1")
    buckets = cut_lineage(spread.join(shared, "band"))
    weight = buckets.groupBy("node").agg(F.sum("c").alias("w"))
    weighed = cut_lineage(buckets.select("band", "node").join(weight, "node"))
    heads = weighed.join(weighed.groupBy("band").agg(F.max("w").alias("w")), ["band", "w"]).groupBy("band").agg(F.min("node").alias("head"))
    family = cut_lineage(weighed.select("band", "node").join(heads, "band").select("head", "node").distinct())

    # Texts of classes in no family stay where they are: a table of at most KEY_SLOTS
    # slots of text hashes, broadcast, sorts out most of them before the join.
    named = cut_lineage(reps.select(F.col("_row").alias("node"), "tkey").join(weight.select("node"), "node", "leftsemi"))
    slot = F.pmod(F.col("tkey"), F.lit(KEY_SLOTS)).cast("int").alias("slot")
    found = docs.select(F.col("text").cast("string").alias("text")).withColumn("tkey", F.xxhash64("text"))
    found = found.withColumn("slot", slot).join(F.broadcast(named.select(slot).distinct()), "slot", "leftsemi").drop("slot")
    texts = cut_lineage(named.join(found.join(named.select("tkey"), "tkey", "leftsemi").dropDuplicates(["tkey"]), "tkey").select("node", "text"))

    size_of = classes.select("node", "n")
    head_size = size_of.withColumnsRenamed({"node": "head", "n": "head_n"})
    with_sizes = family.join(size_of, "node").join(head_size, "head")
    possible = F.least("n", "head_n") * 100 >= F.greatest("n", "head_n") * how.percent
    first = cut_lineage(verify(with_sizes.filter(possible & (F.col("head") != F.col("node"))).select("head", "node"), texts, how))

    def links_of(checked: DataFrame) -> DataFrame:
        return checked.filter("linked").select(F.col("head").alias("a"), F.col("node").alias("b"))

    roots = connected(links_of(first))

    # Who may still be linked with whom: a pair whose sizes exclude a link with the head
    # is at least that far from it.
    at_least = F.coalesce("distance", 1 - F.least("n", "head_n") / F.greatest("n", "head_n"))
    placed = _labelled(with_sizes.filter("head <> node"), roots).join(first.select("head", "node", "distance"), ["head", "node"], "left").withColumn("at_least", at_least)
    root_of_head = _labelled(family.select(F.col("head").alias("node")).distinct(), roots).select(F.col("node").alias("head"), F.col("root").alias("head_root"))
    placed = cut_lineage(placed.join(root_of_head, "head").select("head", "node", "root", "n", "distance", "at_least", (F.col("root") != F.col("head_root")).alias("apart")))
    nearest = placed.filter("apart").groupBy("head").agg(F.min("at_least").alias("least"))
    reach = F.col("least") - (1 - how.percent / 100) - 1e-9
    members = placed.join(nearest, "head").filter(F.col("apart") | F.coalesce(F.col("distance") >= reach, F.lit(True)))
    rest = cut_lineage(alike(members.select("head", "node", "root", "n"), texts, how))
    last = cut_lineage(verify(rest, texts, how))
    roots = connected(links_of(first).unionByName(links_of(last)))

    labelled = cut_lineage(_labelled(classes, roots))
    least = labelled.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_class = labelled.join(least, "root").select("sig", "node", "root", "component_id")
    linked = full.select("doc_id", "tkey", "n_shingles", "sig", "_row").join(of_class, "sig").drop("sig")
    alone = rows.filter("n_shingles = 0").select("doc_id", "tkey", "n_shingles", "_row", F.col("_row").alias("node"), F.col("_row").alias("root"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_documents(docs: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """The rows of documents without near-duplicates, as they are: of each component one
    row, with its smallest id. Texts without a set stay, rows repeated in id and text
    count once. Here a null id stands for itself, so no component is lost."""
    found = cut_lineage(components(docs, how).select("doc_id", "tkey", "root", "component_id"))
    key = F.struct("doc_id", "tkey").alias("key")
    best = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(key).alias("best"))
    keys = found.select(key, "root").groupBy("root", "key").agg(F.count("*").alias("_n")).join(best, "root")
    judged = cut_lineage(keys.groupBy("key").agg(F.max(F.col("key").eqNullSafe(F.col("best"))).alias("stays"), F.sum("_n").alias("n")))
    row = docs.select(F.struct("*").alias("_row"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tkey")).alias("key"))
    gone = judged.filter("NOT stays").select("key")
    repeated = judged.filter("stays AND n > 1").select("key")
    stay = row.join(gone.unionByName(repeated), "key", "leftanti").select("_row.*")
    once = row.join(repeated, "key", "leftsemi").dropDuplicates(["key"]).select("_row.*")
    return stay.unionByName(once)
