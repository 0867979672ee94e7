"""A Merkle manifest of a dataset, with octopus multiproofs.

Each row is a leaf, the SHA-256 of its fields. The leaves of a source, by ascending id,
are the bottom of a ternary tree; the tops of all sources, by name, are the bottom of
another, whose top is the root of the dataset.

How it runs:

* Leaves are hashed in one pass by built-in functions and written as narrow rows.
* Places: rows are range-partitioned by (source, id) and numbered within their
  partition; the counts per (source, partition) are added up to where each partition's
  part of a source begins. A source that fills many partitions is no larger a task.
* Tree: blocks of 3^7 neighbours climb seven levels in one task, so N leaves take
  log(N) / log(3^7) shuffles, each 1/3^7 of the one before. All nodes are kept.
* Proofs: a leaf partition (``chunk`` neighbouring places of one source) works out the
  smallest set of node coordinates that its leaves' proofs need and that it cannot
  derive, those sets are fetched by one join, and each partition derives the nodes that
  its leaves share once and expands the single proofs from them. The way from a source's
  top to the root is the same for all of its leaves; it is a proof of the upper tree.

Defined results: a null field is hashed as ``-``, unlike an empty one; null ids come
first and null sources are a source of their own, before all others; rows with one id
are ordered by their leaf, and rows equal in all fields are a leaf each; an empty table
has no rows and no root; a text of any length is one hash; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockledger.functions.stats import join_back
from dockledger.session import cut_lineage

ARITY = 3
STEP = 7  # levels climbed in one task
CHUNK = 4096  # leaves of one leaf partition
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def level_sizes(n: int) -> list[int]:
    """Nodes on each level of a tree over n leaves; the last is its top."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // ARITY))
    return sizes


def run_of(idx: int, size: int) -> range:
    """The places that share a parent with ``idx`` on a level of ``size`` nodes."""
    first = idx - idx % ARITY
    return range(first, min(first + ARITY, size))


# ---- leaves -----------------------------------------------------------------


def leaf(fields: dict[str, Column]) -> Column:
    """Each field as its UTF-8 byte count, a colon and its value."""
    texts = [c.cast("string") for c in fields.values()]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def numbered(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """Adds ``idx``, the place of a row in its tree from 0, and ``n``, the tree's rows."""
    ranged = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    placed = cut_lineage(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftrightunsigned("_at", 33)))
    parts = placed.groupBy(tree, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    own = Window.partitionBy(tree)
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.withColumns({"_shift": before - F.col("_first"), "n": F.sum("_n").over(own)}).drop("_n", "_first")
    return join_back(placed, starts, [tree, "_part"]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


# ---- tree -------------------------------------------------------------------

NODE = "tree string, n long, level int, idx long, digest string"
_NODE = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string())])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    return (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def climb(nodes: DataFrame, level: int) -> DataFrame:
    """The next ``STEP`` levels above the nodes of one level (``tree``, ``n``, ``idx``,
    ``digest``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, n, block), group in groupby(_rows(batches), key=lambda r: r[:3]):
            below = [r[4] for r in group]
            top = len(level_sizes(n)) - 1
            made = []
            for up in range(level + 1, min(level + STEP, top) + 1):
                below = [digest(*below[i : i + ARITY]) for i in range(0, len(below), ARITY)]
                first = block * ARITY ** (level + STEP - up)
                made += [(tree, n, up, first + i, d) for i, d in enumerate(below)]
            if made:
                yield _batch(made, _NODE)

    block = F.expr(f"idx div {ARITY**STEP}").alias("block")
    ordered = nodes.select("tree", "n", block, "idx", "digest").repartition("tree", "block").sortWithinPartitions("tree", "n", "block", "idx")
    return ordered.mapInArrow(run, NODE)


def grow(leaves: DataFrame) -> DataFrame:
    """All nodes over numbered leaves, these included."""
    current = leaves.select("tree", "n", F.lit(0).alias("level"), "idx", "digest")
    most = current.agg(F.max("n")).first()[0] or 0
    levels, at = [current], 0
    while ARITY**at < most:
        made = cut_lineage(climb(current, at))
        levels.append(made)
        at += STEP
        current = made.filter((F.col("level") == at) & (F.col("n") > ARITY**at))
    return reduce(DataFrame.unionByName, levels)


def tops(nodes: DataFrame) -> DataFrame:
    """``tree``, ``digest`` of each tree's top: the node on the first level whose span
    covers all leaves."""
    span = F.lit(3.0) ** F.col("level")
    return nodes.filter((F.col("idx") == 0) & (F.col("n") <= span) & ((F.col("level") == 0) | (F.col("n") > span / ARITY))).select("tree", "digest")


# ---- proofs -----------------------------------------------------------------


def missing(places: Sequence[int], n: int) -> list[tuple[int, int]]:
    """(level, idx) of the nodes that proofs of these leaves need and that neither are
    given nor can be derived: the smallest union for all of them."""
    out, known = [], sorted(set(places))
    for level, size in enumerate(level_sizes(n)[:-1]):
        have, parents = set(known), sorted({i // ARITY for i in known})
        out += [(level, s) for p in parents for s in run_of(p * ARITY, size) if s not in have]
        known = parents
    return out


class Chunk:
    """The nodes of one leaf partition: fetched ones and those derived from its leaves."""

    def __init__(self, leaves: dict[int, str], fetched: dict[tuple[int, int], str], n: int) -> None:
        self.sizes = level_sizes(n)
        self.levels = [leaves]
        for level, size in enumerate(self.sizes[:-1]):
            here = self.levels[level]
            parents = {i // ARITY for i in here}
            here.update({at: d for (lv, at), d in fetched.items() if lv == level})
            self.levels.append({p: digest(*(here[i] for i in run_of(p * ARITY, size))) for p in parents})
        self.steps: dict[tuple[int, int], list[tuple[str, str]]] = {}

    @property
    def top(self) -> str:
        return self.levels[-1][0]

    def path(self, idx: int, level: int = 0) -> list[tuple[str, str]]:
        """What stands before and after the node on each level up to the top."""
        if level == len(self.sizes) - 1:
            return []
        if (level, idx) not in self.steps:
            here, run = self.levels[level], run_of(idx, self.sizes[level])
            own = ("".join(here[i] for i in run if i < idx), "".join(here[i] for i in run if i > idx))
            rest = self.path(idx // ARITY, level + 1)
            if not level:
                return [own, *rest]  # leaves ask once
            self.steps[level, idx] = [own, *rest]
        return self.steps[level, idx]


def fold(value: str, path: Sequence[tuple[str, str]]) -> str:
    """The top that a leaf and its siblings lead to."""
    for before, after in path:
        value = digest(before, value, after)
    return value


def _encode(path: Sequence[tuple[str, str]]) -> str:
    return ";".join(f"{before},{after}" for before, after in path)


def _decode(path: str | None) -> list[tuple[str, str]]:
    return [tuple(step.split(",")) for step in path.split(";")] if path else []


PROOF = "key long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, proof string"
_PROOF = pa.schema([("key", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_()), ("proof", pa.string())])


def prove(wanted: DataFrame, nodes: DataFrame, above: DataFrame | None = None, with_proofs: bool = False) -> DataFrame:
    """Proofs of leaves. ``wanted`` holds ``tree``, ``n``, ``idx``, ``digest``, a ``key``
    that goes along and ``claimed``, the leaf to verify in place of the recorded one
    (null: that itself). ``above`` continues the way: ``tree``, ``root`` and ``path``.
    ``proof`` is filled ``with_proofs``: steps by ``;``, each with the digests before
    and, after a comma, those after the node."""
    chunked = wanted.withColumn("chunk", F.expr(f"idx div {CHUNK}"))
    coordinates = pa.schema([("tree", pa.string()), ("chunk", pa.int64()), ("level", pa.int32()), ("idx", pa.int64())])

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, chunk, n), group in groupby(_rows(batches), key=lambda r: r[:3]):
            found = [(tree, chunk, *at) for at in missing([r[3] for r in group], n)]
            if found:
                yield _batch(found, coordinates)

    places = chunked.select("tree", "chunk", "n", "idx").repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", "idx")
    needed = places.mapInArrow(needs, "tree string, chunk long, level int, idx long")
    fetched = join_back(needed, nodes.select("tree", "level", "idx", "digest"), ["tree", "level", "idx"], how="inner")
    heads = chunked.select("tree", "chunk").distinct()
    heads = heads.withColumns({"root": F.lit(None).cast("string"), "path": F.lit(None).cast("string")}) if above is None else join_back(heads, above.select("tree", "root", "path"), ["tree"])

    none = {c: F.lit(None) for c in ("n", "key", "claimed")}
    head_rows = heads.select("tree", "chunk", F.lit(0).alias("kind"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("idx"), F.col("root").alias("digest"), none["n"].cast("long").alias("n"), none["key"].cast("long").alias("key"), F.col("path").alias("claimed"))
    fetched_rows = fetched.select("tree", "chunk", F.lit(1).alias("kind"), "level", "idx", "digest", none["n"].cast("long").alias("n"), none["key"].cast("long").alias("key"), none["claimed"].cast("string").alias("claimed"))
    leaf_rows = chunked.select("tree", "chunk", F.lit(2).alias("kind"), F.lit(0).alias("level"), "idx", "digest", "n", "key", "claimed")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(_rows(batches), key=lambda r: r[:2]):
            head, nodes_here, own = None, {}, []
            for _, _, kind, level, idx, value, n, key, claimed in group:
                if kind == 0:
                    head = (value, _decode(claimed))
                elif kind == 1:
                    nodes_here[level, idx] = value
                else:
                    own.append((idx, value, n, key, claimed))
            chunk = Chunk({r[0]: r[1] for r in own}, nodes_here, own[0][2])
            known_root, rest = head
            root = known_root or fold(chunk.top, rest)
            out = []
            for idx, value, _, key, claimed in own:
                path = chunk.path(idx) + rest
                folded = fold(claimed or value, path)
                out.append((key, value, chunk.top, root, digest(*(s for step in path for s in step)), folded, folded == root, _encode(path) if with_proofs else None))
            yield _batch(out, _PROOF)

    rows = head_rows.unionByName(fetched_rows).unionByName(leaf_rows)
    ordered = rows.repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", "kind", "level", "idx")
    return ordered.mapInArrow(expand, PROOF)


# ---- manifest ---------------------------------------------------------------


@dataclass(frozen=True)
class Manifest:
    """``leaves``: numbered, with ``tree``, ``key`` and ``digest``. ``nodes``: all nodes
    of the sources' trees. ``above``: each source's ``subroot``, the ``root`` and the
    ``path`` between them."""

    leaves: DataFrame
    nodes: DataFrame
    above: DataFrame

    def prove(self, wanted: DataFrame | None = None, with_proofs: bool = False) -> DataFrame:
        """Proofs of all leaves, or of ``wanted`` rows of ``leaves``; a ``claimed``
        column is verified in place of the recorded digest."""
        rows = self.leaves if wanted is None else wanted
        claimed = F.col("claimed") if "claimed" in rows.columns else F.lit(None).cast("string")
        return prove(rows.select("tree", "n", "idx", "digest", "key", claimed.alias("claimed")), self.nodes, self.above, with_proofs)


def manifest(leaves: DataFrame) -> Manifest:
    """From ``tree``, ``key``, ``digest``; further columns stay on ``leaves``."""
    placed = cut_lineage(numbered(leaves, "tree", ["key", "digest"]))
    nodes = grow(placed)
    subroots = cut_lineage(tops(nodes))
    named = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    upper = cut_lineage(numbered(named, "tree", ["name"]).withColumns({"key": F.col("idx"), "claimed": F.lit(None).cast("string")}))
    paths = prove(upper, grow(upper), with_proofs=True).select("key", "root", F.col("leaf").alias("subroot"), F.col("proof").alias("path"))
    above = cut_lineage(upper.select("key", F.col("name").alias("tree")).join(paths, "key").drop("key"))
    return Manifest(placed, nodes, above)


def tampers(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of documents, with what is left of those whose line ends are deleted in
    ``claimed``."""
    fields = {c: F.col(c) for c in FIELDS}
    cut = fields | {"text": F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit(""))}
    return docs.select(F.col("source").cast("string").alias("tree"), F.col("doc_id").cast("long").alias("key"), leaf(fields).alias("digest"), F.when(tampers(F.col("doc_id")), leaf(cut)).alias("claimed"))


def audit(docs: DataFrame) -> DataFrame:
    """Every document's leaf and proof, verified after the tampering."""
    return manifest(cut_lineage(document_leaves(docs))).prove().drop("proof").withColumnRenamed("key", "doc_id")


_FIELD = "CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
_LEAF = " || ".join(_FIELD.format(c=c) for c in ("doc_id", "source", "lang", "n_chars"))
_CRC_STEP = "CASE WHEN xor(c, b) % 2 = 1 THEN xor(xor(c, b) >> 1, 3988292384) ELSE xor(c, b) >> 1 END"

SQL = f"""
WITH RECURSIVE ids AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, b: {_CRC_STEP}), 4294967295) % 2 = 0 AS tampers
  FROM (SELECT DISTINCT doc_id FROM documents)),
hashed AS (
  SELECT d.doc_id, d.source, sha256({_LEAF.replace('doc_id', 'd.doc_id').replace('source', 'd.source')} || {_FIELD.format(c='text')}) AS leaf,
    CASE WHEN i.tampers THEN sha256({_LEAF.replace('doc_id', 'd.doc_id').replace('source', 'd.source')} || {_FIELD.format(c="replace(text, chr(10), '')")}) END AS claimed
  FROM documents d LEFT JOIN ids i ON d.doc_id IS NOT DISTINCT FROM i.doc_id),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n,
    row_number() OVER () AS rid FROM hashed),
low AS (
  SELECT source, 0 AS level, n, idx, leaf AS digest FROM leaves
  UNION ALL
  SELECT source, level + 1, (n + 2) // 3, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM low WHERE n > 1 GROUP BY source, level, n, idx // 3),
subroots AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, n, idx, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, (n + 2) // 3, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY level, n, idx // 3),
steps AS (
  SELECT l.rid, 0 AS part, s.level, s.idx, s.digest, l.idx // CAST(pow(3, s.level) AS BIGINT) AS own
  FROM leaves l JOIN low s ON s.source IS NOT DISTINCT FROM l.source AND s.n > 1 AND s.idx // 3 = l.idx // CAST(pow(3, s.level + 1) AS BIGINT)
  UNION ALL
  SELECT l.rid, 1, s.level, s.idx, s.digest, r.idx // CAST(pow(3, s.level) AS BIGINT)
  FROM leaves l JOIN subroots r ON r.source IS NOT DISTINCT FROM l.source JOIN high s ON s.n > 1 AND s.idx // 3 = r.idx // CAST(pow(3, s.level + 1) AS BIGINT)),
proofs AS (SELECT rid, string_agg(digest, '' ORDER BY part, level, idx) FILTER (WHERE idx <> own) AS proof FROM steps GROUP BY rid),
ways AS (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY part, level) - 1 AS step,
    coalesce(string_agg(digest, '' ORDER BY idx) FILTER (WHERE idx < own), '') AS before, coalesce(string_agg(digest, '' ORDER BY idx) FILTER (WHERE idx > own), '') AS after
  FROM steps GROUP BY rid, part, level),
folded AS (
  SELECT rid, 0 AS step, coalesce(claimed, leaf) AS value FROM leaves
  UNION ALL
  SELECT f.rid, f.step + 1, sha256(w.before || f.value || w.after) FROM folded f JOIN ways w ON w.rid = f.rid AND w.step = f.step)
SELECT l.doc_id, l.leaf, r.subroot, h.digest AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.value AS folded_root, f.value = h.digest AS verified
FROM leaves l JOIN subroots r ON r.source IS NOT DISTINCT FROM l.source JOIN high h ON h.n = 1 LEFT JOIN proofs p ON p.rid = l.rid
JOIN (SELECT rid, arg_max(value, step) AS value FROM folded GROUP BY rid) f ON f.rid = l.rid
"""
