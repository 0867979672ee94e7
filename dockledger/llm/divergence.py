"""How far the sources of a language differ in their words: a divergence audit over an
inverted index built by single-pass in-memory indexing.

1. Index: a task reads texts once and keeps block postings in memory, for each (language,
   source) the occurrences and documents of each term. When the block is full it is
   spilled as term-sorted runs, one for each group, and a new block begins.
2. Merge: runs go to hash shards of (language, term). Within a shard they are merged in
   term order; Spark's external sort does that with a heap over its sorted spills, so
   a shard needs no memory for its runs. One streaming pass adds equal neighbours and
   gives frequencies and, after each term, its totals. A term that every text has is one
   row of each run, not one of each text.
3. Terms that enough documents of their language have are kept. Shares are integers of
   a thousand million, smoothed, with exact floors.
4. Pairs: the divergence of two sources over all kept terms is that of two empty
   sources, the number of terms times the difference of their least shares, plus a
   correction for each term that at least one of them has. Postings stream past a matrix
   of corrections for each pair of source blocks and shard of terms; the matrices of the
   shards are added up. Work is postings times sources, memory one block pair.

Defined results: null text, language and source read as empty; a group without terms has
the least share of every kept term; a language without kept terms has pairs of value 0;
repeated rows count each; ties are ordered by the item's bytes; an empty table gives no
rows; terms and texts of any length count whole; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockledger.llm.common import row_groups
from dockledger.session import cut_lineage

# What is no part of a term: ASCII but for letters. A-Z are lower-cased.
_SPACED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).lower()
SCALE = 1_000_000_000
SMOOTHING = 5


@dataclass(frozen=True)
class Audit:
    """``min_docs`` documents of a language keep a term; ``top`` terms are reported;
    a block is full at ``block_postings`` postings or ``block_bytes`` of terms; pairs are
    taken in blocks of ``sources`` sources and shards of about ``shard_postings``."""

    min_docs: int = 30
    top: int = 50
    block_postings: int = 600_000
    block_bytes: int = 64 << 20
    sources: int = 256
    shard_postings: int = 200_000


def terms(text: bytes) -> list[bytes]:
    return text.translate(_SPACED).split()


# ---- index ------------------------------------------------------------------

POSTING = "lang string, source string, term binary, n long, docs long"
_POSTING = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])
_MERGED = pa.schema([_POSTING.field(c) for c in ("lang", "term", "source", "n", "docs")])
EMIT = 65_536


class Block:
    """Postings in memory. The empty term counts the documents of a group."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        self.postings = self.bytes = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        found = terms(text)
        counts, docs = self.groups.setdefault((lang, source), (Counter(), Counter()))
        distinct = set(found)
        distinct.add(b"")
        new = [term for term in distinct if term not in docs]
        self.postings += len(new)
        self.bytes += sum(map(len, new))
        counts.update(found)
        docs.update(distinct)

    def runs(self) -> Iterator[pa.RecordBatch]:
        """The block as one run for each group, sorted by term."""
        for (lang, source), (counts, docs) in self.groups.items():
            order = sorted(docs)
            for at in range(0, len(order), EMIT):
                part = order[at : at + EMIT]
                sums = [pa.array(list(map(c.__getitem__, part)), pa.int64()) for c in (counts, docs)]
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(part)), pa.repeat(pa.scalar(source, pa.string()), len(part)), pa.array(part, pa.binary()), *sums], schema=_POSTING)


def runs(docs: DataFrame, how: Audit) -> DataFrame:
    """Term-sorted runs of postings, one after another in each task."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                block.add(lang, source, text.as_py())
                if block.postings >= how.block_postings or block.bytes >= how.block_bytes:
                    yield from block.runs()
                    block = Block()
        yield from block.runs()

    def plain(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)

    return docs.select(plain("lang"), plain("source"), plain("text")).withColumn("text", F.col("text").cast("binary")).mapInArrow(index, POSTING)


def _changes(batch: pa.RecordBatch, columns: int) -> np.ndarray:
    """Whether each row but the first differs from the one before in leading columns."""
    out = np.zeros(max(0, batch.num_rows - 1), dtype=bool)
    for c in batch.columns[:columns]:
        out |= pc.not_equal(c.slice(1), c.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False).astype(bool)
    return out


def merged(found: DataFrame) -> DataFrame:
    """Frequencies of (language, term, source), and after each term a row without a
    source that holds its totals over the sources."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the posting that may go on in the next batch
        total = np.zeros(2, dtype=np.int64)  # what came before it of its term
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch if held is None else pa.concat_batches([held, batch])
            starts = np.concatenate([[0], np.flatnonzero(_changes(batch, 3)) + 1])
            sums = [np.add.reduceat(batch.column(c).to_numpy(), starts) for c in (3, 4)]
            added = pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(starts)) for c in range(3)], *map(pa.array, sums)], schema=_MERGED)
            done, held = added.slice(0, len(starts) - 1), added.slice(len(starts) - 1)
            yield done
            running = np.stack([np.concatenate([[0], np.cumsum(s[:-1])]) for s in sums])
            ends = np.flatnonzero(_changes(added, 2)) + 1
            if len(ends):
                sums = np.diff(running[:, np.concatenate([[0], ends])])
                sums[:, 0] += total
                yield _totals(added, ends - 1, sums)
                total = running[:, -1] - running[:, ends[-1]]
            else:
                total = total + running[:, -1]
        if held is not None:
            yield held
            yield _totals(held, np.array([0]), total[:, None] + np.array([[held.column(c)[0].as_py()] for c in (3, 4)]))

    ordered = found.select("lang", "term", "source", "n", "docs").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return ordered.mapInArrow(add, "lang string, term binary, source string, n long, docs long").withColumn("term", F.col("term").cast("string"))


def _totals(postings: pa.RecordBatch, at: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    lang, term = (postings.column(c).take(pa.array(at)) for c in range(2))
    return pa.RecordBatch.from_arrays([lang, term, pa.nulls(len(at), pa.string()), *map(pa.array, sums)], schema=_MERGED)


def share(n: str, total: str, kept: str) -> Column:
    """Smoothed share of a term in thousand-millionths: exact division of whole numbers."""
    whole = f"(CAST({n} AS DECIMAL(20,0)) + {SMOOTHING}) * CAST({SCALE} AS DECIMAL(10,0))"
    return F.expr(f"1 + CAST(({whole}) div (CAST({total} AS DECIMAL(20,0)) + {SMOOTHING} * CAST({kept} AS DECIMAL(18,0))) AS BIGINT)")


# ---- audit ------------------------------------------------------------------


@dataclass(frozen=True)
class Index:
    """``groups``: ``lang``, ``source``, its place ``at`` in the language, ``total`` of
    kept occurrences, ``kept`` terms of the language, ``lang_total``. ``postings``:
    ``lang``, ``source``, ``term``, ``n``, ``lang_n`` of kept terms."""

    groups: DataFrame
    postings: DataFrame


def index(docs: DataFrame, how: Audit = Audit()) -> Index:
    freq = cut_lineage(merged(runs(docs, how)))
    kept = cut_lineage(freq.filter(F.col("source").isNull() & (F.col("term") != "") & (F.col("docs") >= how.min_docs)).select("lang", "term", F.col("n").alias("lang_n")))
    postings = cut_lineage(freq.filter(F.col("source").isNotNull()).select("lang", "source", "term", "n").join(kept, ["lang", "term"]))
    of_group = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    seen = freq.filter(F.col("source").isNotNull() & (F.col("term") == "")).select("lang", "source")
    groups = seen.join(of_group, ["lang", "source"], "left").join(of_lang, ["lang"], "left").na.fill(0, ["total", "kept", "lang_total"])
    return Index(cut_lineage(groups.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)), postings)


def term_excess(ix: Index, top: int) -> DataFrame:
    """The terms that a group uses more than its language, by how much."""
    totals = ix.groups.select("lang", "source", "total", "kept", "lang_total")
    shares = ix.postings.join(totals, ["lang", "source"]).select("lang", "source", "term", (share("n", "total", "kept") - share("lang_n", "lang_total", "kept")).alias("value"))
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    return shares.filter("value > 0").withColumn("rank", ranked).filter(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


PAIR = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


class Corrections:
    """What the postings of one pair of source blocks change against empty sources."""

    def __init__(self, least: dict[int, int], left: list[int], right: list[int]) -> None:
        self.left, self.right = ({at: i for i, at in enumerate(side)} for side in (left, right))
        self.low = [np.array([least[at] for at in side], dtype=np.int64) for side in (left, right)]
        self.base = np.abs(self.low[0][:, None] - self.low[1][None, :])
        self.sum = np.zeros_like(self.base)

    def add(self, rows: list[tuple]) -> None:
        """Whole terms: (term, place of the source, share)."""
        number: dict[str, int] = {}
        for term, _, _ in rows:
            number.setdefault(term, len(number))
        sides = []
        for places in (self.left, self.right):
            own = [(number[t], places[at], p) for t, at, p in rows if at in places]
            sides.append(np.array(own, dtype=np.int64).reshape(-1, 3).T)
        (lt, li, lp), (rt, ri, rp) = sides
        right = np.tile(self.low[1], (len(number), 1))
        right[rt, ri] = rp
        has_left = np.zeros((len(number), len(self.low[0])), dtype=bool)
        has_left[lt, li] = True
        np.add.at(self.sum, li, np.abs(lp[:, None] - right[lt]) - self.base[li])
        alone = np.abs(self.low[0][None, :] - rp[:, None]) - self.base.T[ri]
        np.add.at(self.sum.T, ri, np.where(has_left[rt], 0, alone))


def pair_divergence(ix: Index, how: Audit) -> DataFrame:
    """``lang``, ``source``, ``item`` (another source of the language), ``value``."""
    shards = row_groups(ix.postings.count(), how.shard_postings)
    block = F.expr(f"at div {how.sources}").cast("int")
    blocks = ix.groups.groupBy("lang").agg((F.max(block) + 1).alias("blocks"))
    least = share("0", "total", "kept")
    placed = ix.groups.join(blocks, "lang").select("lang", "source", "at", "total", "kept", F.when(F.col("kept") > 0, least).otherwise(0).alias("least"), block.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = placed.select("*", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    heads = placed.select("lang", "i", "j", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(None).cast("string").alias("term"), "at", "source", F.col("least").alias("p"), "kept")
    met = ix.postings.join(placed, ["lang", "source"])
    postings = met.select("lang", "i", "j", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard"), "term", "at", F.lit(None).cast("string").alias("source"), share("n", "total", "kept").alias("p"), "kept")
    ordered = heads.unionByName(postings).repartition("lang", "i", "j", "shard").sortWithinPartitions("lang", "i", "j", "shard", F.col("term").asc_nulls_first(), "at")

    def correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for (lang, i, j, shard), group in groupby(each, key=lambda r: r[:4]):
            names, low, kept = {}, {}, 0
            matrix, waiting = None, []
            for term, rows in groupby(group, key=lambda r: r[4]):
                if term is None:
                    for r in rows:
                        names[r[5]], low[r[5]], kept = r[6], r[7], r[8]
                    left, right = ([at for at in sorted(low) if at // how.sources == b] for b in (i, j))
                    matrix = Corrections(low, left, right)
                    continue
                waiting += [(term, r[5], r[7]) for r in rows]
                if len(waiting) >= 4096:
                    matrix.add(waiting)
                    waiting = []
            if waiting:
                matrix.add(waiting)
            values = matrix.sum + (kept * matrix.base if shard == 0 else 0)
            for a, at in enumerate(left):
                others = [(b, to) for b, to in enumerate(right) if to != at]
                out = [(lang, names[at], names[to], int(values[a, b])) for b, to in others]
                out += [(lang, names[to], names[at], int(values[a, b])) for b, to in others] if i != j else []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PAIR, strict=True)], schema=PAIR)

    parts = ordered.mapInArrow(correct, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, how: Audit = Audit()) -> DataFrame:
    """``lang``, ``source``, ``part`` (pair or term), ``item``, ``value``, ``rank``."""
    ix = index(docs, how)
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_divergence(ix, how).select("lang", "source", F.lit("pair").alias("part"), "item", "value", ranked.alias("rank"))
    return pairs.unionByName(term_excess(ix, how.top))


def _share_sql(n: str, total: str, kept: str) -> str:
    return f"CAST(1 + ({SCALE}::HUGEINT * ({n} + {SMOOTHING})) // ({total} + {SMOOTHING} * {kept}) AS BIGINT)"


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
occ AS (SELECT rid, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM occ GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM kept GROUP BY lang),
freq AS (SELECT lang, source, term, count(*) AS n FROM occ SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT g.lang, g.source, coalesce(sum(f.n), 0) AS total FROM g LEFT JOIN freq f USING (lang, source) GROUP BY ALL),
grid AS (
  SELECT t.lang, t.source, k.term, coalesce(f.n, 0) AS n, {_share_sql('coalesce(f.n, 0)', 't.total', 'l.v')} AS p, {_share_sql('k.lang_n', 'l.total', 'l.v')} AS q
  FROM totals t JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN freq f ON f.lang = t.lang AND f.source = t.source AND f.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM grid x JOIN grid y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT), row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) FROM grid WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
