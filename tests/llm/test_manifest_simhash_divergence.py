"""Merkle manifest, SimHash components and source divergence: plain Python versions on
small tables, edge rows, and the parts that only large tables reach."""

import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from dockledger.llm import divergence, merkle, simhash
from dockledger.session import cut_lineage

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row int, tree string, fp long, idx string, term string, key string"
LONG = " ".join(f"W{i % 9973}" for i in range(60_000))
EXTRA = (1, "t", 7, "x", "y", "k")
ROWS = [
    (1, None, "en", "a", None, *EXTRA),
    (2, "", None, None, 0, *EXTRA),
    (3, " \n\t ", "en", "a", 4, *EXTRA),
    (4, LONG, "en", "b", len(LONG), *EXTRA),
    (5, "one", "en", "b", 3, *EXTRA),
    (5, "one", "en", "b", 3, *EXTRA),
    (5, "two\nlines", "en", "b", 9, *EXTRA),
    (None, "no id\nhere", "en", "c", 10, *EXTRA),
    (7, "same words " * 40, "en", "c", 440, *EXTRA),
    (8, "Same words " * 40, "en", "c", 440, *EXTRA),
    (9, "éÀ ñ_x naïve-Ünder\x1cline 日本語 9a9", "", "", 9, *EXTRA),
    (10, "\n".join(f"line {i}" for i in range(30)), "en", "é", 9, *EXTRA),
    (12, "zwölf\n", "en", "zz", 9, *EXTRA),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


# ---- Merkle manifest --------------------------------------------------------


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(nodes):
    """Levels from the leaves to the top."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_way(levels, at):
    way = []
    for level in levels[:-1]:
        first = at // 3 * 3
        way.append(("".join(level[first:at]), "".join(level[at + 1 : first + 3])))
        at //= 3
    return way


def plain_audit(rows):
    by_source = defaultdict(list)
    for doc_id, text, lang, source, n_chars, *_ in rows:
        tampers = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        own = plain_leaf(doc_id, source, lang, n_chars, text)
        cut = plain_leaf(doc_id, source, lang, n_chars, text.replace("\n", "")) if tampers and text is not None else own
        by_source[source].append((doc_id is not None, doc_id or 0, own, cut, doc_id))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(by_source[s]), plain_tree([r[2] for r in sorted(by_source[s])])) for s in names}
    upper = plain_tree([trees[s][1][-1][0] for s in names])
    out = []
    for i, s in enumerate(names):
        leaves, levels = trees[s]
        for at, (_, _, own, cut, doc_id) in enumerate(leaves):
            way = plain_way(levels, at) + plain_way(upper, i)
            value = cut
            for before, after in way:
                value = H(before, value, after)
            out.append((doc_id, own, levels[-1][0], upper[-1][0], H(*(x for step in way for x in step)), value, value == upper[-1][0]))
    return Counter(out)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_manifest_of_edge_rows(docs):
    expected = plain_audit(ROWS)
    assert {v[-1] for v in expected} == {True, False}
    assert Counter(map(tuple, merkle.audit(docs).select(COLUMNS).collect())) == expected
    assert Counter(map(tuple, merkle.audit(docs.repartition(7)).select(COLUMNS).collect())) == expected
    assert merkle.audit(docs.limit(0)).count() == 0


def test_manifest_of_a_hot_source_in_small_pieces(spark, monkeypatch):
    """Several climbs, leaf partitions that cut runs, one source over all partitions."""
    monkeypatch.setattr(merkle, "STEP", 2)
    monkeypatch.setattr(merkle, "CHUNK", 7)
    rows = [(i, f"text\n{i}" if i % 3 else f"text {i}", "en", "hot" if i < 300 else f"s{i % 11}", i) for i in range(400)] + [(1000, "x", None, None, None)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    leaves = merkle.document_leaves(made)
    plain = plain_audit(rows)
    assert Counter(map(tuple, merkle.audit(made).select(COLUMNS).collect())) == plain
    book = merkle.manifest(leaves)
    assert book.leaves.filter("tree = 'hot'").agg(F.count_distinct("idx"), F.max("idx"), F.max("n")).first()[:] == (300, 299, 300)
    some = book.prove(book.leaves.filter("key % 50 = 3"), with_proofs=True).collect()
    assert len(some) == 8 and all(merkle.fold(r.leaf, merkle._decode(r.proof)) == r.root for r in some if r.verified)
    assert {(r.key, r.proof_sha256) for r in some} <= {(v[0], v[4]) for v in plain}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 100])
def test_multiproof_fetches_the_least(n):
    levels = plain_tree([H(str(i)) for i in range(n)])
    r = np.random.default_rng(n)
    for size in {1, min(3, n), n}:
        wanted = sorted(r.choice(n, size=size, replace=False).tolist())
        needed = merkle.missing(wanted, n)
        chunk = merkle.Chunk({i: levels[0][i] for i in wanted}, {(lv, i): levels[lv][i] for lv, i in needed}, n)
        assert chunk.top == levels[-1][0]
        for i in wanted:
            assert chunk.path(i) == plain_way(levels, i) and merkle.fold(levels[0][i], chunk.path(i)) == chunk.top
        single = {(lv, s) for i in wanted for lv, (at, size_) in enumerate(zip([i // 3**k for k in range(len(levels))], map(len, levels[:-1]))) for s in merkle.run_of(at, size_) if s != at}
        derived = {(lv, i // 3**lv) for i in wanted for lv in range(len(levels))}
        assert set(needed) == single - derived and len(needed) == len(set(needed))


# ---- SimHash ----------------------------------------------------------------


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(ids, pairs):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}


def near(a, b, distance=2):
    return ((a ^ b) & (2**64 - 1)).bit_count() <= distance


def test_simhash_components(spark, docs):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fps = {r.doc_id: plain_fingerprint(r.text) for r in table.collect()}
    ids = sorted(fps)
    least = joined(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if near(fps[a], fps[b])])
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.components(table).collect()} == {i: (f"{fps[i]:016x}", least[i]) for i in ids}
    got = simhash.components(docs).collect()
    assert len(got) == len(ROWS)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append((r.fingerprint, r.component_id))
    assert all(by_id[i] == [("0" * 16, 1)] for i in (1, 2, 3)) and by_id[8][0][1] == 7
    assert by_id[4][0][0] == f"{plain_fingerprint(LONG):016x}" and by_id[None][0][1] is None
    assert Counter(c for _, c in by_id[5]) == {5: 3}
    assert simhash.components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("how", [simhash.Fingerprints(dense=3), simhash.Fingerprints(dense=3, distance=3), simhash.Fingerprints(dense=2, distance=1), simhash.Fingerprints(distance=5, segments=4, dense=10**9)])
def test_no_link_is_lost_in_dense_groups(spark, how):
    r = np.random.default_rng(how.distance)
    made = set()
    for base in r.integers(0, 2**63, 4).tolist():
        for k in range(5):
            for _ in range(25):
                made.add(base ^ sum(1 << int(b) for b in r.choice(64, size=k, replace=False)))
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in made)
    table = spark.createDataFrame([(x,) for x in fps], "fp long")
    met = simhash.segment_links(table, how).collect()
    links = [(m.a, m.b) for m in met if m.b is not None]
    crowd = {m.a for m in met if m.b is None}
    assert bool(crowd) == (how.dense < 100)
    if crowd:
        links += [(m.a, m.b) for m in simhash.centre_links(spark.createDataFrame([(x,) for x in crowd], "fp long"), how).collect()]
    assert all(near(a, b, how.distance) for a, b in links)
    assert joined(fps, links) == joined(fps, [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if near(a, b, how.distance)])


def test_links_of_a_dense_group_stay_linear(spark):
    """Fingerprints that share all of one segment: looked up, none meets all others."""
    n = 3000
    table = spark.range(n).select((F.col("id") + (7 << 32)).alias("fp"))
    met = simhash.segment_links(table, simhash.Fingerprints())
    assert met.filter("b IS NULL").count() == n
    assert met.filter("b IS NOT NULL").count() == sum(1 for i in range(n) for b in range(12) if not i >> b & 1 and i | 1 << b < n)
    assert simhash.centre_links(table, simhash.Fingerprints()).count() <= 65 * n


# ---- source divergence ------------------------------------------------------


def test_exploded_tables_are_not_broadcast(spark):
    """What they are made of is far below the broadcast limit, they need not be."""
    table = cut_lineage(spark.range(2000).select(F.xxhash64("id").alias("fp")))
    for found in (simhash.segment_links(table, simhash.Fingerprints()), simhash.centre_links(table, simhash.Fingerprints())):
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def plain_divergence(rows, min_docs=30, top=50):
    found = []
    for _, text, lang, source, *_ in rows:
        lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
        found.append((lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lowered)))
    docs, occ = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in found:
        docs[lang].update(set(words))
        occ[lang, source].update(words)
    out = []
    for lang in docs.keys() | {g[0] for g in occ}:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        groups = sorted(g for g in occ if g[0] == lang)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {g[1]: shares(occ[g]) for g in groups}
        q = shares(sum((occ[g] for g in groups), Counter()))
        for _, s in groups:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in p if o != s]
            own = [(t, p[s][t] - q[t]) for t in kept if occ[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", own, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


ORDER = ["lang", "source", "part", "item", "value", "rank"]


def test_divergence_of_edge_rows(docs):
    for how in (divergence.Audit(min_docs=1), divergence.Audit(min_docs=2), divergence.Audit()):
        got = sorted(map(tuple, divergence.audit(docs, how).select(ORDER).collect()))
        assert got == plain_divergence(ROWS, how.min_docs)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_divergence_in_small_pieces(spark):
    """Many runs, shards and source blocks."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in table.collect()]
    how = divergence.Audit(min_docs=3, top=9, block_postings=200, sources=3, shard_postings=300)
    assert sorted(map(tuple, divergence.audit(table, how).select(ORDER).collect())) == plain_divergence(rows, 3, 9)


def test_runs_are_sorted_and_spilled():
    block = divergence.Block()
    block.add("en", "b", b"Zeta alpha alpha")
    block.add("en", "a", b"alpha x1y")
    assert block.postings == 7
    runs = [list(zip(*(c.to_pylist() for c in b.columns))) for b in block.runs()]
    assert len(runs) == 2 and all(run == sorted(run, key=lambda r: r[2]) for run in runs)
    rows = [r for run in runs for r in run]
    assert ("en", "b", b"alpha", 2, 1) in rows and ("en", "a", b"", 0, 1) in rows


def test_shares_of_huge_counts_are_exact(spark):
    n, total, kept = 987_654_321_012, 7_000_000_000_123, 123_457
    got = spark.sql(f"SELECT {n}L AS n, {total}L AS total, {kept}L AS kept").select(divergence.share("n", "total", "kept")).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * kept)
