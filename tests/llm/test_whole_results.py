"""Whole row sets of operators and of the pipeline against plain Python, and inputs that
once broke them."""

import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from dockledger.llm import license_scan, mixing, near_dedup, packing, quality_classifier, quality_rules, samples, sharding, token_counts, tokens, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(table):
    return sorted(map(tuple, table.select(COLUMNS).collect()))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


# ---- very long blanks -------------------------------------------------------

BLANKS = [" " * 5_000_000, "\n\t" * 2_500_000, "a" + "\t" * 1_000_000 + "b", "x " * 40_000 + "　" * 800_000 + "y", " " * 700_000]


@pytest.mark.parametrize("i", range(len(BLANKS)))
def test_ids_of_very_long_blanks(i):
    enc = tokens.encoder(tokens.default_path())
    assert enc.encode(BLANKS[i]).tolist() == enc.tokenizer.encode(BLANKS[i], add_special_tokens=False).ids


def test_counts_and_packing_of_very_long_blanks(spark):
    enc = tokens.encoder(tokens.default_path())
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(BLANKS[:3])], "doc_id long, text string, lang string, source string, n_chars long")
    lengths = {i: len(enc.encode(t)) for i, t in enumerate(BLANKS[:3])}
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs).collect() if r.tokenizer == token_counts.BPE} == lengths
    got = corpus_pipeline.pack_sequences(spark, docs, SF).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {i: n + 1 for i, n in lengths.items()}


# ---- ledger -----------------------------------------------------------------


def test_compacted_ledger_refuses_old_batches(spark, table, tmp_path):
    counts = token_counts.count_tokens(table.limit(20)).cache()
    ledger = token_counts.Ledger(spark, str(tmp_path / "a"))
    assert ledger.commit("one", token_counts.signed(counts, 1)) and ledger.commit("two", token_counts.signed(counts.limit(4), -1))
    before = sorted(map(str, ledger.totals().filter("n_docs <> 0 OR n_tokens <> 0").collect()))
    small = ledger.compact(str(tmp_path / "b"))
    smaller = small.compact(str(tmp_path / "c"))
    for book in (small, smaller):
        assert len(book.batches()) == 1
        assert not book.commit("one", token_counts.signed(counts, 1)) and not book.commit("two", token_counts.signed(counts, 1))
        assert sorted(map(str, book.totals().collect())) == before
    assert smaller.commit("three", token_counts.signed(counts, 1)) and len(smaller.batches()) == 2


def test_of_two_attempts_one_is_published(spark, table, tmp_path):
    counts = token_counts.signed(token_counts.count_tokens(table.limit(5)), 1)
    ledger = token_counts.Ledger(spark, str(tmp_path / "a"))
    for name in ("attempt-x", "attempt-y"):
        token_counts.deltas(counts).write.parquet(f"{ledger.folder}/{name}")
    assert ledger.totals().count() == 0
    assert ledger._publish(f"{ledger.folder}/attempt-x", "one") and not ledger._publish(f"{ledger.folder}/attempt-y", "one")
    assert [p.rsplit("/", 1)[1] for p in ledger.batches()] == ["batch-one"] and os.listdir(tmp_path / "a") == ["batch-one"]


# ---- helpers that write whole rows ------------------------------------------


def test_shards_hold_repeated_and_null_ids(spark, tmp_path):
    made = [(1, "x" * 50), (1, "x" * 50), (None, "y" * 20), (None, "y" * 20), (2, None), *[(i, "z" * i) for i in range(3, 60)]]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    sharding.write_shards(docs, str(tmp_path / "out"), limit=300)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter(made)
    sizes = back.groupBy("shard").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n"), F.count("*").alias("rows"))
    assert sizes.filter("n > 300 AND rows > 1").count() == 0
    assert {r.shard for r in sizes.collect()} == {f"s{r.shard}" for r in sharding.assign(docs, limit=300).collect()}


def test_sequences_give_the_texts_back(spark):
    made = [(1, "one text"), (1, "one text"), (None, "no id"), (2, None), (3, " ".join(f"w{i}" for i in range(900)))]
    enc = tokens.encoder(tokens.default_path())
    got = packing.sequences(spark.createDataFrame(made, "doc_id long, text string")).collect()
    found = Counter()
    for r in got:
        assert len(r.ids) <= 1024
        for doc_id, start, end in zip(r.doc_ids, r.starts, [*r.starts[1:], len(r.ids)]):
            found[doc_id] += end - start
    expected = Counter()
    for doc_id, text in made:
        expected[doc_id] += len(enc.encode(text)) + 1
    assert found == expected
    whole = [tuple(r.ids[a:b]) for r in got for i, a, b in zip(r.doc_ids, r.starts, [*r.starts[1:], len(r.ids)]) if i == 1]
    assert whole == [(*enc.encode("one text").tolist(), 2)] * 2


# ---- packing ----------------------------------------------------------------


def test_number_of_sequences(table):
    pieces = packing.pack_documents(table).collect()
    total = sum(r.length for r in pieces)
    assert len({r.sequence_id for r in pieces}) <= math.ceil(total / 1024) * 1.01 + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_all_three_capacities_decide_in_spark(table, rule):
    """Sequences that are closed by tokens, by documents and by attention cost."""
    cap = packing.Capacity(tokens=1024, documents=3, attention=400_000.0, rule=rule)
    pieces = packing.pack(packing.tokenized(table, 600), cap).collect()
    own = defaultdict(list)
    for r in pieces:
        own[r.sequence_id].append(r.length)
    assert all(sum(v) <= 1024 and len(v) <= 3 and sum(x * x for x in v) <= 400_000 for v in own.values())
    assert sum(map(len, own.values())) == packing.tokenized(table, 600).count()
    least = min(r.length for r in pieces)
    assert any(len(v) == 3 and sum(v) + least <= 1024 for v in own.values())  # full by documents
    free = packing.pack(packing.tokenized(table, 600), packing.Capacity(tokens=1024, documents=3, rule=rule)).select("sequence_id").distinct().count()
    assert len(own) > free  # by attention


# ---- licences ---------------------------------------------------------------


def plain_scan(text, templates, how):
    """Every template against every place of the text, no index, no winnowing: which
    templates are there word for word."""
    words = [w for w in license_scan.normalized(text)]
    found = set()
    for name, template in templates:
        t = [w for w in license_scan.normalized(template)]
        found |= {(name, i, i + len(t)) for i in range(len(words) - len(t) + 1) if words[i : i + len(t)] == t}
    return found


def test_license_scan_finds_every_exact_notice(spark, rows, table):
    """All verbatim notices of the table: each is reported itself or within a longer one."""
    got = defaultdict(list)
    for r in license_scan.scan(table).collect():
        got[r.doc_id].append((r.license, r.start_word, r.end_word, r.matched, r.coverage))
    notices = 0
    for doc_id, text, *_ in rows:
        for name, start, end in plain_scan(text, license_scan.TEMPLATES, license_scan.Scan()):
            notices += 1
            assert any(a <= start and end <= b for _, a, b, _, _ in got[doc_id]), (doc_id, name)
        spans = sorted((a, b) for _, a, b, _, _ in got[doc_id])
        assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
    assert notices > 0
    assert all(m <= b - a + 8 and 0 < c <= 1 for own in got.values() for _, a, b, m, c in own)


def test_many_notices_in_one_text(spark):
    notice = "Licensed under the Apache License, Version 2.0. something else follows here "
    rows_ = license_scan.scan(spark.createDataFrame([(1, notice * 3000)], "doc_id long, text string")).collect()
    assert len(rows_) == 3000 and [r.start_word for r in rows_] == sorted(r.start_word for r in rows_)


# ---- mixing -----------------------------------------------------------------


def plain_targets(sizes):
    """Target of each source: water filling by weight under twice its size."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > 2 * sizes[s]}
        if not over:
            target |= {s: unit * weight[s] for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2.0 * sizes[s] for s in over)
        open_ -= over
    return target


def test_mix_reaches_its_targets(spark, rows, table):
    got = entry_points.queries()["op8_sainte_lague_mixing"](spark, SF).collect()
    size = {i: len(re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t, *_ in rows}
    source = {r[0]: r[3] for r in rows}
    sizes, taken = Counter(), Counter()
    for i, s in source.items():
        sizes[s] += size[i]
    target = plain_targets(sizes)
    for r in got:
        s = source[r.doc_id]
        assert (r["size"], r.source_size) == (size[r.doc_id], sizes[s]) and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - t) <= max(256, 0.01 * t) for s, t in target.items())


# ---- classifiers ------------------------------------------------------------


def test_votes_of_every_document(table, labels, rows):
    """Cosines by plain loops over the model's sample, ties to the earlier row."""
    how = quality_classifier.Voting(sample_rows=60)
    model = quality_classifier.fit(table, labels, how)
    got = {r.doc_id: r.score for r in quality_classifier.score(table, model).collect()}
    for doc_id, text, *_ in rows:
        v = model.latent(quality_classifier.text_counts(text, how.features)[None, :])[0].astype(np.float64)
        cosine = model.vectors.astype(np.float64) @ v
        near = np.argsort(-np.round(cosine, 5), kind="stable")[: how.neighbours]
        weight = np.maximum(cosine[near], 0)
        expected = (weight * model.labels[near]).sum() / weight.sum() if weight.sum() > 0 else model.labels.mean()
        assert abs(got[doc_id] - expected) < 0.08, doc_id


def test_nearest_takes_the_earlier_of_equals():
    c = np.array([[0.5, 0.9, 0.5, 0.5, 0.5, 0.1], [0.2, 0.2, 0.2, 0.2, 0.2, 0.2], [6, 5, 4, 3, 2, 1.0]])
    assert [sorted(r) for r in quality_classifier.nearest(c, 3).tolist()] == [[0, 1, 2], [0, 1, 2], [0, 1, 2]]


def test_counts_above_two_bytes_are_kept(spark):
    text = "aaa " * 40_000
    docs = spark.createDataFrame([(0, text), (1, text), (2, "bbb ccc")], "doc_id long, text string")
    labels_ = spark.createDataFrame([(i, i % 2) for i in range(3)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels_)
    kept = [i for i in range(3) if zlib.crc32(str(i).encode()) % 5]
    vectors = model.latent(np.stack([quality_classifier.text_counts(dict(docs.collect())[i], model.how.features) for i in kept]))
    assert np.allclose(vectors, model.vectors, atol=1e-5)


def test_severity_of_every_document(table, labels, rows):
    model = toxicity.fit(table, labels)
    assert len(model.thresholds) and (np.diff(model.thresholds) > 0).all()
    for r in toxicity.score(table, model).collect():
        text = dict((x[0], x[1]) for x in rows)[r.doc_id]
        total = sum(float(model.weights[c]) for c in toxicity.features_of(text, model.how.features))
        p = [1 / (1 + math.exp(t - total)) for t in model.thresholds]
        assert r.severity == pytest.approx(sum(p), abs=1e-4) and r.toxic == (r.p_toxic >= 0.5)


def test_toxicity_fit_equals_counting_on_the_driver(table, labels):
    """Columns chosen in Spark are those that whole rows on the driver would give."""
    how = toxicity.Ordinal(sample_rows=80, least_z=1.5, least_texts=2)
    model = toxicity.fit(table, labels, how)
    sample = sorted(samples.labelled(table, labels, "toxic", how.sample_rows).collect(), key=lambda r: r.doc_id)
    found = [toxicity.features_of(r.text, how.features) for r in sample]
    y = np.array([r.label for r in sample])
    every, high = (np.bincount(np.concatenate([c for c, g in zip(found, y) if g >= low]), minlength=how.features) for low in (0, 1))
    marker = (high >= 5) & (high > 5 * y.mean() * every)
    grades = toxicity.graded(y, np.array([marker[c].sum() for c in found]))
    plain = toxicity.fit_rows([(c, int(g)) for c, g in zip(found, grades)], how)
    assert np.allclose(model.weights, plain.weights, atol=1e-6) and np.allclose(model.thresholds, plain.thresholds, atol=1e-6)


# ---- the pipeline, stage by stage -------------------------------------------


def plain_duplicates(docs, size=5, percent=80):
    sets, root = {}, {}
    for i, text, *_ in docs:
        w = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
        root[i] = i

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in ids if find(i) == i}


def test_whole_pipeline(spark, table, labels, rows):
    stages = dict(corpus_pipeline.STAGES)
    docs, kept = table, rows
    # 1: by the scores of the same operator, which test_votes_of_every_document checks
    scores = {r.doc_id: r.predicted for r in quality_classifier.score(table, quality_classifier.fit(table, labels)).collect()}
    expected = [r for r in kept if scores[r[0]] == 1]
    docs = stages["quality classifier"](spark, docs, SF)
    assert sorted(map(tuple, docs.select(COLUMNS).collect())) == expected and docs.columns == table.columns
    kept, docs = expected, spark.createDataFrame(expected, table.select(COLUMNS).schema)
    # 2: by the verdicts of the ledger, which SQL checks
    verdict = {r.doc_id: r.kept for r in quality_rules.apply_policy(quality_rules.ledger(table)).collect()}
    expected = [r for r in kept if verdict[r[0]]]
    docs = stages["quality rules"](spark, docs, SF)
    assert sorted(map(tuple, docs.select(COLUMNS).collect())) == expected and 0 < len(expected) < len(rows)
    kept, docs = expected, spark.createDataFrame(expected, table.select(COLUMNS).schema)
    # 3: all pairs of full sets
    stay = plain_duplicates(kept)
    expected = [r for r in kept if r[0] in stay]
    docs = stages["MinHash near-dedup"](spark, docs, SF)
    assert sorted(map(tuple, docs.select(COLUMNS).collect())) == expected
    kept, docs = expected, spark.createDataFrame(expected, table.select(COLUMNS).schema)
    # 4: words of each document as often as the mix takes them, in their order
    taken = {r.doc_id: r.taken for r in mixing.mix(mixing.sized(docs)).collect()}
    words = {r[0]: re.findall("[^\x20\x09-\x0d]+", r[1] or "") for r in kept}
    expected = Counter()
    for i, n in taken.items():
        got = []
        while n > 0:
            got.append(words[i][:n])
            n -= len(words[i])
        expected.update((i, tuple(w)) for w in got)
    docs = stages["mixing sources"](spark, docs, SF)
    mixed = sorted(map(tuple, docs.select(COLUMNS).collect()))
    assert Counter((r[0], tuple(re.findall("[^\x20\x09-\x0d]+", r[1] or ""))) for r in mixed if r[1]) == expected
    # 5: every piece of every text, and no more
    enc = tokens.encoder(tokens.default_path())
    pieces = Counter()
    for i, text, *_ in mixed:
        ids = np.append(enc.encode(text), 2).astype("<u4")
        first = len(ids) % 1024 or 1024
        for k, start in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[start : start + (first if k == 0 else 1024)]
            pieces[i, k, start, len(part), zlib.crc32(part.tobytes())] += 1
    docs = spark.createDataFrame(mixed, table.select(COLUMNS).schema)
    last = stages["best-fit packing"](spark, docs, SF).collect()
    whole = corpus_pipeline.run(spark, SF).collect()
    for out in (last, whole):
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == pieces
    assert near_dedup.Similarity() == near_dedup.Similarity(shingle=5, percent=80)
