"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns for
every corpus operator and pipeline stage."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dockledger.llm import hilbert_ann, license_scan, mixing, near_dedup, packing, quality_classifier, quality_rules, sharding, token_counts, toxicity
from dockledger.llm.tokens import default_path, encoder

# Extra columns carry names that the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row int, size string, key string, node string"
LONG = " ".join(f"w{i % 9973}" for i in range(60_000))
ROWS = [
    (1, None, "en", "a", None, 1, "x", "k", "n"),
    (2, "", None, None, 0, 1, "x", "k", "n"),
    (3, " \n\t ", "en", "a", 4, 1, "x", "k", "n"),
    (4, LONG, "en", "b", len(LONG), 1, "x", "k", "n"),
    (5, "one", "en", "b", 3, 1, "x", "k", "n"),
    (5, "one", "en", "b", 3, 1, "x", "k", "n"),
    (None, "no id here", "en", "c", 10, 1, "x", "k", "n"),
    (7, "same words " * 40, "en", "c", 440, 1, "x", "k", "n"),
    (8, "Same words " * 40, "en", "c", 440, 1, "x", "k", "n"),
]
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (7, 0, 1), (7, None, None), (None, 1, 0), (99, 1, 1), (8, 0, 1), (5, 1, 0)], LABELS)


def test_quality_rules(docs, spark):
    rows = {(r.doc_id, r.n_words, r.n_repeat_words, r.base_failed, r.kept) for r in quality_rules.apply_policy(quality_rules.ledger(docs)).collect()}
    assert (1, 0, 0, True, False) in rows and (2, 0, 0, True, False) in rows and (5, 1, 0, True, False) in rows
    assert (7, 80, 80, True, False) in rows
    assert (4, 60_000, 60_000, True, False) in rows
    assert quality_rules.ledger(docs).count() == len(ROWS)
    assert quality_rules.ledger(docs.limit(0)).count() == 0


def test_rule_measures_by_hand(spark):
    text = "a b c a b c x\n# a|b !\n\na b c a b c x\n \nñé a"
    r = quality_rules.measure(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    words = text.split()
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {p for i, w in enumerate(wins) if wins.count(w) > 1 for p in (i, i + 1, i + 2)}
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), 2, 1, len(repeated))


def test_ablation_counts_bits(spark):
    m = quality_rules.mask
    rows = spark.createDataFrame([(0,), (m(("symbols",)),), (m(("symbols", "shouting")),), (m(("few_words",)),)], "failed long")
    got = {r.rule: (r.failed, r.only, r.kept_without) for r in quality_rules.ablation(rows).collect()}
    assert got["symbols"] == (2, 1, 2) and got["shouting"] == (1, 0, 1) and got["few_words"] == (1, 1, 2)


def test_near_dedup(docs):
    got = near_dedup.components(docs, near_dedup.Similarity(shingle=2)).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(ROWS)
    assert [by_id[i][0].n_shingles for i in (1, 2, 3, 5)] == [0, 0, 0, 1]
    assert by_id[8][0].component_id == 7 and not by_id[8][0].kept and by_id[7][0].kept
    assert all(r.component_id == 1 and r.kept for r in by_id[1]) and all(r.kept for r in by_id[5]) and not by_id[None][0].kept
    assert near_dedup.components(docs.limit(0)).count() == 0
    stay = sorted((r.doc_id or 0) for r in near_dedup.keep_documents(docs).collect())
    assert stay == [0, 1, 2, 3, 4, 5, 7]


def test_packing(docs):
    rows = packing.pack_documents(docs).collect()
    enc = encoder(default_path())
    expected = {}
    for doc_id, text, *_ in ROWS:
        ids = np.append(enc.encode(text), 2).astype("<u4")
        for i, (start, n) in enumerate(packing.cuts(len(ids), 1024)):
            expected.setdefault((doc_id, i, start, n, zlib.crc32(ids[start : start + n].tobytes())), 0)
            expected[doc_id, i, start, n, zlib.crc32(ids[start : start + n].tobytes())] += 1
    got = {}
    for r in rows:
        got[tuple(r)[:5]] = got.get(tuple(r)[:5], 0) + 1
    assert got == expected
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 1024
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_every_capacity_binds():
    lengths = np.array([3, 3, 2, 2, 1, 1, 1, 1])
    for rule in ("norm", "dot"):
        bins, _ = packing.best_fit(lengths, packing.Capacity(tokens=8, documents=3, attention=14.0, rule=rule))
        for b in set(bins):
            own = lengths[bins == b]
            assert own.sum() <= 8 and len(own) <= 3 and (own**2).sum() <= 14
    with pytest.raises(ValueError):
        packing.best_fit(np.array([9]), packing.Capacity(tokens=8))


def test_mixing(docs):
    rows = mixing.mix(mixing.sized(docs), shard_tokens=1000, block=8).collect()
    assert len(rows) == len(ROWS)
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    assert {r.taken for r in rows if r.size == 0} == {0}
    target = {r.source: r.target for r in rows}
    for s in target:
        assert abs(sum(r.taken for r in rows if r.source == s) - target[s]) <= 16
    again = mixing.mix(mixing.sized(docs.repartition(7)), shard_tokens=1000, block=8)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))
    assert mixing.mix(mixing.sized(docs.limit(0))).count() == 0
    mixed = mixing.mix_documents(docs, block=8)
    assert mixed.columns == docs.columns
    assert mixing.sized(mixed).agg(F.sum("size")).first()[0] == mixing.mix(mixing.sized(docs), block=8).agg(F.sum("taken")).first()[0]
    assert mixing.mix_documents(docs.limit(0)).count() == 0


def test_small_sources_stay_in_the_mix(spark):
    """With the blocks of production: a long tail of sources below half a block."""
    made = [(i, "w " * 20, f"tail{i:02}") for i in range(30)] + [(100 + i, "w " * 500, "main") for i in range(10)]
    rows = mixing.mix(mixing.sized(spark.createDataFrame(made, "doc_id long, text string, source string"))).collect()
    taken, target = {}, {r.source: r.target for r in rows}
    for r in rows:
        taken[r.source] = taken.get(r.source, 0) + r.taken
    least = min(target.values())
    assert all(abs(taken[s] - t) <= least for s, t in target.items()) and all(taken.values())


def test_sharding(docs):
    rows = sharding.assign(docs, limit=1000).collect()
    assert len(rows) == len(ROWS)
    size, count = {}, {}
    for r in rows:
        size[r.shard] = size.get(r.shard, 0) + r.bytes
        count[r.shard] = count.get(r.shard, 0) + 1
    assert all(size[s] <= 1000 or count[s] == 1 for s in size)
    assert sum(r.oversized for r in rows) == 1
    assert all(a == b or not b.startswith(a) for a in size for b in size)
    assert sharding.assign(docs.limit(0)).count() == 0


def test_one_id_for_all_rows_still_splits(spark):
    same = spark.range(200).select(F.lit(1).alias("doc_id"), F.lit("x" * 10).alias("text"))
    rows = sharding.assign(same, limit=100)
    assert rows.groupBy("shard").agg(F.sum("bytes").alias("b")).filter("b > 100").count() == 0 and rows.count() == 200
    assert sharding.directory(rows).agg(F.sum("rows")).first()[0] == 200


def test_token_ledger(docs, spark, tmp_path):
    counts = token_counts.count_tokens(docs).cache()
    assert counts.count() == 2 * len(ROWS)
    ledger = token_counts.Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.totals().count() == 0
    assert ledger.commit("one", token_counts.signed(counts, 1))
    once = sorted(map(str, ledger.totals().collect()))
    assert not ledger.commit("one", token_counts.signed(counts, 1))
    assert sorted(map(str, ledger.totals().collect())) == once
    (tmp_path / "ledger" / "attempt-lost").mkdir()  # an attempt that was never named
    assert sorted(map(str, ledger.totals().collect())) == once
    ledger.commit("two", token_counts.signed(counts, -1))
    assert {(r.n_docs, r.n_tokens) for r in ledger.totals().collect()} == {(0, 0)}
    assert ledger.compact(str(tmp_path / "compact")).totals().count() == 0
    ledger.commit("empty", token_counts.signed(counts.limit(0), 1))
    assert len(ledger.batches()) == 3
    with pytest.raises(ValueError):
        ledger.commit("../up", counts)


def test_license_scan(docs, spark):
    assert license_scan.scan(docs).count() == 0 and license_scan.scan(docs.limit(0)).count() == 0
    notice = "free. Licensed under the APACHE license, version 2.0. more"
    far = "x " * 5000 + "permission is hereby granted free of charge to any other person obtaining a copy of the software and associated documentation files"
    rows = spark.createDataFrame([(1, notice), (1, notice), (2, "licensed under the moon"), (3, far), (4, "All rights reserved."), (5, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.license, r.start_word, r.end_word, r.matched) for r in license_scan.scan(rows).collect())
    assert got[0] == got[1] == (1, "Apache-2.0", 1, 8, 7)
    assert got[2][:4] == (3, "MIT", 5000, 5021) and got[3] == (4, "all-rights-reserved", 0, 3, 3) and len(got) == 4
    blocks = license_scan.scan(rows, how=license_scan.Scan(block_words=20))
    assert sorted((r.doc_id, r.license) for r in blocks.collect()) == [g[:2] for g in got]


def test_licences_are_told_from_their_siblings(spark):
    mit = next(t for n, t in reversed(license_scan.TEMPLATES) if n == "MIT")
    gnu = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    cases = [
        ("Released under the BSD License.", ["BSD"]),
        ("Released under the MIT License.", ["MIT"]),
        ("Released under the Moon License.", []),
        ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
        ("This work is licensed under the GNU General Public License, version 7.", []),
        ("Licensed under the Apache License, Version 1.1", ["Apache-1.1"]),
        ("Licensed under the Apache License, Version 2.0", ["Apache-2.0"]),
        ("Licensed under the Apache License, Version 9.9", []),
        ("Licensed under the Apache License 2.0", ["Apache-2.0"]),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
        (gnu.format("General", "2"), ["GPL-2.0"]),
        (gnu.format("General", "3"), ["GPL-3.0"]),
        (gnu.format("Lesser General", "2.1"), ["LGPL-2.1"]),
        ("intro " + mit + " end", ["MIT"]),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {i: [] for i in range(len(cases))}
    for r in license_scan.scan(rows).collect():
        got[r.doc_id].append(r.license)
    assert [(cases[i][0], found) for i, found in got.items()] == cases


def test_toxicity(docs, labels):
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(np.isfinite(r.severity) for r in got)
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.severity for r in toxicity.score(docs, none).collect()} == {0.0}


def test_classifier(docs, labels):
    model = quality_classifier.fit(docs, labels)
    got = quality_classifier.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert quality_classifier.score(docs.limit(0), model).count() == 0
    none = quality_classifier.fit(docs, labels.limit(0))
    assert {r.score for r in quality_classifier.score(docs, none).collect()} == {0.5}


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (100, [0.5, 0.5]), (None, [1.0, 1.0]), (11, [])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, key string")
    got = hilbert_ann.search(table, F.col("vec_id") % 100 == 0).collect()
    assert [(r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == 0] == [1, 2, 100, 3]
    assert [(r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == 100] == [0, 1, 2, 3]
    assert hilbert_ann.search(table.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, labels, tmp_path, stage):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    run = dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, docs, str(tmp_path))
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns
        assert {f.dataType for f in out.schema} == {f.dataType for f in docs.schema}
    kept = sorted((r.doc_id or 0) for r in out.select("doc_id").distinct().collect())
    assert set(kept) <= {r[0] or 0 for r in ROWS} and (kept or stage == "quality rules")
    assert run(spark, docs.limit(0), str(tmp_path)).count() == 0
