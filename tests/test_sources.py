import os
import time

import pytest

from dockledger import session
from dockledger.sources import readers, writers


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("1", "X", 2026, 5, 1.5)], "fill_dc string, xdock string, year int, month int, cost_per_stop double")
    path = writers.write_parquet(df, str(tmp_path / "t.parquet"), partition_by=("year",))
    assert readers.source(spark, path=path).count() == 1
    missing = writers.write_slim_extract(df, str(tmp_path / "slim"))
    assert "geo_mean" in missing and len(missing) == 9
    assert list((tmp_path / "slim").glob("*.csv.gz"))
    assert readers.read_csv(spark, str(tmp_path / "slim")).columns == ["FILL_DC_CD", "XDOCK", "YEAR", "MONTH", "cost per stop"]
    paths = writers.write_report_set({"a": df, "b": df.limit(0)}, str(tmp_path / "run"))
    assert [readers.read_parquet(spark, p).count() for p in paths.values()] == [1, 0]


def test_table_wins_over_path(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("three_rows")
    assert readers.source(spark, table="three_rows", path=str(tmp_path / "missing.parquet")).count() == 3
    with pytest.raises(ValueError):
        readers.source(spark)


def test_limited_scan_needs_an_order(spark):
    df = spark.sql("SELECT id, TIMESTAMP '2026-05-01 00:00:00' + make_interval(0, 0, 0, CAST(id AS INT)) AS t FROM range(10)")
    assert [r["id"] for r in readers.scan_filtered(df, "t", "2026-05-06 00:00:00", limit=2, order_cols=["id"]).collect()] == [5, 6]
    with pytest.raises(ValueError):
        readers.scan_filtered(df, "t", "2026-05-06 00:00:00", limit=2)


def test_load_order_identifies_rows(spark, tmp_path):
    spark.range(20).repartition(3).write.parquet(str(tmp_path / "p"))
    rows = readers.with_load_order(spark.read.parquet(str(tmp_path / "p"))).select("load_file", "load_row")
    assert rows.distinct().count() == 20


def test_intermediate_tables_need_a_shared_folder_and_are_removed(spark, monkeypatch):
    from types import SimpleNamespace

    from dockledger import session

    def with_master(master):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)

    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn"):
        with pytest.raises(RuntimeError):
            session.shared_folder(with_master(master))
    assert session.shared_folder(with_master("local[4]")) == session.shared_folder(with_master("local"))
    monkeypatch.setattr(session, "_WRITTEN", [])
    kept = session.cut_lineage(spark.range(5))
    path = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    import os

    assert kept.count() == 5 and os.path.isdir(path)
    assert session.release_tables(spark) == 1 and not os.path.exists(path)


def test_shuffle_files_go_with_the_statement(spark):
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    folders = [f.getPath() for f in env.blockManager().diskBlockManager().localDirs()]

    def shuffled():
        return {f for d in folders for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}

    before = spark.conf.get(session.SHUFFLE_CLEANUP)
    there = shuffled()
    out = session.cut_lineage(spark.range(1000).repartition(3, "id"))
    end = time.time() + 20
    while shuffled() - there and time.time() < end:
        time.sleep(0.2)
    assert not shuffled() - there
    assert out.count() == 1000 and spark.conf.get(session.SHUFFLE_CLEANUP) == before


def test_settled_keeps_only_its_result(spark, monkeypatch):
    written = []
    monkeypatch.setattr(session, "_WRITTEN", written)
    earlier = session.cut_lineage(spark.range(3))
    passed = []

    def build():
        first = session.cut_lineage(earlier.selectExpr("id * 2 AS id"))
        passed.extend(written[1:])
        return first.filter("id > 0")

    out = session.settled(spark, build)
    assert len(written) == 2 and passed[0] not in written
    assert not os.path.exists(passed[0].removeprefix("file:"))
    assert sorted(r["id"] for r in out.collect()) == [2, 4] and earlier.count() == 3
