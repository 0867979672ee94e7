import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dockledger.functions import stats
from dockledger.functions.stats import average_rank, average_ranks, describe_columns, group_quantiles, group_transform, with_before


def frame(spark, seed, n=4000):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(
        {
            # one group holds most rows, one has a single row, one only nulls
            "k": np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", None], n)),
            "x": rng.normal(0, 50, n).round(2),
            "y": rng.choice([0.0, 1.0, 2.5, -7.0], n),
        }
    )
    pdf.loc[pdf.index % 11 == 0, "x"] = np.nan
    extra = pd.DataFrame({"k": ["single", "empty", "empty"], "x": [3.5, np.nan, np.nan], "y": [1.0, np.nan, np.nan]})
    return pd.concat([pdf, extra], ignore_index=True)


@pytest.mark.parametrize("seed", [1, 2])
def test_group_quantiles_match_pandas(spark, seed):
    pdf = frame(spark, seed)
    wanted = {"x10": ("x", 0.1), "x50": ("x", 0.5), "x99": ("x", 0.99), "y25": ("y", 0.25), "y100": ("y", 1.0)}
    got = {r["k"]: r for r in group_quantiles(spark.createDataFrame(pdf), ["k"], wanted).collect()}
    for key, part in pdf.groupby("k", dropna=False):
        for name, (c, p) in wanted.items():
            expected = part[c].quantile(p)
            value = got[key if isinstance(key, str) else None][name] if not np.isnan(expected) else None
            assert value == (None if np.isnan(expected) else pytest.approx(expected, abs=1e-9)), (key, name)
    assert "empty" not in got


def test_crowded_values_are_cut_until_they_are_few(spark, monkeypatch):
    """One band of the first pass holds a whole group: around 1e9, below 0.001, powers
    down to 1e-300, one value repeated, negative ones."""
    monkeypatch.setattr(stats, "INTERVAL_ROWS", 500)
    n = 60_000
    i = F.col("id")
    made = {
        "far": 1e9 + (i * 7919 % n) / 1000.0,
        "near": (i * 7919 % n) / (n * 1000.0),
        "powers": F.pow(F.lit(10.0), -(i % 300).cast("double")),
        "same": F.lit(3.25),
        "below": -1e-7 * (1 + (i * 31 % n)),
    }
    df = spark.range(n).select(F.lit("g").alias("k"), *[c.cast("double").alias(name) for name, c in made.items()])
    wanted = {f"{c}_{int(p * 1000)}": (c, p) for c in made for p in (0.001, 0.25, 0.5, 0.9)}
    row = group_quantiles(df, ["k"], wanted).first()
    pdf = df.toPandas()
    for name, (c, p) in wanted.items():
        assert row[name] == pytest.approx(pdf[c].quantile(p), rel=1e-12), name
    long = stats.long_values(df, ["k"], list(made))
    assert stats.quantile_intervals(long, ["k", "metric"], [0.5]).filter("lo < hi AND n > 500").count() == 0


def test_global_quantiles_ignore_nan_and_infinity(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert group_quantiles(df, [], {"m": ("x", 0.5)}).first()["m"] == 2.0


def test_group_transform_keeps_null_groups(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 5), (None, 6)], "k string, v int")
    out = sorted((r["v"], r["total"]) for r in group_transform(df, ["k"], total=F.sum("v")).collect())
    assert out == [(1, 3), (2, 3), (5, 11), (6, 11)]


def test_average_rank(spark):
    df = spark.createDataFrame([(1, 10), (1, 20), (1, 20), (1, 30)], "g int, v int")
    ranks = sorted(r["r"] for r in df.select(average_rank("v", ["g"]).alias("r")).collect())
    assert ranks == [1.0, 2.5, 2.5, 4.0]


def test_average_ranks_of_a_group_in_many_partitions(spark, monkeypatch):
    """One group holds most rows, its values lie in several partitions, ties span rows."""
    r = np.random.default_rng(4)
    pdf = pd.DataFrame({"id": range(5000), "g": np.where(np.arange(5000) % 50 == 0, "small", "hot"), "v": r.integers(0, 1200, 5000).astype(float)})
    pdf.loc[pdf.index % 97 == 0, "v"] = None
    pdf.loc[pdf.index % 211 == 0, "g"] = None
    seen, plain = [], stats.join_back

    def noted(df, *rest):
        seen.append(df)
        return plain(df, *rest)

    monkeypatch.setattr(stats, "join_back", noted)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.createDataFrame([tuple(None if x != x else x for x in t) for t in pdf.itertuples(index=False)], "id int, g string, v double")
        got = {x["id"]: x["r"] for x in average_ranks(rows, "v", ["g"], "r").collect()}
        parts = seen[0].filter("g = 'hot'").select("__part").distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = dict(zip(pdf["id"], pdf.groupby("g", dropna=False)["v"].rank(method="average", na_option="top"), strict=True))
    assert got == want and parts > 2


def test_running_sums_without_a_group(spark):
    rows = spark.createDataFrame([("b", 3), ("a", 2), ("d", 5), ("c", 4)], "k string, n int")
    got = {x["k"]: x["before"] for x in with_before(rows, [], "k", F.col("n")).collect()}
    assert got == {"a": 0, "b": 2, "c": 5, "d": 9}
    assert with_before(rows.limit(0), [], "k", F.col("n")).count() == 0


def test_describe_columns(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, 3.0, 10.0, None], "b": [5, 5, 5, 5, 5]})
    got = {r["column"]: r for r in describe_columns(spark.createDataFrame(pdf), ["a", "b"]).collect()}
    assert got["a"]["non_null"] == 4 and got["a"]["p50"] == 2.5 and got["b"]["std"] == 0.0
    assert got["a"]["std"] == pytest.approx(pdf["a"].std())
