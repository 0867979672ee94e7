"""The registry itself, and a spread of queries against SQL on the smallest data."""

import math
import os

import pytest

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
CHECKED = ["average_rank", "impute_encode", "cost_per_stop", "drop_topside_rows", "dock_monthly_cost", "geography_multiplier", "winsor_monthly", "driver_medians", "classification", "rank_stability", "top_similar_pairs"]

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def canonical(pdf):
    pdf = pdf[sorted(pdf.columns)]

    def cell(v):
        missing = v is None or (isinstance(v, float) and math.isnan(v))
        return "" if missing else repr(float(v)) if isinstance(v, float) else str(v)

    return list(pdf.columns), sorted(tuple(cell(v) for v in row) for row in pdf.astype(object).itertuples(index=False, name=None))


def test_every_cross_check_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert len(entry_points.queries()) > 150


@needs_data
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    expected = con.execute(entry_points.oracle_sql()[name]).fetchdf()
    assert canonical(entry_points.queries()[name](spark, SF).toPandas()) == canonical(expected)


@needs_data
def test_flagship_runs(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["fill_dc", "year", "month", "dc", "avg_cost_per_stop"] and df.count() > 0
