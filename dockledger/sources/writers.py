"""Writing snapshots and reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Published column names of the slim extract, in order.
SLIM_COLUMNS = {
    "fill_dc": "FILL_DC_CD",
    "xdock": "XDOCK",
    "year": "YEAR",
    "month": "MONTH",
    "cost_per_stop": "cost per stop",
    "normalized_cost": "normalized_cost",
    "benchmark_conservative": "Cleansheet Cost Per Stop Conservative",
    "benchmark_aggressive": "Cleansheet Cost Per Stop Aggressive",
    "customer_type": "CUST_BUS_TYP_DSCR",
    "customer_name": "CUST_ACCT_NAM",
    "geography_multiplier": "GEOGRAPHY_MULTIPLIER",
    "density_multiplier": "miles_per_stop_norm_multiplier_qt",
    "shipment_multiplier": "shipment_norm_multiplier_qt",
    "geo_mean": "geo_mean",
}


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> str:
    """S7."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def write_csv(df: DataFrame, path: str, compression: str = "none", mode: str = "overwrite") -> str:
    """A folder of CSV parts, each with a header."""
    df.write.mode(mode).option("header", True).option("compression", compression).csv(path)
    return path


def slim_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The published columns that are present, and the names of those missing."""
    present = [F.col(c).alias(shown) for c, shown in SLIM_COLUMNS.items() if c in df.columns]
    return df.select(*present), [shown for c, shown in SLIM_COLUMNS.items() if c not in df.columns]


def write_slim_extract(df: DataFrame, path: str) -> list[str]:
    """Gzip CSV of the published columns; returns the missing ones."""
    slim, missing = slim_columns(df)
    write_csv(slim, path, compression="gzip")
    return missing


def write_report_set(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> dict[str, str]:
    """One folder per named result table under the run's folder."""
    write = {"parquet": write_parquet, "csv": write_csv}[fmt]
    return {name: write(df, f"{folder}/{name}") for name, df in tables.items()}
