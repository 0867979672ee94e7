"""Reading tables, Parquet and CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan_table(spark: SparkSession, name: str, **options: str) -> DataFrame:
    """A whole catalog table or view; with ``format=...`` any connector
    (JDBC and warehouse connectors push filters and columns down)."""
    if "format" in options:
        fmt = options.pop("format")
        return spark.read.format(fmt).options(**{"dbtable": name, **options}).load()
    return spark.table(name)


def scan_filtered(
    df: DataFrame, time_column: str, since: str, limit: int | None = None, order_cols: Sequence[str] = ()
) -> DataFrame:
    """Rows at or after ``since``; the filter reaches the scan. A limit needs
    an order to mean the same rows every time."""
    out = df.filter(F.col(time_column) >= F.to_timestamp(F.lit(since)))
    if limit is None:
        return out
    if not order_cols:
        raise ValueError("a limited scan needs order_cols")
    return out.orderBy(*order_cols).limit(limit)


def scan_distinct(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """S3: distinct combinations of the given columns."""
    return df.select(*columns).distinct()


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S4."""
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, partitions: int | None = None) -> DataFrame:
    """CSV with a header; ``.gz`` by suffix.

    Without a schema the types are inferred, which reads the files twice. A gzip
    file is one task when read: give ``partitions`` to spread what follows.
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    return df.repartition(partitions) if partitions else df


def source(
    spark: SparkSession, table: str | None = None, path: str | None = None, default: str | None = None, **csv: object
) -> DataFrame:
    """A table wins over a path, a path over the default path."""
    if table:
        return scan_table(spark, table)
    chosen = path or default
    if not chosen:
        raise ValueError("no table, path or default given")
    if chosen.lower().rstrip("/").endswith(".parquet"):
        return read_parquet(spark, chosen)
    return read_csv(spark, chosen, **csv)


def with_load_order(df: DataFrame) -> DataFrame:
    """``load_file`` and ``load_row`` of rows read from Parquet files: an order
    that identifies each row, for sources without a natural one."""
    return df.select("*", F.col("_metadata.file_path").alias("load_file"), F.col("_metadata.row_index").alias("load_row"))
