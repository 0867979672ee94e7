"""Named queries: a DataFrame plan and, where SQL can say it, its cross-check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dockledger.plans.bindings_sql import with_tables

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    plan: Plan
    sql: str | None


QUERIES: dict[str, Query] = {}

# Doubles are rounded to multiples of 2^-20 (about 1e-6) on both sides. Scaling by
# a power of two is exact, and decimal amounts do not fall on the ties of this
# grid, where two engines that differ in the last bit would round apart.
GRID = 1048576.0


def on_grid(c: str) -> Column:
    """A double rounded for comparison; adding 0 turns -0 into 0."""
    return F.round(F.col(c).cast("double") * GRID) / GRID + F.lit(0.0)


def on_grid_sql(c: str) -> str:
    return f"ROUND(CAST({c} AS DOUBLE) * {GRID:.0f}e0) / {GRID:.0f}e0 + 0e0"


def query(key: str, sql: str | None = None, plain: str = "", rounded: str = "", text: str = "") -> Callable[[Plan], Plan]:
    """Register a plan. Output columns are listed once for both sides: ``plain``
    as they are, ``rounded`` doubles on the common grid, ``text`` as strings."""
    plain_cols, rounded_cols, text_cols = plain.split(), rounded.split(), text.split()

    def shape(df: DataFrame) -> DataFrame:
        return df.select(
            *plain_cols,
            *[on_grid(c).alias(c.strip("`")) for c in rounded_cols],
            *[F.col(c).cast("string").alias(c) for c in text_cols],
        )

    def register(plan: Plan) -> Plan:
        shaped = bool(plain_cols or rounded_cols or text_cols)
        full = None
        if sql is not None:
            full = sql
            if shaped:
                columns = [
                    *plain_cols,
                    *[f"{on_grid_sql(c)} AS {c}" for c in rounded_cols],
                    *[f"CAST({c} AS VARCHAR) AS {c}" for c in text_cols],
                ]
                full = f"SELECT {', '.join(columns)} FROM ({sql.strip()}) result"
            full = with_tables(full)
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = Query((lambda spark, sf: shape(plan(spark, sf))) if shaped else plan, full)
        return plan

    return register
