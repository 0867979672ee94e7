"""Carrier similarity over standardized profiles."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockledger.functions.stats import scalars

# Workers get the helpers below with the task, wherever the package is installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Carriers per block of the blocked comparison; a task sees two blocks.
BLOCK_ROWS = 2000


def standard_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null as 0, then (x - mean) / population deviation; constants become 0."""
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    stats = {f"m{i}": F.avg(c) for i, c in enumerate(columns)} | {f"s{i}": F.stddev_pop(c) for i, c in enumerate(columns)}
    s = scalars(filled, **stats)
    return filled.withColumns(
        {
            # a deviation that is rounding noise counts as constant
            c: F.when(
                s[f"s{i}"] > F.abs(s[f"m{i}"]) * 1e-12, (F.col(c) - s[f"m{i}"]) / s[f"s{i}"]
            ).otherwise(0.0)
            for i, c in enumerate(columns)
        }
    )


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    matrix = np.array(vectors.tolist(), dtype="float64")
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _blocks(df: DataFrame, key: str, columns: Sequence[str], block_rows: int) -> DataFrame:
    """Each row once per block pair its block takes part in.

    The number of blocks follows the number of rows, so that a pair of blocks
    stays small however many carriers there are.
    """
    rows = df.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("vec")
    )
    n_blocks = rows.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(float(block_rows)))).cast("int")).scalar()
    placed = rows.withColumn("n_blocks", n_blocks).withColumn("block", F.pmod(F.xxhash64("id"), "n_blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    return placed.select("id", "vec", "block", other.alias("other")).select(
        "id", "vec", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")
    )


def _pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Similarities of the pairs one block pair is responsible for."""
    lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
    left, right = pdf[pdf["block"] == lo], pdf[pdf["block"] == hi]
    sims = np.clip(_unit_rows(left["vec"]) @ _unit_rows(right["vec"]).T, -1.0, 1.0) if len(left) and len(right) else np.empty((0, 0))
    a, b = left["id"].to_numpy(dtype=object), right["id"].to_numpy(dtype=object)
    i, j = np.triu_indices(len(a), k=1) if lo == hi else np.indices(sims.shape).reshape(2, -1)
    first = np.where(a[i] < b[j], a[i], b[j]) if len(i) else a[i]
    second = np.where(a[i] < b[j], b[j], a[i]) if len(i) else b[j]
    return pd.DataFrame({"a": first, "b": second, "similarity": sims[i, j] if len(i) else np.empty(0)})


def carrier_pairs(df: DataFrame, key: str, columns: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Cosine similarity of every unordered pair, ``a < b``.

    The result itself has one row per pair; use ``top_similar_pairs`` where only
    the best ones are wanted.
    """
    return _blocks(df, key, columns, block_rows).groupBy("lo", "hi").applyInPandas(_pairs, "a string, b string, similarity double")


def cosine_similarity(df: DataFrame, key: str, columns: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The full matrix in long form; a zero vector is similar to nothing."""
    pairs = carrier_pairs(df, key, columns, block_rows)
    both = pairs.select(F.inline(F.array(F.struct("a", "b", "similarity"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))))
    nonzero = sum((F.abs(F.col(c)) for c in columns), F.lit(0.0)) > 0
    diagonal = df.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("a"), F.col(key).alias("b"), nonzero.cast("double").alias("similarity")
    )
    return both.unionByName(diagonal)


def top_similar_pairs(
    df: DataFrame, key: str, columns: Sequence[str], n: int = 15, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The most similar pairs. Each block pair hands on its own best ``n``
    only, which is enough to hold the overall best ``n``."""

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = _pairs(pdf)
        pairs["similarity"] = pairs["similarity"].round(4)
        return pairs.sort_values(["similarity", "a", "b"], ascending=[False, True, True]).head(n)

    tops = _blocks(df, key, columns, block_rows).groupBy("lo", "hi").applyInPandas(best, "a string, b string, similarity double")
    return tops.orderBy(F.desc("similarity"), "a", "b").limit(n)
