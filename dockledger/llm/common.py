"""Small pieces that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The six ASCII white-space characters end a word; every other character is part of one.
WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text; none for null. Built-in expressions only."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def word_bytes(text: str | None) -> list[bytes]:
    """The same words in Python: ``bytes`` methods know only ASCII white space and
    lower only A-Z."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


class Memo(dict):
    """A bounded memo of ``make(key)``; when full it starts anew."""

    def __init__(self, make: Callable, limit: int = 400_000, longest: int = 64) -> None:
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


_HASHES = Memo(xxhash.xxh64_digest)


def word_hashes(found: Iterable[bytes]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    return np.frombuffer(b"".join(map(_HASHES.__getitem__, found)), dtype="<u8")


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit numbers (the SplitMix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words; shorter texts count as one run."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(size, n)
    out = np.zeros(n - size + 1, dtype=np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - size + 1 + i] + np.uint64(i + 1))
    return out


def row_groups(rows: int, target: int) -> int:
    """How many groups of about ``target`` rows."""
    return max(1, -(-rows // target))
