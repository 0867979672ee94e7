"""Session settings the operators are designed for."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution splits hot join partitions and coalesces small ones. The
# operators keep hot keys on the probe side of joins so that it can do both.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(app_name: str = "dockledger", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session; ``conf`` overrides the defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_WRITTEN: list[str] = []


@cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="dockledger-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names. Only a session whose executors run in
    the driver's own process may do without one and gets a temporary folder, which is
    removed at exit; on a cluster each executor would write to its own disk."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or _local_folder()).rstrip("/")


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, removed by ``release_tables``."""
    path = f"{shared_folder(spark)}/dockledger/{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def release_tables(spark: SparkSession) -> int:
    """Remove the intermediate tables this process wrote, once no DataFrame that reads
    them is needed any more; runs at exit too, if the session still lives. Returns how
    many were removed."""
    return sum([_remove(spark, _WRITTEN.pop()) for _ in range(len(_WRITTEN))])


def _remove(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _release_at_exit() -> None:
    active = SparkSession.getActiveSession()
    if _WRITTEN and active is not None and not active.sparkContext._jsc.sc().isStopped():
        release_tables(active)


def partitions_of(spark: SparkSession, rows: int, each: int = 250_000) -> int:
    """The session's shuffle partitions, or more, if one would get more than ``each`` of
    ``rows`` rows: a session's number need not grow with its tables."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def spread(df: DataFrame, *columns: str, rows: int = 0) -> DataFrame:
    """``df`` hashed by ``columns`` over all of the session's shuffle partitions, or as many
    as ``rows`` rows need. Adaptive execution merges partitions by the bytes they read, and
    leaves these alone: for steps that form much wider rows in memory than they read."""
    return df.repartition(partitions_of(df.sparkSession, rows), *columns)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a statement go when it ends. Without this they stay until the
    driver happens to collect its garbage, which a large table does not bring about."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def settled(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` gives, written; what it wrote on the way is removed.
    Nothing but its result may go on to read those tables."""
    first = len(_WRITTEN)
    out = cut_lineage(build())
    passed = _WRITTEN[first:-1]
    del _WRITTEN[first:-1]
    for path in passed:
        _remove(spark, path)
    return out


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to a new folder in the shared checkpoint storage and read it
    back.

    Meant for reduced tables that several later steps read: the steps above run
    once, whatever columns the later steps prune, lost executors do not repeat
    them, and the known file size lets Spark decide on broadcasts. The shuffle files of
    those steps go at once.
    """
    path = scratch_path(df.sparkSession)
    with _shuffles_removed(df.sparkSession):
        df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)
