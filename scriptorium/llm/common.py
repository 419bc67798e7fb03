"""Helpers shared by the training-data operators: reading tables and the shared folder."""

from __future__ import annotations

import gc
import sys
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only used on one machine, where the session names no spark.checkpoint.dir.
LOCAL_SHARED = "/tmp/checkpoints"
#: A key with more than this share of all rows is hot; so there are fewer hot keys than its inverse.
HOT_SHARE = 1 / 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share, as the cluster names it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or f"file://{LOCAL_SHARED}").rstrip("/")


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back.

    It cuts the lineage the way checkpoint() does, but keeps a columnar table, so
    that later readers take only the columns they need; a lost executor loses nothing.
    """
    spark = df.sparkSession
    path = f"{folder or work_dir(spark)}/{name}"
    df.write.option("compression", "zstd").mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: The list to which work_dir() adds folders, of this thread of control.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def gathered() -> Iterator[list[str]]:
    """The work folders made inside, for release()."""
    found: list[str] = []
    before = _made.set(found)
    try:
        yield found
    finally:
        _made.reset(before)


def work_dir(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/scriptorium-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def release(spark: SparkSession, folders: list[str]) -> None:
    """Deletes work folders; nothing may read them any more."""
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, folders):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """Joins many rows to the one row of their keys, hot keys without a shuffle.

    size: a column of `one`, at least the number of rows of `many` with those keys; total:
    at least its sum. The hot keys are fewer than 1 / HOT_SHARE and are broadcast; the
    rest meets by a shuffle in which no key holds more than that share. how: inner or left.
    """
    limit = max(1, int(total * HOT_SHARE))
    hot = F.broadcast(one.filter(F.col(size) > limit))
    return many.join(hot, keys).unionByName(many.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(one.filter(F.col(size) <= limit), keys, how))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Long texts go to Python in batches of fewer rows, unless the session asks for other sizes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def worker_cache(owner: str) -> dict:
    """What this Python worker keeps for one operator from task to task; what it kept for another goes."""
    held = sys.__dict__.setdefault("_scriptorium_kept", {})
    if list(held) != [owner]:
        held.clear()
        gc.enable()
        gc.collect()
        pa.default_memory_pool().release_unused()
    return held.setdefault(owner, {})
