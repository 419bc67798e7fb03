"""Incremental discovery: documents that are new or changed since they were last seen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def changed(documents: DataFrame, state: DataFrame) -> DataFrame:
    """documents (id, modified) without state, or whose modified differs; two nulls are equal."""
    seen = state.select(F.col("document_id").alias("id"), F.col("modified").alias("seen_modified"), F.lit(True).alias("seen"))
    both = documents.join(seen, "id", "left")
    return both.filter(F.col("seen").isNull() | ~F.col("modified").eqNullSafe(F.col("seen_modified"))).drop("seen", "seen_modified")


STATE = "document_id long, modified string, batch long"
#: After so many batches the state is written whole, one row a document.
COMPACT_EVERY = 50


def _last_whole(spark: SparkSession, state_path: str, number: int) -> int:
    """Number of the last batch before this one that the whole state was written for; -1: none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{state_path}/whole")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    named = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
    return max((n for n in (int(x.removeprefix("batch=")) for x in named if x.startswith("batch=")) if n < number), default=-1)


def state_before(spark: SparkSession, state_path: str, number: int) -> DataFrame:
    """(document_id, modified, batch) as it was before a batch: the last whole state and the changes since."""
    whole = _last_whole(spark, state_path, number)
    changes = [f"{state_path}/changes/batch={n}" for n in range(whole + 1, number)]
    folders = ([f"{state_path}/whole/batch={whole}"] if whole >= 0 else []) + changes
    rows = spark.read.schema(STATE).parquet(*folders) if folders else spark.createDataFrame([], STATE)
    return rows.groupBy("document_id").agg(F.max_by("modified", "batch").alias("modified"), F.max("batch").alias("batch"))


def _enqueued(rows: DataFrame, number: int, state_path: str, enqueue: Callable[[DataFrame, int], None], compact_every: int) -> None:
    """One batch of listed documents (id, modified and more): enqueues those that changed() leaves and keeps their state."""
    spark = rows.sparkSession
    newest = rows.groupBy("id").agg(F.max("modified").alias("modified"))
    found = changed(newest, state_before(spark, state_path, number)).withColumn("batch", F.lit(number).cast("long"))
    enqueue(found.orderBy(F.desc("modified"), "id"), number)
    found.select(F.col("id").alias("document_id"), "modified", "batch").write.mode("overwrite").parquet(f"{state_path}/changes/batch={number}")
    if number % compact_every == compact_every - 1:
        state_before(spark, state_path, number + 1).write.mode("overwrite").parquet(f"{state_path}/whole/batch={number}")


def discover(spark: SparkSession, folder: str, schema: StructType, state_path: str, checkpoint: str, enqueue: Callable[[DataFrame, int], None], compact_every: int = COMPACT_EVERY) -> None:
    """Runs all files of a change feed through changed(), newest first, and keeps the new state.

    State is written for what was enqueued, so a document that keeps failing is not
    enqueued at every run. Batches are numbered and each has a folder of its own, so a
    repeated batch replaces what it wrote before. Every `compact_every` batches the state
    is written whole, so a batch reads one whole state and fewer changes than that; folders
    of earlier batches are not read any more and can be removed.
    """

    def batch(rows: DataFrame, number: int) -> None:
        _enqueued(rows, number, state_path, enqueue, compact_every)

    feed = spark.readStream.schema(schema).parquet(folder)
    feed.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(batch).start().awaitTermination()


def follow(
    polls: DataFrame, state_path: str, checkpoint: str, enqueue: Callable[[DataFrame, int], None], failed: Callable[[DataFrame, int], None], interval: str = "60 seconds", compact_every: int = COMPACT_EVERY, once: bool = False
) -> StreamingQuery:
    """Runs a stream of polls (sources.polling) through changed(), as discover() does, and gives its failures to failed().

    failed gets (poll, page, error) of each batch with an error, for a notice of the outage. The query polls
    every `interval`; with once, it polls a single time and ends.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()  # a page at most, read once
        try:
            errors = rows.filter("error is not null").select("poll", "page", "error")
            if not errors.isEmpty():
                failed(errors, number)
            _enqueued(rows.filter("error is null"), number, state_path, enqueue, compact_every)
        finally:
            rows.unpersist()

    stream = polls.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    query = (stream.trigger(once=True) if once else stream.trigger(processingTime=interval)).start()
    if once:
        query.awaitTermination()
    return query


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of job events by type and window of event time; works on streams and tables."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
