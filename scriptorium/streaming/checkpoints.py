"""Leases and upload checkpoints of jobs as keyed state over a stream of their events.

Events (job_id, at, seq, kind, value): `at` in microseconds, `seq` breaks ties. Kinds:
claim, heartbeat, upload_started, upload_task (value: task id), version_created (value:
version id), checkpoint_cleared, completed, failed, retried. Others count and do nothing.

* claim: a queued job runs, one attempt more, with a lease. heartbeat: a running job's
  lease begins anew. A running job whose lease has ended before an event is queued again
  and counts as recovered; while it runs, claims of others do nothing.
* upload_started marks that an upload may have happened. Started once more while the mark
  stands without a task id, nobody knows whether there is a version already: the job
  fails as ambiguous. upload_task and version_created replace mark and version, whatever
  the job's status, since an answer may come after its lease; checkpoint_cleared takes both.
* completed and failed end a running job; retried queues one that failed, its checkpoint
  kept, so an upload is gone on with and not repeated.

Null kinds do nothing; null jobs are one job. Events with equal `at` and `seq` go by kind and
value, nulls first. However the events are split into batches, in order, the states are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

LEASE = 900_000_000
STARTED = "started"
FIELDS = ("status", "error_code", "attempt", "lease_until", "task_id", "version_id", "recovered", "n_events")
STATE = "status string, error_code string, attempt long, lease_until long, task_id string, version_id string, recovered long, n_events long"
NEW = ("queued", None, 0, None, None, None, 0, 0)


def expired(state: tuple, now: int) -> tuple:
    """The state of a job once its lease, if any, has been looked at."""
    status, error, attempt, until, task, version, recovered, n = state
    if status == "running" and until is not None and until < now:
        return "queued", error, attempt, None, task, version, recovered + 1, n
    return state


def after(state: tuple, at: int, kind: str | None, value: str | None, lease: int = LEASE) -> tuple:
    """The state of a job after one event."""
    status, error, attempt, until, task, version, recovered, n = expired(state, at)
    if kind == "claim" and status == "queued":
        status, error, attempt, until = "running", None, attempt + 1, at + lease
    elif kind == "heartbeat" and status == "running":
        until = at + lease
    elif kind == "upload_started" and status == "running":
        if task == STARTED:
            status, error, until = "failed", "ambiguous", None
        elif task is None:
            task = STARTED
    elif kind == "upload_task":
        task = value
    elif kind == "version_created":
        version = value
    elif kind == "checkpoint_cleared":
        task = version = None
    elif kind in ("completed", "failed") and status == "running":
        status, error, until = kind, "failed" if kind == "failed" else None, None
    elif kind == "retried" and status == "failed":
        status, error = "queued", None
    return status, error, attempt, until, task, version, recovered, n + 1


def _order(e) -> tuple:
    return e.at, e.seq, e.kind is not None, e.kind or "", e.value is not None, e.value or ""


def _row(key: tuple, state: tuple) -> Row:
    return Row(job_id=key[0], **dict(zip(FIELDS, state)))


class JobState(StatefulProcessor):
    """One small state a job; with timers, a lease that ends without an event is seen by the watermark."""

    def __init__(self, lease: int, timers: bool):
        self.lease, self.timers = lease, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("job", STATE)

    def _put(self, key, before: tuple, state: tuple) -> Iterator[Row]:
        self.state.update(state)
        if self.timers and before[3] != state[3]:
            if before[3] is not None:
                self.handle.deleteTimer(before[3] // 1000 + 1)
            if state[3] is not None:
                self.handle.registerTimer(state[3] // 1000 + 1)
        yield _row(key, state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = state = tuple(self.state.get()) if self.state.exists() else NEW
        for e in sorted(rows, key=_order) if self.timers else rows:  # a table comes in order
            state = after(state, e.at, e.kind, e.value, self.lease)
        yield from self._put(key, before, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        before = tuple(self.state.get()) if self.state.exists() else NEW
        state = expired(before, timerValues.getCurrentWatermarkInMs() * 1000)
        if state != before:
            self.state.update(state)
            yield _row(key, state)

    def close(self) -> None:
        pass


def job_states(events: DataFrame, lease: int = LEASE, late: str = "10 minutes") -> DataFrame:
    """The state of each job (job_id, FIELDS) after its events.

    On a table: one row a job. Its events arrive sorted by the shuffle that the grouping needs anyhow,
    so a job's events are never together in memory. On a stream: a row for each job of a
    batch, and for each lease that the watermark, `late` behind the newest event, has passed;
    jobs.latest() by n_events and recovered keeps the last. Events that the watermark has reached
    when their batch begins are dropped. The state store must be RocksDB's.
    """
    events = events.select("job_id", "at", "seq", "kind", "value")
    out = StructType([events.schema["job_id"], *StructType.fromDDL(STATE).fields])
    if events.isStreaming:
        timed = events.withColumn("time", F.timestamp_micros("at")).withWatermark("time", late)
        return timed.groupBy("job_id").transformWithState(JobState(lease, True), out, "Update", "EventTime")
    _ = events.sparkSession.streams.active  # the session's streams begin here, and with them what state stores report to
    nulls_first = [F.asc_nulls_first(c) for c in ("job_id", "at", "seq", "kind", "value")]
    return events.repartition("job_id").sortWithinPartitions(*nulls_first).groupBy("job_id").transformWithState(JobState(lease, False), out, "Update", "None")
