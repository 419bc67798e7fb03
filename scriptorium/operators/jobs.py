"""The durable job relation as pure transitions (jobs, now) -> jobs, and keyed upserts.

Time is always an argument, in epoch seconds. One writer applies a transition at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE, TERMINAL, CLEARABLE = ("queued", "running", "retry_wait"), ("completed", "failed", "needs_review", "cancelled"), ("failed", "cancelled")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Upsert as append and compaction: the last row of each key, by partial aggregates before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(order).isNotNull(), order)).alias("_last"))
    return last.select(*(c if c in keys else F.col(f"_last.`{c}`").alias(c) for c in rows.columns))


def last_n(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def backoff(attempt: Column) -> Column:
    return F.least(F.lit(300.0), 5 * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1)))


def fail_or_retry(jobs: DataFrame, failures: DataFrame, now: float) -> DataFrame:
    """failures (job_id, code, message, retryable): retried while attempts are left, else failed."""
    j = jobs.join(failures, "job_id", "left")
    hit = F.col("code").isNotNull()
    again = hit & F.col("retryable") & (F.col("attempt") < F.col("max_attempts"))
    state = lambda old: F.when(again, "retry_wait").when(hit, "failed").otherwise(F.col(old))
    return j.withColumns(
        {
            "status": state("status"),
            "phase": state("phase"),
            "next_run_at": F.when(again, F.lit(now) + backoff(F.col("attempt"))).when(hit, F.lit(now)).otherwise(F.col("next_run_at")),
            "lease_until": F.when(~hit, F.col("lease_until")),
            "completed_at": F.when(again, F.lit(None)).when(hit, F.lit(now)).otherwise(F.col("completed_at")),
            "error_code": F.coalesce("code", "error_code"),
            "error_message": F.coalesce(F.left("message", F.lit(2000)), "error_message"),
        }
    ).select(jobs.columns)


def recover(jobs: DataFrame, now: float, all_running: bool = False) -> DataFrame:
    """Jobs whose lease ran out are queued again; at a start all running ones are."""
    lost = (F.col("status") == "running") & (F.lit(all_running) | (F.col("lease_until") < now))
    lost = F.coalesce(lost, F.lit(False))
    return jobs.withColumns({"phase": F.when(lost, "recovered").otherwise(F.col("phase")), "next_run_at": F.when(lost, F.lit(now)).otherwise(F.col("next_run_at")), "lease_until": F.when(~lost, F.col("lease_until")), "status": F.when(lost, "queued").otherwise(F.col("status"))})


def due(jobs: DataFrame, now: float, n: int = 1) -> DataFrame:
    """The jobs to claim next, first due first."""
    return jobs.filter(F.col("status").isin("queued", "retry_wait") & (F.col("next_run_at") <= now)).orderBy("next_run_at", "created_at", "job_id").limit(n)


def claim(jobs: DataFrame, now: float, lease: float = 900.0) -> DataFrame:
    """jobs after one claim: leases that ran out are taken back first."""
    back = recover(jobs, now)
    mine = due(back, now).select("job_id", F.lit(True).alias("mine"))
    j = back.join(F.broadcast(mine), "job_id", "left")  # one row
    return j.withColumns({"status": F.when(F.col("mine"), "running").otherwise(F.col("status")), "phase": F.when(F.col("mine"), "starting").otherwise(F.col("phase")), "attempt": F.col("attempt") + F.when(F.col("mine"), 1).otherwise(0), "lease_until": F.when(F.col("mine"), F.lit(now + lease)).otherwise(F.col("lease_until"))}).drop("mine")


def heartbeat(jobs: DataFrame, alive: DataFrame, now: float, lease: float = 900.0) -> DataFrame:
    j = jobs.join(alive.select("job_id", F.lit(True).alias("beat")), "job_id", "left")
    on = F.coalesce(F.col("beat") & (F.col("status") == "running"), F.lit(False))
    return j.withColumn("lease_until", F.when(on, F.lit(now + lease)).otherwise(F.col("lease_until"))).drop("beat")


def updated(rows: DataFrame, changes: DataFrame, key: str = "job_id") -> DataFrame:
    """changes (key, some columns): values that are not null replace those of the row."""
    names = [c for c in changes.columns if c != key]
    j = rows.join(changes.select(key, *(F.col(c).alias(f"_{c}") for c in names)), key, "left")
    return j.withColumns({c: F.coalesce(f"_{c}", c) for c in names}).select(rows.columns)


def enqueue(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (document_id, pos) -> those that make a new job: the first of a document without an active job."""
    first = requests.filter("document_id > 0").groupBy("document_id").agg(F.min("pos").alias("pos"))
    return first.join(jobs.filter(F.col("status").isin(*ACTIVE)).select("document_id"), "document_id", "left_anti")


def retryable(jobs: DataFrame, open_conflicts: DataFrame) -> DataFrame:
    """Terminal jobs that may be run again by hand."""
    review = F.coalesce((F.col("status") == "needs_review") & (F.col("phase") == "ocr_conflict"), F.lit(False))
    busy = jobs.filter(F.col("status").isin(*ACTIVE)).select("document_id")
    return jobs.filter(F.col("status").isin(*TERMINAL) & ~review).join(open_conflicts.select("document_id"), "document_id", "left_anti").join(busy, "document_id", "left_anti")


def ended(jobs: DataFrame, ids: DataFrame, status: str, now: float, phase: str | None = None, only: tuple[str, ...] = ()) -> DataFrame:
    """Finish, cancel (only queued or waiting jobs) or send to review."""
    j = jobs.join(ids.select("job_id", F.lit(True).alias("hit")), "job_id", "left")
    on = F.coalesce(F.col("hit") & (F.col("status").isin(*only) if only else F.lit(True)), F.lit(False))
    return j.withColumns({"phase": F.when(on, phase or status).otherwise(F.col("phase")), "completed_at": F.when(on, F.lit(now)).otherwise(F.col("completed_at")), "lease_until": F.when(~on, F.col("lease_until")), "status": F.when(on, status).otherwise(F.col("status"))}).drop("hit")


def cancelled(jobs: DataFrame, ids: DataFrame, now: float) -> DataFrame:
    return ended(jobs, ids, "cancelled", now, only=("queued", "retry_wait"))


def cleared(jobs: DataFrame, statuses: list[str], children: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Deletes failed or cancelled jobs and what hangs on them."""
    gone = jobs.filter(F.col("status").isin([s for s in statuses if s in CLEARABLE])).select("job_id")
    return jobs.join(gone, "job_id", "left_anti"), {k: c.join(gone, "job_id", "left_anti") for k, c in children.items()}


def invariants(jobs: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Documents with more than one active job or open conflict; empty when all is well."""
    twice = lambda df, what: df.groupBy("document_id").count().filter("count > 1").select("document_id", F.lit(what).alias("what"))
    return twice(jobs.filter(F.col("status").isin(*ACTIVE)), "active job").union(twice(conflicts.filter("status = 'open'"), "open conflict"))


def resolution(conflicts: DataFrame, requests: DataFrame, live: DataFrame) -> DataFrame:
    """What becomes of requests (id, choice) on conflicts, given live texts (document_id, text, meaningful, tags)."""
    r = requests.join(conflicts, "id", "left").join(live, "document_id", "left")
    error = (
        F.when(F.coalesce(F.col("status") != "open", F.lit(True)), "conflict_not_open")
        .when(F.col("resolution").isNotNull(), "conflict_claimed")
        .when((F.col("choice") == "keep_existing") & ~F.coalesce("meaningful", F.lit(False)), "no_existing_ocr")
        .when((F.col("choice") == "use_generated") & ~F.coalesce(F.col("text") == F.col("existing_text"), F.lit(False)), "conflict_source_changed")
    )
    r = r.withColumn("error", error)
    return r.select("id", "choice", "error", F.when(F.col("error").isNull(), "resolved").otherwise(F.coalesce("status", F.lit("missing"))).alias("new_status"), F.when(F.col("error").isNull(), F.filter("tags", lambda t: ~F.coalesce(t == F.col("conflict_tag_id"), F.lit(False)))).alias("new_tags"))


def publish_action(meaningful: Column, checkpoint: Column, keep: Column, ours: Column) -> Column:
    """How transcribed text is published. checkpoint: none, started, task, version_latest, version_newer, version_gone.

    meaningful: the document has text of its own. A version is used if the preference is to
    keep it, or if an upload has begun, whatever the preference says now. A version that is
    gone counts as none from there on.
    """
    return (
        F.when(~meaningful, "replace_in_place")
        .when(~keep & (checkpoint == "none"), "replace_existing")
        .when(checkpoint == "version_latest", "write_to_version")
        .when(checkpoint == "version_newer", "retry_source_changed")
        .when(ours, "reuse_version")
        .when(checkpoint == "started", "stop_ambiguous")
        .when(checkpoint == "task", "poll_task")
        .otherwise("upload_version")
    )


def get_or_create(existing: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name) of each requested name: by case-insensitive match, else with new ids after the largest, in order of the names.

    New names are numbered within ranges of names, on top of the number of names in the
    ranges before; only these sums meet in one place.
    """
    key = F.lower("name")
    wanted = names.select("name", key.alias("k")).groupBy("k").agg(F.min("name").alias("name"))
    have = existing.select("id", F.col("name").alias("old"), key.alias("k")).groupBy("k").agg(F.min("id").alias("id"), F.min_by("old", "id").alias("old"))
    both = wanted.join(have, "k", "left")
    new = both.filter("id is null").withColumn("part", F.substring("k", 1, 2))
    within = new.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("k")))
    sums = new.groupBy("part").agg(F.count("*").alias("size"))
    before = sums.withColumn("before", F.sum("size").over(Window.orderBy("part")) - F.col("size")).select("part", "before")  # one row a range
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    made = within.join(before, "part").crossJoin(F.broadcast(top)).select((F.col("top") + F.col("before") + F.col("n")).alias("id"), "name", F.lit(True).alias("created"))  # top is one row
    return both.filter("id is not null").select("id", F.col("old").alias("name"), F.lit(False).alias("created")).union(made)


def bulk_edit(documents: DataFrame, ids: DataFrame, method: str, value: int) -> DataFrame:
    """add_tag, remove_tag, set_correspondent or set_document_type on a set of documents."""
    d = documents.join(ids.select("id", F.lit(True).alias("hit")).distinct(), "id", "left")
    hit = F.coalesce("hit", F.lit(False))
    column, new = {
        "add_tag": ("tags", F.array_union("tags", F.array(F.lit(value).cast("long")))),
        "remove_tag": ("tags", F.array_remove("tags", value)),
        "set_correspondent": ("correspondent", F.lit(value).cast("long")),
        "set_document_type": ("document_type", F.lit(value).cast("long")),
    }[method]
    return d.withColumn(column, F.when(hit, new).otherwise(F.col(column))).select(documents.columns)


def document_states(states: DataFrame, seen: DataFrame, now: float) -> DataFrame:
    """states (document_id, modified, source_hash, last_job_id, last_status, processed_at) after rows seen (the same, without the time): each replaces the state of its document."""
    new = seen.withColumn("processed_at", F.lit(now)).select(states.columns)
    return states.join(new.select("document_id"), "document_id", "left_anti").select(states.columns).unionByName(new)


def document_statuses(states: DataFrame, changes: DataFrame, now: float) -> DataFrame:
    """states after changes (document_id, status); documents without state stay without."""
    j = states.join(changes, "document_id", "left")
    hit = F.col("status").isNotNull()
    return j.withColumns({"last_status": F.coalesce("status", "last_status"), "processed_at": F.when(hit, F.lit(now)).otherwise(F.col("processed_at"))}).select(states.columns)
