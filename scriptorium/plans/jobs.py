"""Queries over the job relation: orders stand for jobs, events for job events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.operators import jobs as ops
from scriptorium.plans.reporting import JOBS_SQL, jobs
from scriptorium.sources.tables import table
from scriptorium.streaming import discovery

NOW = 900_000_000.0


def _state(spark, sf_dir):
    """Jobs with the columns of the state machine, spread over all states by their keys."""
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ("queued", "running", "retry_wait", "completed", "failed", "needs_review", "cancelled"))), (k % 7 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        k.alias("job_id"), F.col("o_custkey").alias("document_id"), status.alias("status"),
        F.when((status == "needs_review") & (k % 3 == 0), "ocr_conflict").otherwise(status).alias("phase"),
        (k % 4).cast("int").alias("attempt"), F.lit(3).alias("max_attempts"), (F.lit(NOW) + (k * 37) % 1000 - 500).alias("next_run_at"),
        F.when(status == "running", F.lit(NOW) + (k * 53) % 1000 - 500).alias("lease_until"), F.when(status.isin("completed", "failed", "cancelled"), F.lit(NOW) - 1).alias("completed_at"),
        F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("string").alias("error_message"), (k * 1.0).alias("created_at"),
    )


STATE_SQL = """SELECT o_orderkey AS job_id, o_custkey AS document_id,
 ['queued','running','retry_wait','completed','failed','needs_review','cancelled'][o_orderkey % 7 + 1] AS status,
 CASE WHEN o_orderkey % 7 = 5 AND o_orderkey % 3 = 0 THEN 'ocr_conflict' ELSE ['queued','running','retry_wait','completed','failed','needs_review','cancelled'][o_orderkey % 7 + 1] END AS phase,
 (o_orderkey % 4)::INTEGER AS attempt, 3 AS max_attempts, 900000000.0::DOUBLE + (o_orderkey * 37) % 1000 - 500 AS next_run_at,
 CASE WHEN o_orderkey % 7 = 1 THEN 900000000.0::DOUBLE + (o_orderkey * 53) % 1000 - 500 END AS lease_until,
 CASE WHEN o_orderkey % 7 IN (3, 4, 6) THEN 899999999.0::DOUBLE END AS completed_at, o_orderkey * 1.0::DOUBLE AS created_at FROM orders"""


def recent_jobs_topk(spark, sf_dir):
    return jobs(spark, sf_dir).select("job_id", "status", "created_at").orderBy(F.desc("created_at"), F.desc("job_id")).limit(100)


def job_page(spark, sf_dir):
    """The third page of 50 jobs, newest first."""
    return jobs(spark, sf_dir).select("job_id", "status", "created_at").orderBy(F.desc("created_at"), F.desc("job_id")).offset(100).limit(50)


def latest_event_per_job(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return ops.latest(e.select("event_id", "user_id", "event_type", "value", "ts"), ["user_id"], "event_id")


def last_n_events_per_job(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return ops.last_n(e, "user_id", [F.desc("event_id")], 100)


def job_detail_join(spark, sf_dir):
    """Each job with its latest line and the number of its failed ones."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), "l_linenumber", "l_returnflag", "l_linestatus")
    last = li.groupBy("job_id").agg(F.max(F.struct("l_linenumber", "l_linestatus")).alias("x"), F.count_if(F.col("l_returnflag") == "R").alias("n_failed"), F.count("*").alias("n_pages"))
    return jobs(spark, sf_dir).select("job_id", "status").join(last, "job_id", "left").select("job_id", "status", F.col("x.l_linenumber").alias("last_line"), F.col("x.l_linestatus").alias("last_status"), F.coalesce("n_failed", F.lit(0)).alias("n_failed"), F.coalesce("n_pages", F.lit(0)).alias("n_pages"))


def page_failure_summary(spark, sf_dir):
    """Per user: failed pages, the first twenty of them, whether any can be tried again."""
    e = table(spark, sf_dir, "events")
    failed = e.filter(F.col("event_id") % 5 == 0).select("user_id", "event_id", (F.col("event_id") % 2 == 0).alias("retryable"))
    counts = failed.groupBy("user_id").agg(F.count("*").alias("n_failed"), F.bool_or("retryable").alias("retryable"))
    order = Window.partitionBy("user_id").orderBy("event_id")
    least = failed.select("user_id", "event_id").withColumn("_n", F.row_number().over(order)).filter("_n <= 20")  # tasks keep twenty a user before the shuffle
    first = least.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list("event_id")), ",").alias("pages"))
    return counts.join(first, "user_id").select("user_id", "n_failed", "pages", "retryable")


def retry_backoff_schedule(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("attempt"))
    return n.select("user_id", "event_type", "attempt", ops.backoff(F.col("attempt")).alias("delay"))


def fail_or_retry(spark, sf_dir):
    s = _state(spark, sf_dir)
    hit = s.filter("status = 'running'").select("job_id", F.lit("model").alias("code"), F.lit("no answer").alias("message"), (F.col("job_id") % 2 == 0).alias("retryable"))
    return ops.fail_or_retry(s, hit, NOW).select("job_id", "status", "next_run_at", "lease_until", "completed_at", "error_code")


def expired_lease_reclaim(spark, sf_dir):
    return ops.recover(_state(spark, sf_dir), NOW).select("job_id", "status", "phase", "next_run_at", "lease_until")


def startup_recovery(spark, sf_dir):
    return ops.recover(_state(spark, sf_dir), NOW, all_running=True).groupBy("status", "phase").agg(F.count("*").alias("n"))


def claim_order(spark, sf_dir):
    return ops.due(ops.recover(_state(spark, sf_dir), NOW), NOW, 200).select("job_id", "next_run_at", "created_at")


def claimed_job(spark, sf_dir):
    return ops.claim(_state(spark, sf_dir), NOW).filter("phase = 'starting'").select("job_id", "status", "attempt", "lease_until")


def enqueue_idempotent(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_custkey").alias("pos"))
    return ops.enqueue(_state(spark, sf_dir), c.union(c)).select("document_id", "pos")


def manual_retry_candidates(spark, sf_dir):
    conflicts = table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 10 == 0).select(F.col("c_custkey").alias("document_id"))
    return ops.retryable(_state(spark, sf_dir), conflicts).select("job_id", "document_id", "status")


def cancelled_jobs(spark, sf_dir):
    s = _state(spark, sf_dir)
    return ops.cancelled(s, s.filter("job_id % 2 = 0").select("job_id"), NOW).select("job_id", "status", "phase", "completed_at")


def cleared_jobs(spark, sf_dir):
    s = _state(spark, sf_dir)
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), "l_linenumber")
    left, children = ops.cleared(s, ["failed", "cancelled", "completed"], {"pages": li})
    return children["pages"].groupBy("job_id").agg(F.count("*").alias("n_pages")).join(left.select("job_id", "status"), "job_id")


def active_job_violations(spark, sf_dir):
    s = _state(spark, sf_dir)
    return ops.invariants(s, s.select("document_id", F.lit("closed").alias("status")))


def dashboard_state(spark, sf_dir):
    s = _state(spark, sf_dir)
    return s.agg(F.count_if(F.col("status").isin(*ops.ACTIVE)).alias("active"), F.count_if(F.col("status").isin("queued", "retry_wait")).alias("queued"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if((F.col("status") == "needs_review") & (F.col("phase") != "ocr_conflict")).alias("needs_review"))


def decisions_last_day(spark, sf_dir):
    """Events of the 86 400 seconds up to the last one."""
    e = table(spark, sf_dir, "events").select("ts", "event_type")
    last = e.agg(F.max("ts").alias("now"))
    return e.crossJoin(F.broadcast(last)).filter(F.col("ts") >= F.col("now") - F.expr("INTERVAL 86400 SECOND")).groupBy("event_type").agg(F.count("*").alias("n"))  # last is one row


def discovery_changed_documents(spark, sf_dir):
    """Documents without state or with another state; state is what labels hold."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 11 != 0, F.concat(F.lit("v"), (F.col("doc_id") % 2).cast("string"))).alias("modified"))
    s = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 11 != 0, F.concat(F.lit("v"), F.col("quality").cast("string"))).alias("modified"))
    return discovery.changed(d, s)


def event_windows(spark, sf_dir):
    w = discovery.event_windows(table(spark, sf_dir, "events"), "1 day")
    return w.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def publish_actions(spark, sf_dir):
    k = F.col("o_orderkey")
    names = F.array(*map(F.lit, ("none", "started", "task", "version_latest", "version_newer", "version_gone")))
    o = table(spark, sf_dir, "orders").select(k.alias("job_id"), (F.floor(k / 6) % 2 == 0).alias("m"), F.element_at(names, (k % 6 + 1).cast("int")).alias("c"), (k % 5 < 3).alias("keep"), (k % 7 == 0).alias("ours"))
    return o.groupBy(ops.publish_action(F.col("m"), F.col("c"), F.col("keep"), F.col("ours")).alias("action")).agg(F.count("*").alias("n"))


def get_or_create_names(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    old = n.filter("n_nationkey < 15").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return ops.get_or_create(old, n.select(F.initcap(F.lower("n_name")).alias("name")).union(n.select(F.initcap(F.lower("n_name")).alias("name"))))


def _tagged(spark, sf_dir):
    tags = F.array_sort(F.array_distinct(F.collect_list(F.col("l_partkey") % 40)))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(tags.alias("tags"))


def bulk_tag_edit(spark, sf_dir):
    d = _tagged(spark, sf_dir)
    ids = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"))
    out = ops.bulk_edit(ops.bulk_edit(d, ids, "add_tag", 99), ids, "remove_tag", 7)
    return out.select("id", F.array_join("tags", ",").alias("tags"))


def file_digests(spark, sf_dir):
    """SHA-256 of each page as a binary document."""
    return table(spark, sf_dir, "pages").select("page_id", F.octet_length("html").cast("long").alias("n_bytes"), F.sha2(F.col("html").cast("binary"), 256).alias("sha256"))


S = STATE_SQL
REC = f"""SELECT job_id, document_id, attempt, max_attempts, created_at,
 CASE WHEN status = 'running' AND lease_until < 900000000 THEN 'queued' ELSE status END AS status, CASE WHEN status = 'running' AND lease_until < 900000000 THEN 'recovered' ELSE phase END AS phase,
 CASE WHEN status = 'running' AND lease_until < 900000000 THEN 900000000.0::DOUBLE ELSE next_run_at END AS next_run_at, CASE WHEN status = 'running' AND lease_until < 900000000 THEN NULL ELSE lease_until END AS lease_until FROM ({S})"""
TAGS = "SELECT l_orderkey AS id, list_sort(list_distinct(list(l_partkey % 40))) AS tags FROM lineitem GROUP BY 1"
ORACLES = {
    "recent_jobs_topk": f"SELECT job_id, status, created_at FROM ({JOBS_SQL}) ORDER BY created_at DESC, job_id DESC LIMIT 100",
    "job_page": f"SELECT job_id, status, created_at FROM ({JOBS_SQL}) ORDER BY created_at DESC, job_id DESC LIMIT 50 OFFSET 100",
    "latest_event_per_job": "SELECT event_id, user_id, event_type, value, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "last_n_events_per_job": "SELECT event_id, user_id, event_type, (row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC))::INTEGER AS rank FROM events QUALIFY rank <= 100",
    "job_detail_join": f"""SELECT job_id, status, last_line, last_status, coalesce(n_failed, 0) AS n_failed, coalesce(n_pages, 0) AS n_pages FROM ({JOBS_SQL}) LEFT JOIN (
 SELECT l_orderkey AS job_id, max(struct_pack(n := l_linenumber, s := l_linestatus)).n AS last_line, max(struct_pack(n := l_linenumber, s := l_linestatus)).s AS last_status, count(*) FILTER (l_returnflag = 'R') AS n_failed, count(*) AS n_pages FROM lineitem GROUP BY 1) USING (job_id)""",
    "page_failure_summary": "SELECT user_id, count(*) AS n_failed, array_to_string((list(event_id ORDER BY event_id))[1:20], ',') AS pages, bool_or(event_id % 2 = 0) AS retryable FROM events WHERE event_id % 5 = 0 GROUP BY user_id",
    "retry_backoff_schedule": "SELECT user_id, event_type, count(*) AS attempt, least(300.0, 5 * pow(2.0, greatest(0, count(*) - 1)))::DOUBLE AS delay FROM events GROUP BY user_id, event_type",
    "fail_or_retry": f"""SELECT job_id, CASE WHEN status <> 'running' THEN status WHEN job_id % 2 = 0 AND attempt < 3 THEN 'retry_wait' ELSE 'failed' END AS status,
 CASE WHEN status <> 'running' THEN next_run_at WHEN job_id % 2 = 0 AND attempt < 3 THEN 900000000.0::DOUBLE + least(300.0, 5 * pow(2.0, greatest(0, attempt - 1))) ELSE 900000000.0::DOUBLE END AS next_run_at,
 CASE WHEN status <> 'running' THEN lease_until END AS lease_until,
 CASE WHEN status <> 'running' THEN completed_at WHEN job_id % 2 = 0 AND attempt < 3 THEN NULL ELSE 900000000.0::DOUBLE END AS completed_at,
 CASE WHEN status = 'running' THEN 'model' END AS error_code FROM ({S})""",
    "expired_lease_reclaim": f"SELECT job_id, status, phase, next_run_at, lease_until FROM ({REC})",
    "startup_recovery": f"SELECT status, phase, count(*) AS n FROM (SELECT CASE WHEN status = 'running' THEN 'queued' ELSE status END AS status, CASE WHEN status = 'running' THEN 'recovered' ELSE phase END AS phase FROM ({S})) GROUP BY 1, 2",
    "claim_order": f"SELECT job_id, next_run_at, created_at FROM ({REC}) WHERE status IN ('queued', 'retry_wait') AND next_run_at <= 900000000 ORDER BY next_run_at, created_at, job_id LIMIT 200",
    "claimed_job": f"SELECT job_id, 'running' AS status, attempt + 1 AS attempt, 900000900.0::DOUBLE AS lease_until FROM ({REC}) WHERE status IN ('queued', 'retry_wait') AND next_run_at <= 900000000 ORDER BY next_run_at, created_at, job_id LIMIT 1",
    "enqueue_idempotent": f"SELECT c_custkey AS document_id, c_custkey AS pos FROM customer WHERE c_custkey > 0 AND c_custkey NOT IN (SELECT document_id FROM ({S}) WHERE status IN ('queued', 'running', 'retry_wait'))",
    "manual_retry_candidates": f"""WITH s AS ({S}) SELECT job_id, document_id, status FROM s WHERE status IN ('completed', 'failed', 'needs_review', 'cancelled') AND phase <> 'ocr_conflict'
 AND document_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0) AND document_id NOT IN (SELECT document_id FROM s WHERE status IN ('queued', 'running', 'retry_wait'))""",
    "cancelled_jobs": f"""SELECT job_id, CASE WHEN c THEN 'cancelled' ELSE status END AS status, CASE WHEN c THEN 'cancelled' ELSE phase END AS phase, CASE WHEN c THEN 900000000.0::DOUBLE ELSE completed_at END AS completed_at
 FROM (SELECT *, job_id % 2 = 0 AND status IN ('queued', 'retry_wait') AS c FROM ({S}))""",
    "cleared_jobs": f"SELECT job_id, count(*) AS n_pages, any_value(status) AS status FROM ({S}) JOIN lineitem ON l_orderkey = job_id WHERE status NOT IN ('failed', 'cancelled') GROUP BY job_id",
    "active_job_violations": f"SELECT document_id, 'active job' AS what FROM ({S}) WHERE status IN ('queued', 'running', 'retry_wait') GROUP BY 1 HAVING count(*) > 1",
    "dashboard_state": f"""SELECT count(*) FILTER (status IN ('queued','running','retry_wait')) AS active, count(*) FILTER (status IN ('queued','retry_wait')) AS queued, count(*) FILTER (status = 'completed') AS completed,
 count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'needs_review' AND phase <> 'ocr_conflict') AS needs_review FROM ({S})""",
    "decisions_last_day": "SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 86400 SECOND GROUP BY event_type",
    "discovery_changed_documents": """WITH d AS (SELECT doc_id AS id, CASE WHEN doc_id % 11 <> 0 THEN 'v' || (doc_id % 2) END AS modified FROM documents),
 s AS (SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN 'v' || quality END AS m FROM labels) SELECT id, modified FROM d LEFT JOIN s ON id = doc_id WHERE doc_id IS NULL OR modified IS DISTINCT FROM m""",
    "event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "publish_actions": """SELECT action, count(*) AS n FROM (SELECT CASE WHEN NOT m THEN 'replace_in_place' WHEN NOT keep AND c = 0 THEN 'replace_existing' WHEN c = 3 THEN 'write_to_version' WHEN c = 4 THEN 'retry_source_changed'
 WHEN ours THEN 'reuse_version' WHEN c = 1 THEN 'stop_ambiguous' WHEN c = 2 THEN 'poll_task' ELSE 'upload_version' END AS action
 FROM (SELECT (o_orderkey // 6) % 2 = 0 AS m, o_orderkey % 6 AS c, o_orderkey % 5 < 3 AS keep, o_orderkey % 7 = 0 AS ours FROM orders)) GROUP BY action""",
    "get_or_create_names": """WITH n AS (SELECT n_nationkey AS id, n_name AS name, lower(n_name) AS k FROM nation),
 t AS (SELECT list_reduce(list_transform(string_split(lower(n_name), ' '), lambda x: upper(x[1]) || x[2:]), lambda a, b: a || ' ' || b) AS name, lower(n_name) AS k FROM nation)
 SELECT n.id::BIGINT AS id, n.name, false AS created FROM n JOIN t USING (k) WHERE id < 15
 UNION ALL SELECT 14 + row_number() OVER (ORDER BY t.k), t.name, true FROM t JOIN n USING (k) WHERE n.id >= 15""",
    "bulk_tag_edit": f"""SELECT id, array_to_string(CASE WHEN o_orderstatus = 'O' THEN list_filter(list_append(tags, 99), lambda x: x <> 7) ELSE tags END, ',') AS tags FROM ({TAGS}) JOIN orders ON o_orderkey = id""",
    "file_digests": "SELECT page_id, strlen(html) AS n_bytes, sha256(html) AS sha256 FROM pages",
}
QUERIES = {n: f for n, f in globals().items() if n in ORACLES}
