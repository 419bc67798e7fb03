"""Queries over state transitions, stored records and rules of requests; orders, events and parts stand for them."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.operators import jobs, models, pages, planning, records, vocabulary
from scriptorium.plans.jobs import NOW, STATE_SQL, _state
from scriptorium.sources import documents as sources
from scriptorium.sources.tables import table
from scriptorium.streaming import checkpoints


def heartbeat_leases(spark, sf_dir):
    s = _state(spark, sf_dir)
    return jobs.heartbeat(s, s.filter(F.col("job_id") % 3 == 0), NOW).select("job_id", "lease_until")


#: Kinds of job events by their number; every 97th is the end of a job.
KINDS = ("claim", "heartbeat", "upload_started", "heartbeat", "upload_task", "claim", "heartbeat", "version_created", "claim", "heartbeat", "failed", "retried", "checkpoint_cleared")
HOURS_20 = 72_000_000_000


def job_checkpoints(spark, sf_dir):
    """Lease, attempts and upload checkpoint of each job after all its events."""
    k = F.col("event_id")
    kind = F.when(k % 97 == 0, "completed").otherwise(F.element_at(F.array(*map(F.lit, KINDS)), (k % len(KINDS) + 1).cast("int")))
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), at.alias("at"), k.alias("seq"), kind.alias("kind"), k.cast("string").alias("value"))
    return checkpoints.job_states(events, HOURS_20)


def review_transitions(spark, sf_dir):
    s = _state(spark, sf_dir)
    return jobs.ended(s, s.filter(F.col("job_id") % 4 == 0), "needs_review", NOW, phase="metadata_review").select("job_id", "status", "phase", "lease_until", "completed_at")


def finished_jobs(spark, sf_dir):
    s = _state(spark, sf_dir)
    return jobs.ended(s, s.filter(F.col("job_id") % 5 == 0), "completed", NOW, phase="complete").select("job_id", "status", "phase", "lease_until", "completed_at")


def partial_updates(spark, sf_dir):
    """Jobs after changes of which some values are null."""
    s = _state(spark, sf_dir)
    changes = s.filter(F.col("job_id") % 2 == 0).select("job_id", F.when(F.col("job_id") % 3 == 0, "ocr").alias("phase"), F.when(F.col("job_id") % 5 == 0, F.col("job_id").cast("int")).alias("attempt"))
    return jobs.updated(s, changes).select("job_id", "phase", "attempt", "status")


def _conflicts(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), (k * 2).alias("document_id"), F.when(k % 3 == 0, "resolved").otherwise("open").alias("status"), F.when(k % 7 == 0, "use_generated").alias("resolution"), F.concat(F.lit("text "), k.cast("string")).alias("existing_text"), F.lit(4).cast("long").alias("conflict_tag_id")
    )


def conflict_resolutions(spark, sf_dir):
    c = _conflicts(spark, sf_dir)
    requests = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 5).alias("id"), F.when(F.col("c_custkey") % 2 == 0, "keep_existing").otherwise("use_generated").alias("choice"))
    k = F.col("c_custkey")
    live = table(spark, sf_dir, "customer").select((k * 2).alias("document_id"), F.when(k % 5 != 0, F.concat(F.lit("text "), k.cast("string"))).alias("text"), (k % 11 != 0).alias("meaningful"), F.array(F.lit(1).cast("long"), k % 6).alias("tags"))
    return jobs.resolution(c, requests, live).select("id", "choice", "error", "new_status", F.array_join("new_tags", ",").alias("new_tags"))


def replaced_conflicts(spark, sf_dir):
    c = _conflicts(spark, sf_dir)
    found = c.filter("id % 4 = 0").select((F.col("id") + 1_000_000).alias("id"), "document_id", F.lit("open").alias("status"), F.lit(None).cast("string").alias("resolution"), F.lit("new").alias("existing_text"), F.lit(9).cast("long").alias("conflict_tag_id"))
    return records.open_conflicts(c, found).select("id", "document_id", "status", "existing_text", "conflict_tag_id")


def candidate_summaries(spark, sf_dir):
    """Candidates cut to what a prompt holds, and their rationale as JSON."""
    k = F.col("p_partkey")
    c = table(spark, sf_dir, "part").select(k.alias("id"), F.repeat("p_name", 40).alias("reason"), F.when(k % 3 == 0, "").otherwise(F.col("p_type")).alias("evidence"), F.when(k % 4 == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), (k % 30 + 1).cast("int"))).alias("source_pages"))
    c = records.compact(c)
    return c.select("id", F.length("reason").alias("reason_chars"), records.rationale(F.lit(None).cast("double"), F.left("reason", F.lit(9)), F.col("evidence"), F.col("source_pages"), F.lit(None).cast("string")).alias("rationale"))


def before_images(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"), F.array(F.col("o_orderkey") % 5).alias("tags"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("correspondent"))
    return records.before_image(o)


def bounded_diagnostics(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("entry_id"))
    d = e.select("key", (F.row_number().over(Window.partitionBy("key").orderBy("entry_id")) - 1).alias("pos"), F.concat(F.lit("entry "), F.col("entry_id").cast("string")).alias("entry"))
    return records.bounded(d)


def event_log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    row = records.event(F.col("user_id"), F.lit("info"), F.col("event_type"), F.repeat(F.col("event_type"), 300), F.col("props"), NOW)
    return e.select("event_id", row.alias("e")).select("event_id", "e.job_id", "e.level", "e.event_type", "e.message", "e.created_at")


def planned_custom_values(spark, sf_dir):
    """Values proposed for fields 1 to 4 of each order, some for unknown fields, some unsure, some twice."""
    li, k = table(spark, sf_dir, "lineitem"), F.col("l_orderkey")
    first = li.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("int").alias("q"))
    p = first.select(k.alias("document_id"), F.col("l_linenumber").cast("int").alias("pos"), (F.col("l_linenumber") % 3 + 1).cast("int").alias("field_id"), F.when(F.col("l_linenumber") % 4 == 0, "x").otherwise(F.col("q").cast("string")).alias("value"), F.when((k + F.col("l_linenumber")) % 5 == 0, 0.3).otherwise(0.9).alias("confidence"))
    definitions = spark.createDataFrame([(1, "pages", "integer", None), (2, "note", "string", None)], "field_id int, name string, data_type string, currency string")
    return planning.custom_values(p, definitions)


def new_field_plans(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, "Page counts").otherwise(F.concat(F.lit("zq"), (k * 7919).cast("string"), F.lit("xkv")))
    p = table(spark, sf_dir, "part").select(k.alias("document_id"), F.lit(0).alias("pos"), name.alias("name"), F.lit("string").alias("data_type"), F.when(k % 2 == 0, "12").otherwise("twelve").alias("value"), F.when(k % 5 == 0, 0.2).otherwise(0.9).alias("confidence"), F.when(k % 7 == 0, "short").otherwise("needed on every letter").alias("reason"))
    definitions = spark.createDataFrame([(5, "page count", "integer", None)], "id long, name string, data_type string, currency string")
    return planning.new_custom_fields(p, definitions, True)


def gated_titles(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 100 / 100).alias("confidence"))
    return planning.gate_scalar(rows)


def usable_tags(spark, sf_dir):
    k = F.col("p_partkey")
    t = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 2 == 0, k).alias("existing_id"), F.when(k % 2 == 1, F.when(k % 3 == 0, "Queue  Tag").otherwise(F.col("p_name"))).alias("new_name"), F.when(k % 7 == 0, 0.5).otherwise(0.8).alias("confidence"), F.when(k % 5 == 0, "why").otherwise("a reason of some length").alias("reason"))
    return t.select("p_partkey", planning.usable_tag(t, F.array(F.lit(4).cast("long"), F.floor(k / 4) * 4), True, "queue tag").alias("usable"))


def pages_to_resume(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("page_number"), F.when(F.col("l_returnflag") == "N", "complete").otherwise("failed").alias("status"))
    return models.pending_pages(li.select("job_id", "page_number").distinct(), li).groupBy("job_id").agg(F.count("*").alias("n_pages"))


def vocabulary_catalog(spark, sf_dir):
    """One vocabulary of three resources, rows without name or id left out."""
    of = lambda t, i, n, c: table(spark, sf_dir, t).select(F.when(F.col(i) % 9 != 0, F.col(i)).alias("id"), F.when(F.col(i) % 7 == 0, "").otherwise(F.col(n)).alias("name"), F.when(F.col(i) % 2 == 0, F.col(i)).alias(c))
    frames = {"tags": of("part", "p_partkey", "p_name", "document_count"), "correspondents": of("supplier", "s_suppkey", "s_name", "document_count"), "document_types": of("customer", "c_custkey", "c_name", "document_count")}
    return vocabulary.entities(sources.catalog(frames)).select("kind", "id", "name", "document_count")


def _library(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_orderpriority").alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("modified"), F.lit("x").alias("added"), F.array(k % 5, F.col("o_custkey") % 3).alias("tags"), F.col("o_custkey").alias("correspondent"))


def newest_documents(spark, sf_dir):
    """The second page of 40 documents with tag 2, newest first."""
    return sources.listing(_library(spark, sf_dir), 40, 2, 2)[0].select("id", "title", "modified")


def documents_with_entity(spark, sf_dir):
    d = _library(spark, sf_dir)
    return sources.ids_with(d, "tag", 4).unionByName(sources.ids_with(d, "correspondent", 7)).unionByName(sources.document(d, 32).select("id"))


def stored_document_states(spark, sf_dir):
    """States of documents after some were processed and others changed status."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k.alias("document_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("modified"), F.sha2(k.cast("string"), 256).alias("source_hash"), k.alias("last_job_id"), F.lit("completed").alias("last_status"), F.lit(1.0).alias("processed_at"))
    seen = o.filter("document_id % 3 = 0 or document_id % 2 = 1").select("document_id", "modified", "source_hash", (F.col("last_job_id") + 1).alias("last_job_id"), F.lit("failed").alias("last_status"))
    after = jobs.document_states(o.filter("document_id % 2 = 0"), seen, 2.0)
    return jobs.document_statuses(after, o.filter("document_id % 10 < 3").select("document_id", F.lit("needs_review").alias("status")), 3.0).select("document_id", "last_job_id", "last_status", "processed_at")


def merge_request_errors(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", vocabulary.merge_error(k % 5, F.when(k % 4 != 0, k % 3)).alias("error"))


def truncation_reasons(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", tx.truncation(F.lit(1000), (F.col("event_id") % 400 + 3700).cast("int"), 4096).alias("reason"))


def fitted_candidates(spark, sf_dir):
    """Suppliers' candidates of four kinds: how many fit, and how much text beside them."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("document_id"), F.concat(F.lit("kind"), (F.col("l_partkey") % 4).cast("string")).alias("kind"), F.col("l_partkey").alias("part")).distinct()
    ranked = li.withColumn("rank", F.row_number().over(Window.partitionBy("document_id", "kind").orderBy("part")))
    return pages.fitted_candidates(ranked.select("document_id", "kind", "rank", (F.col("part") % 200 + 20).cast("long").alias("size")))


def store_attempts(spark, sf_dir):
    k = F.col("event_id")
    status = F.get(F.array(*map(F.lit, (0, 200, 404, 503, 429))), (k % 5).cast("int"))
    e = table(spark, sf_dir, "events").select("event_id", models.store_attempt(F.when(k % 5 > 0, status), (k % 7).cast("int"), 5, k % 3 == 0).alias("a"))
    return e.select("event_id", "a.action", "a.wait")


def request_profiles(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, (*models.PROFILES, "other"))), (F.col("event_id") % 5 + 1).cast("int"))
    e = table(spark, sf_dir, "events").select(name.alias("asked"))
    return e.select("asked", models.profile_used(F.col("asked")).alias("used"), models.profile_used(F.col("asked"), True).alias("with_all")).groupBy("asked", "used", "with_all").agg(F.count("*").alias("n"))


def _reviewer(prompt: str) -> str:
    """Answers by the number at the end of the first line about a document; some answers are broken, some clients fail."""
    number = int(next(line for line in prompt.split("\n") if line.startswith("document ")).split()[1])
    audit = prompt.startswith("Audit")
    if number % 13 == 0 or audit and number % 11 == 0:
        raise models.ModelFailure(400)
    if number % 17 == 0:
        return "no JSON"
    return json.dumps({"assessment": f"{'audit' if audit else 'first'} {number}", "tags": ["found"] if number % 3 == 0 or audit and number % 2 == 0 else []})


def tag_reviews(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("document_id"), F.when(k % 10 == 0, F.array(F.lit(1).cast("long"))).otherwise(F.array().cast("array<long>")).alias("current_tags"), F.array(F.lit("proposed")).alias("tags"), (k % 7 == 0).alias("usable"), F.concat(F.lit("document "), k.cast("string")).alias("prompt"))
    return models.reviewed_tags(rows, _reviewer, True).select("document_id", F.array_join("tags", ",").alias("tags"), "status", "assessment", "audit")


S = STATE_SQL
C = "SELECT c_custkey AS id, c_custkey * 2 AS document_id, CASE WHEN c_custkey % 3 = 0 THEN 'resolved' ELSE 'open' END AS status, CASE WHEN c_custkey % 7 = 0 THEN 'use_generated' END AS resolution, 'text ' || c_custkey AS existing_text, 4 AS conflict_tag_id FROM customer"
STEPS = [80, 40, 20, 10, 5]
ORACLES = {
    "job_checkpoints": f"""WITH RECURSIVE e AS (SELECT user_id AS job_id, epoch_us(ts) AS t, event_id::VARCHAR AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
 CASE WHEN event_id % 97 = 0 THEN 'completed' ELSE {list(KINDS)}[event_id % {len(KINDS)} + 1] END AS kind FROM events),
 s AS (SELECT DISTINCT job_id, 0::BIGINT AS rn, 'queued' AS status, NULL::VARCHAR AS error_code, 0::BIGINT AS attempt, NULL::BIGINT AS lease_until, NULL::VARCHAR AS task_id, NULL::VARCHAR AS version_id, 0::BIGINT AS recovered FROM e
 UNION ALL SELECT job_id, rn,
 CASE WHEN kind = 'claim' AND st = 'queued' THEN 'running' WHEN st = 'running' AND kind = 'upload_started' AND task_id = 'started' THEN 'failed' WHEN st = 'running' AND kind IN ('completed', 'failed') THEN kind WHEN st = 'failed' AND kind = 'retried' THEN 'queued' ELSE st END,
 CASE WHEN kind = 'claim' AND st = 'queued' OR st = 'failed' AND kind = 'retried' OR st = 'running' AND kind = 'completed' THEN NULL WHEN st = 'running' AND kind = 'upload_started' AND task_id = 'started' THEN 'ambiguous' WHEN st = 'running' AND kind = 'failed' THEN 'failed' ELSE error_code END,
 attempt + (kind = 'claim' AND st = 'queued')::BIGINT,
 CASE WHEN kind = 'claim' AND st = 'queued' OR kind = 'heartbeat' AND st = 'running' THEN t + {HOURS_20} WHEN st = 'running' AND (kind IN ('completed', 'failed') OR kind = 'upload_started' AND task_id = 'started') THEN NULL WHEN lost THEN NULL ELSE lease_until END,
 CASE WHEN kind = 'upload_task' THEN value WHEN kind = 'checkpoint_cleared' THEN NULL WHEN kind = 'upload_started' AND st = 'running' AND task_id IS NULL THEN 'started' ELSE task_id END,
 CASE WHEN kind = 'version_created' THEN value WHEN kind = 'checkpoint_cleared' THEN NULL ELSE version_id END, recovered + lost::BIGINT
 FROM (SELECT e.job_id, e.rn, e.t, e.kind, e.value, error_code, attempt, lease_until, task_id, version_id, recovered, status = 'running' AND coalesce(lease_until < t, false) AS lost, CASE WHEN status = 'running' AND lease_until < t THEN 'queued' ELSE status END AS st
 FROM s JOIN e ON e.job_id = s.job_id AND e.rn = s.rn + 1))
 SELECT job_id, status, error_code, attempt, lease_until, task_id, version_id, recovered, rn AS n_events FROM s QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY rn DESC) = 1""",
    "heartbeat_leases": f"SELECT job_id, CASE WHEN job_id % 3 = 0 AND status = 'running' THEN 900000900.0::DOUBLE ELSE lease_until END AS lease_until FROM ({S})",
    "review_transitions": f"SELECT job_id, CASE WHEN job_id % 4 = 0 THEN 'needs_review' ELSE status END AS status, CASE WHEN job_id % 4 = 0 THEN 'metadata_review' ELSE phase END AS phase, CASE WHEN job_id % 4 <> 0 THEN lease_until END AS lease_until, CASE WHEN job_id % 4 = 0 THEN 900000000.0::DOUBLE ELSE completed_at END AS completed_at FROM ({S})",
    "finished_jobs": f"SELECT job_id, CASE WHEN job_id % 5 = 0 THEN 'completed' ELSE status END AS status, CASE WHEN job_id % 5 = 0 THEN 'complete' ELSE phase END AS phase, CASE WHEN job_id % 5 <> 0 THEN lease_until END AS lease_until, CASE WHEN job_id % 5 = 0 THEN 900000000.0::DOUBLE ELSE completed_at END AS completed_at FROM ({S})",
    "partial_updates": f"SELECT job_id, CASE WHEN job_id % 6 = 0 THEN 'ocr' ELSE phase END AS phase, CASE WHEN job_id % 10 = 0 THEN job_id::INTEGER ELSE attempt END AS attempt, status FROM ({S})",
    "conflict_resolutions": f"""WITH c AS ({C}), r AS (SELECT c_custkey + 5 AS id, CASE WHEN c_custkey % 2 = 0 THEN 'keep_existing' ELSE 'use_generated' END AS choice FROM customer),
 l AS (SELECT c_custkey * 2 AS document_id, CASE WHEN c_custkey % 5 <> 0 THEN 'text ' || c_custkey END AS text, c_custkey % 11 <> 0 AS meaningful, c_custkey % 6 AS t FROM customer),
 e AS (SELECT r.id, choice, status, t, CASE WHEN status IS NULL OR status <> 'open' THEN 'conflict_not_open' WHEN resolution IS NOT NULL THEN 'conflict_claimed' WHEN choice = 'keep_existing' AND NOT coalesce(meaningful, false) THEN 'no_existing_ocr'
  WHEN choice = 'use_generated' AND NOT coalesce(text = existing_text, false) THEN 'conflict_source_changed' END AS error FROM r LEFT JOIN c ON c.id = r.id LEFT JOIN l USING (document_id))
 SELECT id, choice, error, CASE WHEN error IS NULL THEN 'resolved' ELSE coalesce(status, 'missing') END AS new_status, CASE WHEN error IS NULL THEN CASE WHEN t = 4 THEN '1' ELSE '1,' || t END END AS new_tags FROM e""",
    "replaced_conflicts": f"""WITH c AS ({C}) SELECT id, document_id, status, existing_text, conflict_tag_id::BIGINT AS conflict_tag_id FROM c WHERE NOT (id % 4 = 0 AND status = 'open')
 UNION ALL SELECT CASE WHEN status = 'open' THEN id ELSE id + 1000000 END, document_id, 'open', 'new', 9 FROM c WHERE id % 4 = 0""",
    "candidate_summaries": """SELECT p_partkey AS id, least(240, length(p_name) * 40)::INTEGER AS reason_chars, '{"reason":"' || left(repeat(p_name, 40), 9) || '"' || CASE WHEN p_partkey % 3 <> 0 THEN ',"evidence":"' || left(p_type, 240) || '"' ELSE '' END
 || CASE WHEN p_partkey % 4 <> 0 THEN ',"source_pages":[' || array_to_string(range(1, least(12, p_partkey % 30 + 1) + 1), ',') || ']' ELSE '' END || '}' AS rationale FROM part""",
    "before_images": """SELECT o_orderkey AS id, '{"title":"' || o_orderpriority || '","created":"' || strftime(o_orderdate, '%Y-%m-%d') || '","tags":[' || o_orderkey % 5 || ']' || CASE WHEN o_custkey % 2 = 0 THEN ',"correspondent":' || o_custkey ELSE '' END || '}' AS before FROM orders""",
    "bounded_diagnostics": """WITH d AS (SELECT event_type AS key, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1)::INTEGER AS pos, 'entry ' || event_id AS entry, count(*) OVER (PARTITION BY event_type) AS n FROM events)
 SELECT key, pos, CASE WHEN n > 50 AND pos = 49 THEN 'diagnostic_limit: ' || (n - 49) || ' omitted' ELSE entry END AS entry FROM d WHERE n <= 50 OR pos < 50""",
    "event_log": "SELECT event_id, user_id AS job_id, 'info' AS level, event_type, left(repeat(event_type, 300), 1000) AS message, 900000000.0::DOUBLE AS created_at FROM events",
    "planned_custom_values": """WITH p AS (SELECT l_orderkey AS k, l_linenumber AS n, max(l_quantity)::INTEGER AS q FROM lineitem GROUP BY 1, 2),
 r AS (SELECT k, n::INTEGER AS pos, (n % 3 + 1)::INTEGER AS f, CASE WHEN n % 4 = 0 THEN 'x' ELSE q::VARCHAR END AS v, CASE WHEN n % 3 = 2 THEN 'unknown field ID' WHEN (k + n) % 5 = 0 THEN 'below confidence threshold' WHEN n % 3 = 0 AND n % 4 = 0 THEN 'invalid integer value' END AS note FROM p)
 SELECT k AS document_id, f AS field_id, min(pos) AS pos, CASE f WHEN 1 THEN 'pages' ELSE 'note' END AS name, arg_max(v, pos) AS value, NULL::VARCHAR AS note FROM r WHERE note IS NULL GROUP BY 1, 2
 UNION ALL SELECT k, f, pos, CASE f WHEN 1 THEN 'pages' WHEN 2 THEN 'note' END, v, note FROM r WHERE note IS NOT NULL""",
    "new_field_plans": """WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN 'below confidence threshold' WHEN p_partkey % 7 = 0 THEN 'new field definitions require a specific justification' WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 1 THEN 'invalid integer value' END AS note FROM part)
 SELECT k AS document_id, 0 AS pos, CASE WHEN k % 3 = 0 THEN 'Page counts' ELSE 'zq' || k * 7919 || 'xkv' END AS name, CASE WHEN note IS NOT NULL THEN 'reject' WHEN k % 3 = 0 THEN 'reuse' ELSE 'create' END AS action,
 CASE WHEN note IS NULL AND k % 3 = 0 THEN 5::BIGINT END AS field_id, CASE WHEN note IS NULL THEN CASE WHEN k % 2 = 0 THEN '12' ELSE 'twelve' END END AS value, note FROM p""",
    "gated_titles": "SELECT p_partkey, (p_partkey % 100)::DOUBLE / 100 AS confidence, CASE WHEN (p_partkey % 100)::DOUBLE / 100 < 0.68::DOUBLE THEN 'below confidence threshold' END AS note FROM part",
    "usable_tags": "SELECT p_partkey, p_partkey % 7 <> 0 AND CASE WHEN p_partkey % 2 = 0 THEN p_partkey = 4 OR p_partkey % 4 = 0 ELSE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 END AS usable FROM part",
    "pages_to_resume": "SELECT l_orderkey AS job_id, count(*) AS n_pages FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING NOT bool_or(l_returnflag = 'N')) GROUP BY 1",
    "vocabulary_catalog": " UNION ALL ".join(f"SELECT '{kind}' AS kind, {i} AS id, {n} AS name, CASE WHEN {i} % 2 = 0 THEN {i} ELSE 0 END AS document_count FROM {t} WHERE {i} % 9 <> 0 AND {i} % 7 <> 0" for kind, t, i, n in (("tag", "part", "p_partkey", "p_name"), ("correspondent", "supplier", "s_suppkey", "s_name"), ("document_type", "customer", "c_custkey", "c_name"))),
    "newest_documents": "SELECT o_orderkey AS id, o_orderpriority AS title, strftime(o_orderdate, '%Y-%m-%d') AS modified FROM orders WHERE o_orderkey % 5 = 2 OR o_custkey % 3 = 2 ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, o_orderkey LIMIT 40 OFFSET 40",
    "documents_with_entity": "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 5 = 4 OR o_custkey % 3 = 4 UNION ALL SELECT o_orderkey FROM orders WHERE o_custkey = 7 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey = 32",
    "stored_document_states": """SELECT o_orderkey AS document_id, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 2 = 1 THEN o_orderkey + 1 ELSE o_orderkey END AS last_job_id, CASE WHEN o_orderkey % 10 < 3 THEN 'needs_review' WHEN o_orderkey % 3 = 0 OR o_orderkey % 2 = 1 THEN 'failed' ELSE 'completed' END AS last_status,
 CASE WHEN o_orderkey % 10 < 3 THEN 3.0::DOUBLE WHEN o_orderkey % 3 = 0 OR o_orderkey % 2 = 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS processed_at FROM orders""",
    "merge_request_errors": "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'keep_id must be 1 or more' WHEN c_custkey % 4 = 0 OR c_custkey % 3 = 0 THEN 'merge_id must be 1 or more' WHEN c_custkey % 5 = c_custkey % 3 THEN 'keep_id and merge_id must differ' END AS error FROM customer",
    "truncation_reasons": "SELECT event_id, CASE WHEN event_id % 400 + 3700 < 3891.2 THEN 'context window reached after ' || (event_id % 400 + 4700) || ' tokens' ELSE 'output cap of 4096 tokens reached, likely repetition' END AS reason FROM events",
    "fitted_candidates": f"""WITH r AS (SELECT d, kind, p % 200 + 20 AS size, row_number() OVER (PARTITION BY d, kind ORDER BY p) AS rank FROM (SELECT DISTINCT l_suppkey AS d, 'kind' || l_partkey % 4 AS kind, l_partkey AS p FROM lineitem)),
 k AS (SELECT n, d, kind, sum(CASE WHEN rank <= n THEN size ELSE 0 END) + 2 * greatest(count(*) FILTER (rank <= n) - 1, 0) + 2 + length(kind) + 4 AS chars FROM r CROSS JOIN (SELECT unnest({STEPS}) AS n) GROUP BY n, d, kind),
 s AS (SELECT n, d, (sum(chars) + 2 * (count(*) - 1) + 2)::BIGINT AS chars FROM k GROUP BY n, d),
 f AS (SELECT d, coalesce(max(n) FILTER (chars <= 0.45::DOUBLE * 33864), 5) AS n FROM s GROUP BY d)
 SELECT d AS document_id, n::INTEGER AS candidate_limit, chars AS candidate_chars, CASE WHEN 33864 - chars - 6000 >= 1000 THEN least(33864 - chars - 6000, 12000) END AS text_chars, CASE WHEN 33864 - chars - 6000 < 1000 THEN 'context too small for the vocabulary' END AS error FROM f JOIN s USING (d, n)""",
    "store_attempts": """SELECT event_id, action, CASE WHEN action = 'retry' THEN least(8.0, 0.5 * pow(2.0, event_id % 7))::DOUBLE END AS wait FROM (SELECT event_id, CASE WHEN event_id % 5 = 1 THEN 'done' WHEN event_id % 5 = 2 THEN 'fail' WHEN event_id % 3 = 0 THEN 'ambiguous' WHEN event_id % 7 < 5 THEN 'retry' ELSE 'fail' END AS action FROM events)""",
    "request_profiles": """SELECT asked, CASE WHEN asked = 'deepseek_ocr_llamacpp' THEN asked ELSE 'generic' END AS used, CASE WHEN asked = 'other' THEN 'generic' ELSE asked END AS with_all, count(*) AS n FROM (SELECT ['generic', 'deepseek_ocr', 'deepseek_ocr_llamacpp', 'glm_ocr', 'other'][event_id % 5 + 1] AS asked FROM events) GROUP BY 1""",
    "tag_reviews": """WITH d AS (SELECT c_custkey AS k, c_custkey % 10 = 0 OR c_custkey % 7 = 0 AS fine, c_custkey % 13 = 0 OR c_custkey % 17 = 0 AS failed, c_custkey % 3 = 0 AS found, c_custkey % 11 = 0 AS again_failed FROM customer)
 SELECT k AS document_id, CASE WHEN fine OR failed THEN 'proposed' WHEN found THEN 'found' WHEN NOT again_failed AND k % 2 = 0 THEN 'found' ELSE '' END AS tags,
 CASE WHEN fine THEN 'not_needed' WHEN failed THEN 'failed' WHEN found OR (NOT again_failed AND k % 2 = 0) THEN 'selected' ELSE 'abstained' END AS status,
 CASE WHEN fine OR failed THEN NULL WHEN found OR again_failed THEN 'first ' || k ELSE 'audit ' || k END AS assessment,
 CASE WHEN fine OR failed OR found THEN NULL WHEN again_failed THEN 'failed' WHEN k % 2 = 0 THEN 'overturned' ELSE 'confirmed_abstention' END AS audit FROM d""",
}
QUERIES = {n: f for n, f in globals().items() if n in ORACLES}
