"""Queries over stored records as they are served: jobs, decisions, notices."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import records as ops
from scriptorium.plans.jobs import STATE_SQL, _state
from scriptorium.sources.tables import table


def served_jobs(spark, sf_dir):
    return ops.served(_state(spark, sf_dir).select("job_id", "status", "next_run_at", "lease_until", F.lit("w").alias("worker_id"), (F.col("job_id") % 2).alias("keep_original_version")))


def _decisions(spark, sf_dir):
    """Events as decisions with what they applied, as JSON."""
    k = F.col("event_id")
    lists = lambda key, n: F.concat(F.lit(f'"{key}":['), F.array_join(F.array_repeat(F.lit("{}"), n.cast("int")), ","), F.lit("]"))
    patch = F.when(k % 3 == 0, '"patch":{}').when(k % 3 == 1, '"patch":{"title":"t","tags":[1]}').otherwise('"patch":{"tags":[],"title":"","document_type":2,"created":"x"}')
    applied = F.concat(F.lit("{"), patch, F.lit(","), lists("created", k % 3), F.lit(","), lists("reused", k % 4), F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", F.when(k % 6 == 0, "no_tags").otherwise("applied").alias("status"), applied.alias("applied"))


def decision_records(spark, sf_dir):
    d = _decisions(spark, sf_dir).select("event_id", "status", ops.decision_summary(F.col("applied")).alias("s"))
    line = ops.change_line(F.col("status"), F.col("s.patch_fields"), F.col("s.created_count"), F.col("s.reused_count"), F.col("s.removed_count"))
    return d.select("event_id", F.array_join("s.patch_fields", ",").alias("patch_fields"), "s.created_count", "s.reused_count", "s.removed_count", line.alias("line"))


def job_notices(spark, sf_dir):
    s = _state(spark, sf_dir).filter("status in ('failed', 'needs_review')")
    kind = F.when(F.col("phase") == "ocr_conflict", "ocr_conflict").otherwise(F.col("status"))
    n = ops.notices(s.select("job_id", "document_id", F.when(F.col("job_id") % 2 == 0, "Letter").alias("document_title"), kind.alias("kind"), F.lit("see the log").alias("message")))
    return n.select("job_id", "title", "message", F.array_join("tags", ",").alias("tags"))


def interventions(spark, sf_dir):
    """What waits for a person: reviews that are no conflicts, conflicts, failures."""
    s = _state(spark, sf_dir)
    what = F.when(F.col("status") == "failed", "failed").when(F.col("phase") == "ocr_conflict", "conflict").when(F.col("status") == "needs_review", "review")
    return s.select(what.alias("what"), "job_id").filter("what is not null").groupBy("what").agg(F.count("*").alias("n"), F.max("job_id").alias("latest"))


def configuration_fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", ops.fingerprint(F.struct("p_brand", "p_size")).alias("fingerprint"))


def event_outages(spark, sf_dir):
    """First failures: events of a user that fail after one that did not (every fifth and sixth fails)."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (~(F.col("event_id") % 6).isin(4, 5)).alias("ok"))
    return ops.outage_starts(e, "user_id", "event_id").select("user_id", "event_id")


def parsed_answers(spark, sf_dir):
    """Answers of a model as JSON, valid and not, read into choices."""
    k = F.col("event_id")
    head = F.when(k % 5 == 0, '{"existing_id":7,').when(k % 5 == 1, '{"new_name":" New   name ",').when(k % 5 == 2, '{"existing_id":7,"new_name":"x",').when(k % 5 == 3, '{"existing_id":7,"more":1,').otherwise("[")
    answer = F.concat(F.lit("```json\n"), head, F.lit('"confidence":'), (k % 12 / 10).cast("string"), F.lit(',"reason":"because","source_pages":[3,1,3]}\n```'))
    p = table(spark, sf_dir, "events").select("event_id", ops.parsed_choice(answer).alias("p"))
    return p.select("event_id", "p.choice.existing_id", "p.choice.new_name", "p.choice.confidence", F.array_join("p.choice.source_pages", ",").alias("pages"), "p.error")


ISO = "strftime(make_timestamp(({0} * 1000000)::BIGINT), '%Y-%m-%dT%H:%M:%S') || '+00:00'"
D = """SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'no_tags' ELSE 'applied' END AS status, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'tags,title' ELSE 'created,document_type,tags,title' END AS patch_fields,
 (event_id % 3)::INTEGER AS created_count, (event_id % 4)::INTEGER AS reused_count, 0 AS removed_count FROM events"""
ORACLES = {
    "served_jobs": f"SELECT job_id, status, {ISO.format('next_run_at')} AS next_run_at, {ISO.format('lease_until')} AS lease_until, job_id % 2 = 1 AS keep_original_version FROM ({STATE_SQL})",
    "decision_records": f"""SELECT event_id, patch_fields, created_count, reused_count, removed_count, CASE WHEN patch_fields = '' AND created_count + reused_count = 0 THEN CASE WHEN status = 'no_tags' THEN 'No tags selected' ELSE 'No library changes' END
 ELSE CASE patch_fields WHEN '' THEN 'Metadata' WHEN 'tags,title' THEN 'Tags, Title' ELSE 'Created, Document Type, Tags +1' END || ' · ' || reused_count || ' reused' || CASE WHEN created_count > 0 THEN ' · ' || created_count || ' new' ELSE '' END || CASE WHEN status = 'no_tags' THEN ' · no tags selected' ELSE '' END END AS line FROM ({D})""",
    "job_notices": f"""SELECT job_id, 'Scriptorium: ' || CASE WHEN phase = 'ocr_conflict' THEN 'OCR conflict' WHEN status = 'failed' THEN 'processing failed' ELSE 'review required' END AS title,
 CASE WHEN job_id % 2 = 0 THEN 'Letter' ELSE 'Document ' || document_id END || ' (document #' || document_id || ')' || chr(10) || 'see the log' AS message,
 CASE WHEN phase = 'ocr_conflict' THEN 'warning,mag' WHEN status = 'failed' THEN 'x,page_facing_up' ELSE 'warning,page_facing_up' END AS tags FROM ({STATE_SQL}) WHERE status IN ('failed', 'needs_review')""",
    "interventions": f"SELECT CASE WHEN status = 'failed' THEN 'failed' WHEN phase = 'ocr_conflict' THEN 'conflict' ELSE 'review' END AS what, count(*) AS n, max(job_id) AS latest FROM ({STATE_SQL}) WHERE status IN ('failed', 'needs_review') GROUP BY 1",
    "configuration_fingerprints": """SELECT p_partkey, sha256('{"p_brand":"' || p_brand || '","p_size":' || p_size || '}') AS fingerprint FROM part""",
    "event_outages": "SELECT user_id, event_id FROM (SELECT user_id, event_id, event_id % 6 NOT IN (4, 5) AS ok, coalesce(lag(event_id % 6 NOT IN (4, 5)) OVER (PARTITION BY user_id ORDER BY event_id), true) AS before FROM events) WHERE NOT ok AND before",
    "parsed_answers": """SELECT event_id, CASE WHEN error IS NULL AND event_id % 5 = 0 THEN 7::BIGINT END AS existing_id, CASE WHEN error IS NULL AND event_id % 5 = 1 THEN 'New name' END AS new_name, CASE WHEN error IS NULL THEN (event_id % 12)::DOUBLE / 10 END AS confidence,
 CASE WHEN error IS NULL THEN '1,3' END AS pages, error FROM (SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 'not an object' WHEN event_id % 5 = 3 THEN 'extra keys' WHEN event_id % 5 = 2 THEN 'exactly one of existing_id and new_name' WHEN event_id % 12 = 11 THEN 'confidence outside 0 to 1' END AS error FROM events)""",
}
QUERIES = {n: f for n, f in globals().items() if n in ORACLES}
