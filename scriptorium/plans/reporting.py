"""Dashboard and reporting queries over the job relation."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.sources.tables import table

#: orders plays the job relation: status letters stand for job states.
STATUS = {"O": "queued", "P": "running", "F": "completed"}


def jobs(spark, sf_dir):
    """orders as jobs: id, document_id, status, created_at."""
    o = table(spark, sf_dir, "orders")
    status = F.coalesce(*(F.when(F.col("o_orderstatus") == k, F.lit(v)) for k, v in STATUS.items()), F.lit("failed"))
    return o.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("document_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), "o_totalprice", "o_orderpriority")


def job_status_counts(spark, sf_dir):
    return jobs(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


JOBS_SQL = """SELECT o_orderkey AS job_id, o_custkey AS document_id,
 CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'failed' END AS status,
 o_orderdate AS created_at, o_totalprice, o_orderpriority FROM orders"""


def dashboard_counts(spark, sf_dir):
    j = jobs(spark, sf_dir)
    count = lambda c: F.count_if(c)
    return j.agg(
        count(F.col("status").isin("queued", "running", "retry_wait")).alias("active"),
        count(F.col("status").isin("queued", "retry_wait")).alias("queued"),
        count(F.col("status") == "completed").alias("completed"),
        count(F.col("status") == "failed").alias("failed"),
    )


QUERIES = {f.__name__: f for f in (job_status_counts, dashboard_counts)}
ORACLES = {
    "job_status_counts": f"SELECT status, count(*) AS n FROM ({JOBS_SQL}) GROUP BY status",
    "dashboard_counts": f"""SELECT count(*) FILTER (status IN ('queued','running','retry_wait')) AS active,
 count(*) FILTER (status IN ('queued','retry_wait')) AS queued, count(*) FILTER (status = 'completed') AS completed,
 count(*) FILTER (status = 'failed') AS failed FROM ({JOBS_SQL})""",
}
