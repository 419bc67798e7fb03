"""The boundary to external models: a pluggable client, batches, retries, tree reduction.

A client is a function from prompt to answer text. The stub answers from the prompt
alone, so tests and reruns agree.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.sources.tables import kept

RETRYABLE = (408, 425, 429, 500, 502, 503, 504)


#: Request profiles of transcription and whether each is held back by default (fixed values).
PROFILES = {"generic": False, "deepseek_ocr": True, "deepseek_ocr_llamacpp": False, "glm_ocr": True}


def profile_used(key: Column, held_back: bool = False) -> Column:
    """The profile that a request runs with: unknown ones, and held back ones unless these are on, are generic."""
    on = [name for name, held in PROFILES.items() if held_back or not held]
    return F.when(key.isin(on), key).otherwise("generic")


def store_attempt(status: Column, attempt: Column, retries: int, upload: Column) -> Column:
    """What follows an answer of the document store: struct(action, wait). status: null where none came.

    Attempts count from 0. An upload is sent once: where it may have arrived, its outcome is ambiguous.
    """
    passing = status.isNull() | status.isin(*RETRYABLE)
    action = F.when(status < 400, "done").when(passing & upload, "ambiguous").when(passing & (attempt < retries), "retry").otherwise("fail")
    return F.struct(action.alias("action"), F.when(action == "retry", F.least(F.lit(8.0), 0.5 * F.pow(F.lit(2.0), attempt))).alias("wait"))


class ModelFailure(Exception):
    def __init__(self, status: int, wait: float | None = None):
        super().__init__(f"model answered {status}")
        self.status, self.wait = status, wait


def stub(prompt: str) -> str:
    """Word count and digest of the prompt as JSON."""
    return json.dumps({"words": len(prompt.split()), "digest": hashlib.sha256(prompt.encode()).hexdigest()[:16]})


def delay(attempt: int, wait: float | None = None) -> float:
    return wait if wait is not None else min(12.0, 0.75 * 2**attempt)


def retried(client: Callable[[str], str], prompt: str, retries: int = 2, sleep: Callable[[float], None] = time.sleep) -> str:
    for attempt in range(retries + 1):
        try:
            return client(prompt)
        except ModelFailure as e:
            if e.status not in RETRYABLE or attempt == retries:
                raise
            sleep(delay(attempt, e.wait))
    raise AssertionError


def repaired(client: Callable[[str], str], prompt: str, valid: Callable[[dict], str | None], retries: int = 1) -> tuple[dict | None, list[str]]:
    """Asks again with the error until an answer is an object that is valid; (answer, errors)."""
    errors: list[str] = []
    said = prompt
    for _ in range(retries + 1):
        text = client(said)
        try:
            answer = json.loads(text)
            error = "not an object" if not isinstance(answer, dict) else valid(answer)
        except ValueError as e:
            answer, error = None, str(e)
        if error is None:
            return answer, errors
        errors.append(error[:2000])
        said = f"{prompt}\n\nYour last answer:\n{text[:4000]}\n\nWhat is wrong with it: {error[:2000]}"
    return None, errors


def asked(rows: DataFrame, client: Callable[[str], str] = stub) -> DataFrame:
    """rows (key columns, prompt) plus answer and error; one call a row, in the order of a partition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            answers, errors = [], []
            for prompt in pdf.prompt.fillna(""):
                try:
                    answers.append(retried(client, prompt))
                    errors.append(None)
                except ModelFailure as e:
                    answers.append(None)
                    errors.append(str(e))
            yield pdf.assign(answer=answers, error=errors)

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())]))


def map_reduce(chunks: DataFrame, combine: Callable[[list[str]], str], most_items: int = 16, budget: int = 24_000) -> DataFrame:
    """chunks (document_id, chunk_index, finding) -> (document_id, finding, levels).

    A document's findings are combined in groups, level by level, until one is left. A level is
    a packing and one call of combine a group, which holds most_items findings at most (where
    nothing fits together, pairs), so a document's findings are never in one task together.
    """
    from scriptorium.operators.packing import packed

    def of_group(pdf: pd.DataFrame) -> pd.DataFrame:
        found = pdf.sort_values("chunk_index").finding.tolist()
        return pd.DataFrame({"document_id": [pdf.document_id.iloc[0]], "chunk_index": [pdf.group.iloc[0]], "finding": [combine(found)]})

    rows = kept(chunks.select("document_id", F.col("chunk_index").cast("long").alias("chunk_index"), "finding"))
    done, level = None, 0
    while True:
        counts = rows.groupBy("document_id").count()
        whole = rows.join(counts.filter("count = 1"), "document_id", "left_semi").select("document_id", "finding", F.lit(level).alias("levels"))
        done = whole if done is None else done.unionByName(whole)
        rows = rows.join(counts.filter("count > 1"), "document_id", "left_semi")
        if rows.isEmpty():
            return done
        sized = rows.withColumn("_chars", F.length(F.to_json(F.struct(F.coalesce("finding", F.lit("")).alias("f")))) - len('{"f":}'))
        groups = kept(packed(sized, ["document_id"], ["chunk_index"], "_chars", budget, gap=1, first_gap=3, most_items=most_items))
        stuck = groups.groupBy("document_id").agg((F.max("group") + 1 == F.count("*")).alias("_stuck"))
        place = F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index")) - 1
        groups = groups.join(stuck, "document_id").withColumn("group", F.when(F.col("_stuck"), F.floor(place / 2)).otherwise(F.col("group")))
        rows = kept(groups.select("document_id", "chunk_index", "finding", "group").groupBy("document_id", "group").applyInPandas(of_group, "document_id long, chunk_index long, finding string"))
        level += 1



def pending_pages(pages: DataFrame, results: DataFrame) -> DataFrame:
    """Pages of a job (job_id, page_number) that still need a transcription."""
    return pages.join(results.filter(F.col("status") == "complete").select("job_id", "page_number"), ["job_id", "page_number"], "left_anti")


ANSWER = "assessment string, tags array<string>"


def reviewed_tags(rows: DataFrame, client: Callable[[str], str], growth: bool) -> DataFrame:
    """A second look at documents that have no tag and no usable proposal of one.

    rows: document_id, current_tags, tags (proposed names), usable, prompt. A first answer
    without tags is audited once more where new tags are allowed; a failed audit leaves the
    abstention as it was. -> document_id, tags, status (not_needed, selected, abstained,
    failed: no answer, or one without a list of tags), assessment, audit (overturned, confirmed_abstention, failed, null).
    """
    read = lambda df: df.withColumn("a", F.from_json("answer", ANSWER)).withColumn("failed", F.col("error").isNotNull() | F.col("a.tags").isNull())
    found = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    need = rows.filter((F.coalesce(F.size("current_tags"), F.lit(0)) <= 0) & ~F.coalesce("usable", F.lit(False)))
    first = kept(read(asked(need.select("document_id", "prompt"), client)).select("document_id", "prompt", "answer", "failed", found(F.col("a.tags")).alias("first_tags"), F.col("a.assessment").alias("first_said")))
    again = first.filter(F.lit(growth) & ~F.col("failed") & (F.size("first_tags") == 0))
    audit = read(asked(again.select("document_id", F.concat(F.lit("Audit and either overturn or confirm the prior empty tag decision.\n"), "prompt", F.lit("\n"), "answer").alias("prompt")), client))
    audit = audit.select("document_id", F.lit(True).alias("audited"), F.col("failed").alias("audit_failed"), found(F.col("a.tags")).alias("audit_tags"), F.col("a.assessment").alias("audit_said"))
    both = rows.select("document_id", "tags").join(first.drop("prompt", "answer"), "document_id", "left").join(audit, "document_id", "left")
    ok = F.coalesce(F.col("audited") & ~F.col("audit_failed"), F.lit(False))
    tags = F.when(F.col("failed").isNull() | F.col("failed"), F.col("tags")).when(ok, F.col("audit_tags")).otherwise(F.col("first_tags"))
    status = F.when(F.col("failed").isNull(), "not_needed").when(F.col("failed"), "failed").when(F.size(tags) > 0, "selected").otherwise("abstained")
    audited = F.when(F.col("audit_failed"), "failed").when(F.col("audited") & (F.size("audit_tags") > 0), "overturned").when(F.col("audited"), "confirmed_abstention")
    return both.select("document_id", tags.alias("tags"), status.alias("status"), F.when(ok, F.col("audit_said")).otherwise(F.col("first_said")).alias("assessment"), audited.alias("audit"))
