"""Projections of stored and model-made records: summaries, rationales, events, notices, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as tx

INTERNAL = ("force", "source_hash", "ocr_fingerprint", "worker_id")
TIMES = ("created_at", "updated_at", "started_at", "completed_at", "next_run_at", "lease_until", "resolved_at", "processed_at")


def iso(seconds: Column) -> Column:
    """Epoch seconds as ISO text in UTC; null and zero have none. Whole seconds carry no fraction."""
    at = F.timestamp_micros((seconds * 1_000_000).cast("long"))
    whole = (seconds * 1_000_000).cast("long") % 1_000_000 == 0
    text = F.when(whole, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return F.when(F.coalesce(seconds, F.lit(0)) != 0, F.concat(text, F.lit("+00:00")))


def served(rows: DataFrame) -> DataFrame:
    """Rows as an interface gives them out: no internal columns, times as ISO text, flags as booleans."""
    out = rows.drop(*INTERNAL)
    flags = {c: F.col(c).cast("boolean") for c in ("keep_original_version",) if c in out.columns}
    return out.withColumns(flags | {c: iso(F.col(c)) for c in TIMES if c in out.columns})


def decision_summary(applied: Column) -> Column:
    """applied (JSON) -> sorted names of patched fields, and how many entries were created, reused, removed."""
    n = lambda key: F.coalesce(F.json_array_length(F.get_json_object(applied, f"$.{key}")), F.lit(0)).alias(f"{key}_count")
    fields = F.sort_array(F.coalesce(F.json_object_keys(F.get_json_object(applied, "$.patch")), F.array().cast("array<string>")))
    return F.struct(fields.alias("patch_fields"), n("created"), n("reused"), n("removed"))


def change_line(status: Column, fields: Column, created: Column, reused: Column, removed: Column) -> Column:
    """One line about a decision: three field names and how many more, and the counts."""
    names = F.transform(fields, lambda f: F.initcap(F.replace(f, F.lit("_"), F.lit(" "))))
    more = F.when(F.size(names) > 3, F.concat(F.lit(" +"), (F.size(names) - 3).cast("string"))).otherwise("")
    head = F.concat(F.when(F.size(names) > 0, F.array_join(F.slice(names, 1, 3), ", ")).otherwise("Metadata"), more)
    part = lambda n, word: F.when(n > 0, F.concat(F.lit(" · "), n.cast("string"), F.lit(word))).otherwise("")
    empty = (F.size(names) == 0) & (created + reused + removed == 0)
    none = status == "no_tags"
    line = F.concat(head, F.lit(" · "), reused.cast("string"), F.lit(" reused"), part(created, " new"), part(removed, " workflow tag removed"), F.when(none, " · no tags selected").otherwise(""))
    return F.when(empty & none, "No tags selected").when(empty, "No library changes").otherwise(line)


def rationale(confidence: Column, reason: Column, evidence: Column, pages: Column, normalized_from: Column) -> Column:
    """JSON of the parts that are there: nulls, empty texts and empty lists are left out."""
    filled = lambda c: F.nullif(c, F.lit(""))
    return F.to_json(F.struct(confidence.alias("confidence"), filled(reason).alias("reason"), filled(evidence).alias("evidence"), F.when(F.size(pages) > 0, pages).alias("source_pages"), filled(normalized_from).alias("normalized_from")))


def compact(candidates: DataFrame) -> DataFrame:
    """Candidates (reason, evidence, source_pages, ...) cut to what a prompt may hold."""
    return candidates.withColumns({"reason": F.left("reason", F.lit(240)), "evidence": F.left("evidence", F.lit(240)), "source_pages": F.slice("source_pages", 1, 12)})


def before_image(documents: DataFrame) -> DataFrame:
    """(id, before): what a patch may change, as it was."""
    fields = ("title", "created", "tags", "correspondent", "document_type", "custom_fields", "modified")
    return documents.select("id", F.to_json(F.struct(*(c for c in fields if c in documents.columns))).alias("before"))


def event(job_id: Column, level: Column, kind: Column, message: Column, data: Column, now: float) -> Column:
    """A row of the append-only event log."""
    return F.struct(job_id.alias("job_id"), level.alias("level"), kind.alias("event_type"), F.left(message, F.lit(1000)).alias("message"), data.alias("data"), F.lit(now).alias("created_at"))


def open_conflicts(conflicts: DataFrame, found: DataFrame) -> DataFrame:
    """conflicts after new ones (same columns): an open conflict of the document is replaced and keeps its id."""
    is_open = conflicts.filter("status = 'open'").select("document_id", F.col("id").alias("old_id"))
    new = found.join(is_open, "document_id", "left").withColumn("id", F.coalesce("old_id", "id")).select(conflicts.columns)
    return conflicts.join(new.select("id"), "id", "left_anti").unionByName(new)


def notices(issues: DataFrame, app: str = "Scriptorium") -> DataFrame:
    """issues (job_id, document_id, document_title, kind, message) -> what is published about each."""
    kind = F.col("kind")
    title = F.when(kind == "ocr_conflict", "OCR conflict").when(kind == "failed", "processing failed").otherwise("review required")
    tags = F.when(kind == "ocr_conflict", F.array(F.lit("warning"), F.lit("mag"))).when(kind == "failed", F.array(F.lit("x"), F.lit("page_facing_up"))).otherwise(F.array(F.lit("warning"), F.lit("page_facing_up")))
    named = F.coalesce(F.nullif("document_title", F.lit("")), F.concat(F.lit("Document "), F.col("document_id").cast("string")))
    text = F.format_string("%s (document #%d)\n%s", named, "document_id", "message")
    return issues.select("job_id", F.left(F.concat(F.lit(f"{app}: "), title), F.lit(200)).alias("title"), F.left(text, F.lit(1000)).alias("message"), tags.alias("tags"))


def outage_starts(states: DataFrame, key: str, order: str) -> DataFrame:
    """states (key, order, ok): the rows at which something that was well is not; one notice an outage."""
    from pyspark.sql import Window

    before = F.lag("ok").over(Window.partitionBy(key).orderBy(order))
    return states.withColumn("_before", F.coalesce(before, F.lit(True))).filter(~F.col("ok") & F.col("_before")).drop("_before")


def fingerprint(config: Column) -> Column:
    """SHA-256 of a configuration's JSON; a change of any field discards what was made with it."""
    return F.sha2(F.to_json(config).cast("binary"), 256)


def bounded(diagnostics: DataFrame, limit: int = 50) -> DataFrame:
    """(key, pos, entry) -> at most limit entries a key; the last then counts what is left out."""
    from pyspark.sql import Window

    d = diagnostics.withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter((F.col("n") <= limit) | (F.col("pos") < limit))
    over = (F.col("n") > limit) & (F.col("pos") == limit - 1)
    return d.select("key", "pos", F.when(over, F.format_string("diagnostic_limit: %d omitted", F.col("n") - limit + 1)).otherwise(F.col("entry")).alias("entry"))


CHOICE = "existing_id long, new_name string, confidence double, reason string, evidence string, source_pages array<int>"
CHOICE_KEYS = ["existing_id", "new_name", "confidence", "reason", "evidence", "source_pages"]


def parsed_choice(answer: Column) -> Column:
    """struct(choice, error) of a model's answer, without its code fence.

    Closed world: unknown keys are errors. Exactly one of existing_id and new_name;
    pages become sorted and unique; names collapse and are cut to 100 characters.
    """
    text = F.regexp_replace(answer, "(?isdU)" + tx.CODE_FENCE, "$1")
    v = F.from_json(text, CHOICE)
    keys = F.json_object_keys(text)
    name = F.nullif(F.left(tx.collapsed(v["new_name"]), F.lit(100)), F.lit(""))
    given = v["existing_id"].isNotNull()
    error = (
        F.when(keys.isNull(), "not an object")
        .when(F.size(F.array_except(keys, F.array(*map(F.lit, CHOICE_KEYS)))) > 0, "extra keys")
        .when(given == name.isNotNull(), "exactly one of existing_id and new_name")
        .when(~F.coalesce(v["confidence"].between(0, 1), F.lit(False)), "confidence outside 0 to 1")
        .when(~F.coalesce(F.length(v["reason"]).between(1, 500), F.lit(False)), "reason of 1 to 500 characters")
        .when(F.length(v["evidence"]) > 500, "evidence too long")
        .when(F.size(v["source_pages"]) > 30, "too many pages")
    )
    made = F.struct(v["existing_id"].alias("existing_id"), name.alias("new_name"), v["confidence"].alias("confidence"), v["reason"].alias("reason"), F.coalesce(v["evidence"], F.lit("")).alias("evidence"), F.sort_array(F.array_distinct(F.coalesce(v["source_pages"], F.array().cast("array<int>")))).alias("source_pages"))
    return F.struct(F.when(error.isNull(), made).alias("choice"), error.alias("error"))


def content(answer: Column) -> Column:
    """The text of a chat answer: a string, or the joined texts of its parts; null if empty."""
    raw = F.get_json_object(answer, "$.choices[0].message.content")
    parts = F.from_json(raw, "array<struct<text:string>>")
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")
    return F.nullif(F.when(F.ltrim(raw).startswith("["), F.coalesce(joined, raw)).otherwise(raw), F.lit(""))


def render_scale(width: Column, height: Column, dpi: int, most_pixels: int) -> Column:
    """Scale at which a page (in points) is rendered without passing a number of pixels."""
    scale = F.lit(dpi / 72.0)
    pixels = width * height * scale * scale
    return scale * F.least(F.lit(1.0), F.sqrt(F.lit(float(most_pixels)) / pixels))
