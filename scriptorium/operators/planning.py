"""Plans: which proposed metadata is reused, created or rejected, and the patch that applies it.

Choices are rows (document_id, kind, pos, existing_id, new_name, confidence, reason); all
rules are one ordered CASE after the lookups are joined, so the first that fails decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.operators import values, vocabulary
from scriptorium.sources.tables import kept

# Reasons and phrases that results depend on.
CONTRASTS = ["distinct from", "different from", "separate from", "whereas", "not covered by", "broader than", "narrower than"]
MODIFIER = "existing concept with only a modifier"
LOW = "below confidence threshold"
UNKNOWN = "unknown or wrong-type existing ID"
WATCH = "automation watch tag is workflow-only"
HIDDEN = "hidden workflow tag"
CLOSED = "vocabulary growth disabled"
VAGUE = "new vocabulary requires a specific justification"
EMPTY = "name has no meaningful terms"
MIN_CONFIDENCE, MIN_REASON = 0.68, 12


def explicit_distinction(duplicate_reason: Column, confidence: Column, reason: Column, name: Column) -> Column:
    """Whether a reason justifies a new name beside an existing one that it only modifies."""
    said = tx.casefold(reason)
    contrast = reduce(lambda a, b: a | b, (F.contains(said, F.lit(p)) for p in CONTRASTS))
    return F.coalesce((duplicate_reason == MODIFIER) & (confidence >= 0.9) & (F.length(tx.strip(reason)) >= 30) & F.contains(said, tx.casefold(name)) & contrast, F.lit(False))


def validate_choices(choices: DataFrame, entries: DataFrame, allowed: DataFrame | None = None, hidden: list[str] = (), watch: str = "", closed_kinds: list[str] = (), min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Adds action (reuse, create, reject), id, name, note, normalized_from, distinct_from.

    allowed: (document_id, kind, id) that a document may reuse; None allows all known ids.
    """
    known = entries.select("kind", F.col("id").alias("existing_id"), F.col("name").alias("known_name"))
    c = choices.join(known, ["kind", "existing_id"], "left")
    if allowed is not None:
        c = c.join(allowed.select("document_id", "kind", F.col("id").alias("existing_id"), F.lit(True).alias("ok")).distinct(), ["document_id", "kind", "existing_id"], "left")
    else:
        c = c.withColumn("ok", F.lit(True))
    proposed = choices.filter("existing_id is null and new_name is not null").select("kind", F.col("new_name").alias("name")).distinct()
    proposed = proposed.withColumn("id", F.xxhash64("kind", "name"))
    found = vocabulary.best_duplicate(proposed, entries)
    c = c.join(found.select("kind", F.col("name").alias("new_name"), "matched_id", "matched_name", F.col("reason").alias("match_reason"), F.col("score").alias("match_score")), ["kind", "new_name"], "left")
    folded = tx.fold(F.col("new_name"))
    apart = explicit_distinction(F.col("match_reason"), F.col("confidence"), F.col("reason"), F.col("matched_name"))
    given, twin = F.col("existing_id").isNotNull(), F.col("matched_id").isNotNull()
    is_hidden = (F.col("kind") == "tag") & folded.isin([*hidden, *([" ".join(watch.split()).casefold()] if watch else [])])
    is_watch = (F.col("kind") == "tag") & F.lit(bool(watch)) & (tx.casefold(F.col("new_name")) == watch.casefold())
    has_terms = F.size(tx.name_tokens(F.col("new_name"), F.col("kind"))) > 0
    note = (
        F.when(F.col("confidence") < min_confidence, LOW)
        .when(given & (F.col("known_name").isNull() | F.col("ok").isNull()), UNKNOWN)
        .when(given, F.lit(None))
        .when(is_hidden, F.when(is_watch, WATCH).otherwise(HIDDEN))
        .when(twin & ~apart, F.lit(None))
        .when(F.col("kind").isin(list(closed_kinds)), CLOSED)
        .when(F.length(tx.strip(F.col("reason"))) < MIN_REASON, VAGUE)
        .when(~has_terms, EMPTY)
    )
    c = c.withColumns({"note": note, "apart": apart})
    action = F.when(F.col("note").isNotNull(), "reject").when(given | (twin & ~F.col("apart")), "reuse").otherwise("create")
    c = c.withColumn("action", action)
    reused, made = F.col("action") == "reuse", F.col("action") == "create"
    return c.select(
        *(F.col(x) for x in choices.columns),
        "action",
        F.when(reused, F.coalesce("existing_id", "matched_id")).alias("id"),
        F.when(reused, F.coalesce("known_name", "matched_name")).when(made, F.col("new_name")).alias("name"),
        "note",
        F.when(reused & ~given, F.col("new_name")).alias("normalized_from"),
        F.when(made & twin, F.col("matched_id")).alias("distinct_from"),
        "match_score",
    )


def collapse_within_proposal(plan: DataFrame, collapse_creates: bool = False) -> DataFrame:
    """Drops accepted rows of a document and kind that repeat an earlier one by name.

    By default pairs in which both ids, or an id and a stated distinction, are equal or
    both missing are not compared; that leaves most pairs with a creation alone.
    collapse_creates compares those too.
    """
    from scriptorium.operators.similarity import name_keys, scored

    accepted = name_keys(plan.filter("action <> 'reject'").withColumn("document_count", F.lit(0)))
    side = lambda s: F.struct(*(F.col(f"{s}.{c}").alias(c) for c in ("pos", "id", "distinct_from", "tokens", "compact", "initials"))).alias(s)
    on = (F.col("l.document_id") == F.col("r.document_id")) & (F.col("l.kind") == F.col("r.kind")) & (F.col("r.pos") < F.col("l.pos"))
    pairs = accepted.alias("l").join(accepted.alias("r"), on).select(F.col("l.document_id").alias("document_id"), F.col("l.kind").alias("kind"), side("l"), side("r"))
    skipped = F.col("l.distinct_from").eqNullSafe(F.col("r.id")) | F.col("r.distinct_from").eqNullSafe(F.col("l.id"))
    if collapse_creates:
        skipped = F.coalesce((F.col("l.distinct_from") == F.col("r.id")) | (F.col("r.distinct_from") == F.col("l.id")), F.lit(False))
    near = scored(pairs.filter(~skipped), vocabulary.DUPLICATE).filter(F.col("score") >= vocabulary.DUPLICATE)
    near = near.select("document_id", "kind", F.col("l.pos").alias("pos"), F.col("r.pos").alias("earlier"))
    return first_wins(plan.filter("action <> 'reject'"), near, ["document_id", "kind"])


def first_wins(rows: DataFrame, links: DataFrame, key: list[str]) -> DataFrame:
    """Rows (key, pos, ...) that stay if each in turn goes when an earlier one that stays is linked to it.

    links: key, pos, earlier. The rows that stay are a fixpoint, found in rounds of joins: what
    waits for no earlier row stays, what is linked to it goes, and links of rows that went are void.
    Every round settles the first row of each chain at least; nothing is gathered by key.
    """
    live = kept(links.select(*key, "pos", "earlier").filter("earlier < pos").distinct())
    gone = None
    while not live.isEmpty():
        waiting = live.select(*key, "pos").distinct()
        free = live.select(*key, F.col("earlier").alias("pos")).distinct().join(waiting, [*key, "pos"], "left_anti")
        out = kept(live.join(free.withColumnRenamed("pos", "earlier"), [*key, "earlier"], "left_semi").select(*key, "pos").distinct())
        gone = out if gone is None else gone.unionByName(out)
        live = live.join(out, [*key, "pos"], "left_anti").join(out.withColumnRenamed("pos", "earlier"), [*key, "earlier"], "left_anti")
        live = kept(live.select(*key, "pos", "earlier"))
    return rows if gone is None else rows.join(gone, [*key, "pos"], "left_anti").select(rows.columns)


def first_without_shared(rows: DataFrame, key: list[str]) -> DataFrame:
    """first_wins for rows (key, pos, words array) that are linked when they share a word: (key, pos) of those that stay.

    Pairs are never made. Of rows with the same words only the first can stay, and a round takes two
    groupings by word: what is the first of each of its words stays, and what shares a word with it
    goes. Null words are shared with none; rows without a word, or with a null in key or pos, stay.
    """
    found = rows.select(*key, "pos", F.array_sort(F.array_distinct(F.array_compact("words"))).alias("words"))
    whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in [*key, "pos"])) & (F.size("words") > 0)
    stays = found.filter(~F.coalesce(whole, F.lit(False))).select(*key, "pos")
    live = kept(found.filter(whole).groupBy(*key, "words").agg(F.min("pos").alias("pos")))
    while not live.isEmpty():
        each = live.select(*key, "pos", F.explode("words").alias("word"))
        first = each.groupBy(*key, "word").agg(F.min("pos").alias("first"))
        free = each.join(first, [*key, "word"]).groupBy(*key, "pos").agg(F.every(F.col("pos") == F.col("first")).alias("free")).filter("free").select(*key, "pos")
        out = kept(free)
        stays = stays.unionByName(out)
        taken = each.join(out, [*key, "pos"], "left_semi").select(*key, "word").distinct()
        gone = each.join(taken, [*key, "word"], "left_semi").select(*key, "pos").distinct()
        live = kept(live.join(gone, [*key, "pos"], "left_anti"))
    return stays


def gate_scalar(rows: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    return rows.withColumn("note", F.when(F.col("confidence") < min_confidence, LOW))


def gate_date(rows: DataFrame, as_of: str, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """rows (value, confidence) -> value as ISO date or null, and note. as_of fixes what today is."""
    d = values.date(F.when(F.length("value") == 10, F.col("value")))["value"].cast("date")
    plausible = (F.year(d) >= 1900) & (d <= F.date_add(F.lit(as_of).cast("date"), 3660))
    note = F.when(F.col("confidence") < min_confidence, LOW).when(d.isNull(), "not an ISO date").when(~plausible, "implausible date")
    return rows.withColumn("note", note).withColumn("value", F.when(F.col("note").isNull(), F.date_format(d, "yyyy-MM-dd")))


def custom_values(proposed: DataFrame, definitions: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """proposed (document_id, pos, field_id, value, confidence), definitions (field_id, name, data_type, currency)

    -> one row a document and field, the last valid one at the place of the first; rejected rows have a note.
    """
    rows = values.with_normalized(proposed.withColumn("proposed", F.col("value")).join(definitions, "field_id", "left"), "currency")
    note = F.when(F.col("data_type").isNull(), "unknown field ID").when(F.col("confidence") < min_confidence, LOW).otherwise(F.col("error"))
    rows = rows.withColumn("note", note)
    ok = rows.filter("note is null").groupBy("document_id", "field_id").agg(F.min("pos").alias("pos"), F.max_by(F.struct("value", "name"), "pos").alias("x"))
    ok = ok.select("document_id", "field_id", "pos", F.col("x.name").alias("name"), F.col("x.value").alias("value"), F.lit(None).cast("string").alias("note"))
    return ok.unionByName(rows.filter("note is not null").withColumn("value", F.col("proposed")).select(*ok.columns))


def new_custom_fields(proposed: DataFrame, definitions: DataFrame, enabled: bool, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """proposed (document_id, pos, name, data_type, value, confidence, reason), definitions (id, name, data_type, currency)

    -> action (reuse, create, reject), field_id, value in normal form, note. A name that repeats a
    definition reuses it, with that definition's type.
    """
    entries = definitions.select(F.lit("custom_field").alias("kind"), "id", "name", F.lit(0).alias("document_count"), F.col("id").alias("position"))
    names = proposed.select(F.lit("custom_field").alias("kind"), F.xxhash64("name").alias("id"), "name").distinct()
    found = vocabulary.best_duplicate(names, entries).select("name", F.col("matched_id").alias("field_id"))
    known = definitions.select(F.col("id").alias("field_id"), F.col("data_type").alias("known_type"), "currency")
    p = proposed.join(found, "name", "left").join(known, "field_id", "left")
    p = p.withColumn("n", values.normalized(F.col("value"), F.coalesce("known_type", "data_type"), F.col("currency")))
    note = (
        F.when(F.lit(not enabled), "new definitions disabled")
        .when(F.col("confidence") < min_confidence, LOW)
        .when(F.length(tx.strip(F.col("reason"))) < MIN_REASON, "new field definitions require a specific justification")
        .otherwise(F.col("n.error"))
    )
    p = p.withColumn("note", note)
    action = F.when(F.col("note").isNotNull(), "reject").when(F.col("field_id").isNotNull(), "reuse").otherwise("create")
    return p.select("document_id", "pos", "name", action.alias("action"), F.when(F.col("note").isNull(), F.col("field_id")).alias("field_id"), F.when(F.col("note").isNull(), F.col("n.value")).alias("value"), "note")


def usable_tag(tags: DataFrame, candidate_ids: Column, growth: bool, watch: str = "", min_confidence: float = MIN_CONFIDENCE) -> Column:
    """Whether a proposed tag could be applied: a candidate, or a justified new name."""
    new = F.col("new_name").isNotNull() & F.lit(growth) & (F.length(tx.strip(F.col("reason"))) >= MIN_REASON) & (F.size(tx.name_tokens(F.col("new_name"), "tag")) > 0) & (tx.fold(F.col("new_name")) != " ".join(watch.split()).casefold())
    return (F.col("confidence") >= min_confidence) & (F.coalesce(F.array_contains(candidate_ids, F.col("existing_id")), F.lit(False)) | F.coalesce(new, F.lit(False)))


FIELDS, PLANNED = "array<struct<field:bigint,value:string>>", "array<struct<field:bigint,value:string,defined:boolean>>"


def _with_custom_fields(documents: DataFrame) -> DataFrame:
    """documents with the two columns of custom fields, in the types of FIELDS and PLANNED; missing or null ones are empty."""
    kinds = {"custom_fields": FIELDS, "new_custom_fields": PLANNED}
    given = {c: F.coalesce(F.col(c).cast(kind), F.array().cast(kind)) if c in documents.columns else F.array().cast(kind) for c, kind in kinds.items()}
    return documents.withColumns(given)


def _custom_fields(overwrite: bool) -> Column:
    """(fields, changed, withheld): custom_fields after new_custom_fields, one after the other.

    Of current values of one field the last counts. An array is folded within its row, so
    the patch needs no shuffle.
    """

    def put(fields: Column, item: Column) -> Column:
        other = F.struct(item.field.alias("field"), item.value.alias("value"))
        return F.when(F.exists(fields, lambda f: f.field == item.field), F.transform(fields, lambda f: F.when(f.field == item.field, other).otherwise(f))).otherwise(F.concat(fields, F.array(other)))

    def step(done: Column, item: Column) -> Column:
        there = F.exists(done.fields, lambda f: f.field == item.field)
        full = F.exists(done.fields, lambda f: (f.field == item.field) & (F.coalesce(f.value, F.lit("")) != ""))
        defined = F.coalesce(item.defined, F.lit(False))
        take = F.lit(overwrite) | F.when(defined, ~there).otherwise(~full)
        return F.struct(
            F.when(take, put(done.fields, item)).otherwise(done.fields).alias("fields"),
            (done.changed | take).alias("changed"),
            F.when(take | defined, done.withheld).otherwise(F.concat(done.withheld, F.array(item.field))).alias("withheld"),
        )

    current = F.aggregate(F.filter("custom_fields", lambda f: f.field.isNotNull()), F.array().cast(FIELDS), put)
    start = F.struct(current.alias("fields"), F.lit(False).alias("changed"), F.array().cast("array<bigint>").alias("withheld"))
    return F.aggregate(F.filter("new_custom_fields", lambda f: f.field.isNotNull()), start, step)


def patch(documents: DataFrame, overwrite: bool = False) -> DataFrame:
    """One conservative patch a document; null fields are not changed.

    documents: id, tags, correspondent, document_type, title, original_file_name, created, added
    (texts) and the plan as new_tags (array), watch_tag, new_correspondent,
    new_document_type, new_title, new_date. Optional: custom_fields, an array of (field,
    value), and new_custom_fields, of (field, value, defined), in the order of the plan, where
    `defined` marks values of new definitions, which fill absent fields but not empty ones.
    """
    documents = _with_custom_fields(documents)
    left = F.filter("tags", lambda t: ~F.coalesce(t == F.col("watch_tag"), F.lit(False)))
    tags = F.array_sort(F.array_distinct(F.concat(left, F.coalesce("new_tags", F.array().cast("array<long>")))))
    old = F.array_sort(F.array_distinct("tags"))
    missing = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    single = lambda new, cur: F.when(F.col(new).isNotNull() & (F.lit(overwrite) | missing(cur)), F.col(new))
    held = lambda name, new, cur, note: F.when(F.col(new).isNotNull() & ~(F.lit(overwrite) | cur), F.concat_ws(": ", F.lit(name), F.lit(note)))
    generic = tx.generic_title(F.col("title"), F.col("original_file_name"))
    day = F.left(F.coalesce("created", F.lit("")), F.lit(10))
    undated = (day == "") | (day == F.left(F.coalesce("added", F.lit("")), F.lit(10)))
    custom = _custom_fields(overwrite)
    out = documents.withColumn("custom", custom).select(
        "id",
        F.when(tags != old, tags).alias("tags"),
        single("new_correspondent", "correspondent").alias("correspondent"),
        single("new_document_type", "document_type").alias("document_type"),
        F.when(F.col("new_title").isNotNull() & (F.lit(overwrite) | generic), F.left("new_title", F.lit(128))).alias("title"),
        F.when(F.col("new_date").isNotNull() & (F.lit(overwrite) | undated), F.col("new_date")).alias("created"),
        F.when(F.col("custom.changed"), F.col("custom.fields")).alias("custom_fields"),
        F.concat(
            F.array_compact(
                F.array(
                    held("correspondent", "new_correspondent", missing("correspondent"), "existing value preserved"),
                    held("document_type", "new_document_type", missing("document_type"), "existing value preserved"),
                    held("title", "new_title", generic, "non-generic existing title preserved"),
                    held("created", "new_date", undated, "existing intrinsic date preserved"),
                )
            ),
            F.transform("custom.withheld", lambda f: F.concat(F.lit("custom_field:"), f.cast("string"), F.lit(": existing value preserved"))),
        ).alias("withheld"),
    )
    named = [F.when(F.col(c).isNotNull(), F.lit(c)) for c in ("correspondent", "created", "custom_fields", "document_type", "tags", "title")]
    return out.withColumn("patch_fields", F.array_compact(F.array(*named)))


def merge_custom_values(current: DataFrame, planned: DataFrame, overwrite: bool = False) -> DataFrame:
    """(document_id, field_id, value) after the plan: absent or empty values are filled, others only overwritten."""
    both = current.select("document_id", "field_id", F.col("value").alias("old"), F.lit(True).alias("there")).join(planned.select("document_id", "field_id", F.col("value").alias("new"), F.lit(True).alias("set")), ["document_id", "field_id"], "full")
    fill = F.col("set") & (F.lit(overwrite) | F.col("there").isNull() | (F.coalesce("old", F.lit("")) == ""))
    return both.select("document_id", "field_id", F.when(fill, F.col("new")).otherwise(F.col("old")).alias("value"))


def apply_verdicts(proposals: DataFrame, verdicts: DataFrame) -> DataFrame:
    """proposals (document_id, kind, pos, existing_id, new_name), verdicts (kind, proposed_name, decision, existing_id, name, at)

    -> proposals after the vocabulary gate: reused, renamed or dropped; of several verdicts on one
    name the last counts, of tags that end as one id the first stays.
    """
    v = verdicts.withColumn("key", tx.fold(F.col("proposed_name"))).groupBy("kind", "key").agg(F.max_by(F.struct("decision", "existing_id", "name"), "at").alias("v"))
    p = proposals.withColumn("key", F.when(F.col("existing_id").isNull(), tx.fold(F.col("new_name")))).join(v, ["kind", "key"], "left")
    p = p.filter(~F.coalesce(F.col("v.decision") == "drop", F.lit(False)))
    reuse = F.coalesce((F.col("v.decision") == "reuse") & F.col("v.existing_id").isNotNull(), F.lit(False))
    rename = F.coalesce((F.col("v.decision") == "create") & (F.coalesce("v.name", F.lit("")) != ""), F.lit(False))
    p = p.select("document_id", "kind", "pos", F.when(reuse, F.col("v.existing_id")).otherwise(F.col("existing_id")).alias("existing_id"), F.when(reuse, F.lit(None)).when(rename, F.col("v.name")).otherwise(F.col("new_name")).alias("new_name"))
    first = Window.partitionBy("document_id", "kind", F.coalesce(F.col("existing_id").cast("string"), F.concat(F.lit("new "), "pos"))).orderBy("pos")
    return p.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")


def decision_status(had_tags: Column, planned_tags: Column, patched: Column) -> Column:
    return F.when(~had_tags & ~planned_tags, "no_tags").when(patched, "applied").otherwise("no_change")
