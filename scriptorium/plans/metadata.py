"""Queries over typed values, plan validation and patches."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.operators import planning, values
from scriptorium.plans.vocabularies import NAMES, _names
from scriptorium.sources.tables import table


def _typed(spark, sf_dir, data_type, value, source="orders", key="o_orderkey", currency=None):
    t = table(spark, sf_dir, source).select(F.col(key).alias("id"), value.alias("value"), F.lit(data_type).alias("data_type"), F.lit(currency).cast("string").alias("currency"))
    return values.with_normalized(t, "currency" if currency else None).select("id", "value", "error")


K = F.col


def first_wins(spark, sf_dir):
    """The parts of each brand and type that share neither word of their name with an earlier one that stays."""
    word = lambda k: F.concat(F.lit(f"{k} "), F.split_part("p_name", F.lit(" "), F.lit(k)))
    rows = table(spark, sf_dir, "part").select("p_brand", "p_type", F.col("p_partkey").alias("pos"), F.array(word(1), word(2)).alias("words"))
    return planning.first_without_shared(rows, ["p_brand", "p_type"])


def normalize_values_integer(spark, sf_dir):
    v = F.concat(F.when(K("o_orderkey") % 3 == 0, " ").otherwise(""), F.format_number(K("o_orderkey") * 40000, 0), F.when(K("o_orderkey") % 7 == 0, " pcs").otherwise(""))
    return _typed(spark, sf_dir, "integer", v)


def normalize_values_float(spark, sf_dir):
    v = F.when(K("o_orderkey") % 9 == 0, "NaN").when(K("o_orderkey") % 11 == 0, "twelve").otherwise(F.concat((K("o_orderkey") * 2 + 1).cast("string"), F.lit(".5")))
    return _typed(spark, sf_dir, "float", v)


def normalize_values_date(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    v = F.when(K("o_orderkey") % 5 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).when(K("o_orderkey") % 7 == 0, "2023-02-30").otherwise(F.concat(day, F.lit("T10:00:00")))
    return _typed(spark, sf_dir, "date", v)


def normalize_values_boolean(spark, sf_dir):
    v = F.element_at(F.array(*map(F.lit, ("TRUE", " no ", "1", "maybe", "0", "Yes"))), (K("o_orderkey") % 6 + 1).cast("int"))
    return _typed(spark, sf_dir, "boolean", v)


def normalize_values_monetary(spark, sf_dir):
    amount = F.format_number(K("o_totalprice").cast("decimal(18,2)"), 2)
    v = F.when(K("o_orderkey") % 5 == 0, F.concat(F.lit("eur "), amount)).when(K("o_orderkey") % 7 == 0, F.concat(amount, F.lit("0"))).otherwise(amount)
    return _typed(spark, sf_dir, "monetary", v, currency="USD")


def normalize_values_url(spark, sf_dir):
    v = F.concat(F.lit("  "), F.when(K("page_id") % 4 == 0, F.regexp_replace("url", "^https?:", "ftp:")).otherwise(K("url")), F.lit("\n"))
    return _typed(spark, sf_dir, "url", v, "pages", "page_id")


def normalize_values_string(spark, sf_dir):
    return _typed(spark, sf_dir, "string", F.concat(F.lit(" "), F.col("text")), "documents", "doc_id")


def normalize_values_select(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(K("o_orderkey").alias("id"), F.when(K("o_orderkey") % 4 == 0, K("o_orderstatus")).otherwise(F.lower("o_orderpriority")).alias("value"))
    options = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(n).alias("label")) for i, n in (("u", "1-URGENT"), ("h", "2-HIGH"), ("F", "final"))))
    return o.withColumn("n", values.normalized(K("value"), F.lit("select"), options=options)).select("id", "n.value", "n.error")


def _choices(spark, sf_dir):
    """One choice a label: by id, by known, modified and new names, with all kinds of confidence and reason."""
    k = K("doc_id")
    n = _names(spark, sf_dir).select((F.row_number().over(_order()) - 1).alias("at"), K("id").alias("entity"), K("name").alias("entity_name"))
    lab = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("at", k % 64)
    c = lab.join(F.broadcast(n), "at", "left")  # 64 names
    existing = F.when(k % 4 == 0, K("entity")).when(k % 4 == 1, k + 10_000_000)
    name = F.when(k % 8 == 2, F.concat("entity_name", F.lit(" files"))).when(k % 8 == 3, F.concat(F.lit("Watch  "), F.lit("Tag"))).when(k % 8 == 6, F.lit("Documents")).when(k % 8 == 7, F.concat(F.lit("zq"), (k * 7919).cast("string"), F.lit("xkv"))).otherwise(F.lit(None))
    reason = F.when(k % 16 == 7, F.lit("short")).otherwise(F.lit("names the subject of the letter"))
    return c.select(k.alias("document_id"), F.lit("tag").alias("kind"), F.lit(0).alias("pos"), existing.alias("existing_id"), F.when(existing.isNull(), name).alias("new_name"), (F.lit(0.5) + (k % 10) / 20).alias("confidence"), reason.alias("reason"))


def _order():
    from pyspark.sql import Window

    return Window.orderBy("id")


def plan_validation(spark, sf_dir):
    plan = planning.validate_choices(_choices(spark, sf_dir), _names(spark, sf_dir), watch="Watch Tag")
    return plan.select("document_id", "action", "id", "name", "note", "normalized_from")


def gated_dates(spark, sf_dir):
    k = K("o_orderkey")
    v = F.when(k % 7 == 0, "soon").when(k % 5 == 0, "1850-01-01").when(k % 11 == 0, "2999-01-01").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    o = table(spark, sf_dir, "orders").select(k.alias("id"), v.alias("value"), (F.lit(0.6) + (k % 3) / 10).alias("confidence"))
    return planning.gate_date(o, "2024-01-01").select("id", "value", "note")


def apply_patch(spark, sf_dir):
    """Patches of orders as documents: tags from line items, the plan from their keys."""
    k = K("o_orderkey")
    tags = table(spark, sf_dir, "lineitem").groupBy(K("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.array_distinct(F.collect_list(K("l_suppkey")))).alias("tags"))
    o = table(spark, sf_dir, "orders").join(tags, "o_orderkey")
    maybe = lambda n, c: F.when(k % n == 0, c)
    d = o.select(
        k.alias("id"), "tags", maybe(2, K("o_custkey")).alias("correspondent"), maybe(3, F.lit(7).cast("long")).alias("document_type"),
        F.when(k % 3 == 0, " Scan ").when(k % 3 == 1, "scan 00-1").otherwise("Letter").alias("title"), F.lit("scan_001.pdf").alias("original_file_name"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"), maybe(2, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("added"),
        F.array(k % 7, F.lit(3).cast("long")).alias("new_tags"), F.lit(5).cast("long").alias("watch_tag"), maybe(5, F.lit(11).cast("long")).alias("new_correspondent"),
        maybe(7, F.lit(12).cast("long")).alias("new_document_type"), maybe(4, F.lit("A better title")).alias("new_title"), maybe(6, F.lit("2020-02-02")).alias("new_date"),
    )
    p = planning.patch(d)
    return p.select("id", F.array_join("tags", ",").alias("tags"), "correspondent", "document_type", "title", "created", F.array_join("withheld", "; ").alias("withheld"), F.array_join("patch_fields", ",").alias("patch_fields"))


def patched_custom_fields(spark, sf_dir):
    """Patches of orders with custom fields: field 1 is filled or held, fields 1 and 2 come from new definitions."""
    k, none = K("o_orderkey"), F.lit(None)
    field = lambda when, n, value, *more: F.when(when, F.struct(F.lit(n).alias("field"), value.alias("value"), *more))
    defined = lambda x: F.lit(x).alias("defined")
    planned = F.array(field(k % 5 != 0, 1, K("o_orderpriority"), defined(False)), field(k % 7 == 0, 1, K("o_orderstatus"), defined(True)), field(k % 4 == 0, 2, K("o_custkey").cast("string"), defined(True)))
    d = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.array().cast("array<long>").alias("tags"), none.cast("array<long>").alias("new_tags"), *[none.cast("long").alias(c) for c in ("correspondent", "document_type", "watch_tag", "new_correspondent", "new_document_type")],
        *[none.cast("string").alias(c) for c in ("title", "original_file_name", "created", "added", "new_title", "new_date")],
        F.array_compact(F.array(field(k % 3 != 0, 1, F.when(k % 2 == 0, "").otherwise(K("o_orderstatus"))))).alias("custom_fields"), F.array_compact(planned).alias("new_custom_fields"),
    )
    shown = F.transform("custom_fields", lambda f: F.concat(f.field.cast("string"), F.lit("="), f.value))
    return planning.patch(d).select("id", F.array_join(shown, ";").alias("custom_fields"), F.array_join("withheld", "; ").alias("withheld"), F.array_join("patch_fields", ",").alias("patch_fields"))


def decision_summary(spark, sf_dir):
    """Status of each decision and what kinds there are, from the patch."""
    p = apply_patch(spark, sf_dir)
    status = planning.decision_status(F.lit(True), F.lit(True), K("patch_fields") != "")
    return p.groupBy(status.alias("status"), "patch_fields").agg(F.count("*").alias("n"))


def vocabulary_gate(spark, sf_dir):
    """Proposals after verdicts on new names: odd suppliers renamed, every third dropped, every fifth reused."""
    s = table(spark, sf_dir, "supplier")
    k = K("s_suppkey")
    p = s.select((k % 10).alias("document_id"), F.lit("tag").alias("kind"), k.cast("int").alias("pos"), F.lit(None).cast("long").alias("existing_id"), F.lower("s_name").alias("new_name"))
    v = s.select(F.lit("tag").alias("kind"), F.concat(F.lit(" "), "s_name").alias("proposed_name"), F.when(k % 3 == 0, "drop").when(k % 5 == 0, "reuse").otherwise("create").alias("decision"), F.when(k % 5 == 0, k % 2).alias("existing_id"), F.when(k % 2 == 1, F.concat(F.lit("N"), k.cast("string"))).alias("name"), k.alias("at"))
    return planning.apply_verdicts(p, v)


def generic_titles(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "([^/]+)$", 1).alias("file"))
    return p.select("page_id", tx.generic_title(F.when(K("page_id") % 3 == 0, "Untitled ").otherwise(F.regexp_replace("file", r"\.[^.]*$", " ")), K("file")).alias("generic"), tx.download_name(F.lit(None).cast("string"), K("file"), K("page_id")).alias("download"))


def filled_custom_values(spark, sf_dir):
    """Custom values of orders after a plan that fills what is absent or empty."""
    k = K("o_orderkey")
    o = table(spark, sf_dir, "orders")
    current = o.filter("o_orderkey % 3 <> 0").select(k.alias("document_id"), F.lit(1).alias("field_id"), F.when(k % 2 == 0, "").otherwise(K("o_orderstatus")).alias("value"))
    planned = o.filter("o_orderkey % 5 <> 0").select(k.alias("document_id"), F.lit(1).alias("field_id"), K("o_orderpriority").alias("value"))
    return planning.merge_custom_values(current, planned)


INT_MAX = "2147483648"
ORACLES = {
    "first_wins": """
WITH RECURSIVE i AS (SELECT p_brand, p_type, p_partkey AS pos, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS k FROM part),
r AS (
  SELECT p_brand, p_type, pos, k, true AS stays, [a] AS firsts, [b] AS seconds FROM i WHERE k = 1
  UNION ALL SELECT i.p_brand, i.p_type, i.pos, i.k, NOT (list_contains(firsts, a) OR list_contains(seconds, b)),
    CASE WHEN list_contains(firsts, a) OR list_contains(seconds, b) THEN firsts ELSE firsts || [a] END, CASE WHEN list_contains(firsts, a) OR list_contains(seconds, b) THEN seconds ELSE seconds || [b] END
  FROM r JOIN i ON i.p_brand = r.p_brand AND i.p_type = r.p_type AND i.k = r.k + 1
) SELECT p_brand, p_type, pos FROM r WHERE stays""",
    "normalize_values_integer": f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey * 40000 < {INT_MAX} THEN (o_orderkey * 40000)::VARCHAR END AS value, CASE WHEN o_orderkey % 7 = 0 THEN 'invalid integer value' WHEN o_orderkey * 40000 >= {INT_MAX} THEN 'integer value is out of range' END AS error FROM orders",
    "normalize_values_float": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 <> 0 AND o_orderkey % 11 <> 0 THEN (o_orderkey * 2 + 1) || '.5' END AS value, CASE WHEN o_orderkey % 9 = 0 THEN 'floating-point value must be finite' WHEN o_orderkey % 11 = 0 THEN 'invalid floating-point value' END AS error FROM orders",
    "normalize_values_date": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS value, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 'invalid ISO date value' END AS error FROM orders",
    "normalize_values_boolean": "SELECT o_orderkey AS id, ['true', 'false', 'true', NULL, 'false', 'true'][o_orderkey % 6 + 1] AS value, CASE WHEN o_orderkey % 6 = 3 THEN 'invalid boolean value' END AS error FROM orders",
    "normalize_values_monetary": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'EUR' || o_totalprice::DECIMAL(18,2) WHEN o_orderkey % 7 <> 0 THEN 'USD' || o_totalprice::DECIMAL(18,2) END AS value, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 = 0 THEN 'invalid monetary value' END AS error FROM orders",
    "normalize_values_url": "SELECT page_id AS id, CASE WHEN page_id % 4 <> 0 THEN url END AS value, CASE WHEN page_id % 4 = 0 THEN 'URL must start with http:// or https://' END AS error FROM pages",
    "normalize_values_string": r"SELECT id, CASE WHEN length(v) <= 128 THEN v END AS value, CASE WHEN length(v) > 128 THEN 'string value exceeds 128 characters' END AS error FROM (SELECT doc_id AS id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS v FROM documents)",
    "normalize_values_select": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 AND o_orderstatus = 'F' THEN 'F' WHEN o_orderkey % 4 <> 0 AND o_orderpriority = '1-URGENT' THEN 'u' WHEN o_orderkey % 4 <> 0 AND o_orderpriority = '2-HIGH' THEN 'h' END AS value, CASE WHEN value IS NULL THEN 'value is not an existing select option' END AS error FROM orders",
    "plan_validation": f"""WITH n AS (SELECT id, name, row_number() OVER (ORDER BY id) - 1 AS place FROM ({NAMES})), c AS (SELECT doc_id AS k, n.id AS e, n.name FROM (SELECT DISTINCT doc_id FROM labels) LEFT JOIN n ON place = doc_id % 64)
 SELECT k AS document_id, CASE WHEN 0.5 + (k % 10) / 20.0 < 0.68 OR k % 4 = 1 OR k % 8 IN (3, 6) OR k % 16 = 7 THEN 'reject' WHEN k % 8 = 7 THEN 'create' ELSE 'reuse' END AS action,
 CASE WHEN action = 'reuse' THEN e END AS id, CASE WHEN action = 'reuse' THEN name WHEN action = 'create' THEN 'zq' || (k * 7919) || 'xkv' END AS name,
 CASE WHEN 0.5 + (k % 10) / 20.0 < 0.68 THEN 'below confidence threshold' WHEN k % 4 = 1 THEN 'unknown or wrong-type existing ID' WHEN k % 8 = 3 THEN 'hidden workflow tag' WHEN k % 8 = 6 THEN 'name has no meaningful terms' WHEN k % 16 = 7 THEN 'new vocabulary requires a specific justification' END AS note,
 CASE WHEN action = 'reuse' AND k % 8 = 2 THEN name || ' files' END AS normalized_from FROM c""",
    "gated_dates": """SELECT id, CASE WHEN note IS NULL THEN day END AS value, note FROM (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 3 = 0 THEN 'below confidence threshold' WHEN o_orderkey % 7 = 0 THEN 'not an ISO date' WHEN o_orderkey % 5 = 0 OR o_orderkey % 11 = 0 THEN 'implausible date' END AS note FROM orders)""",
    "apply_patch": """WITH t AS (SELECT l_orderkey AS k, list_sort(list_distinct(list(l_suppkey))) AS tags FROM lineitem GROUP BY 1),
 o AS (SELECT k, tags, list_sort(list_distinct(list_concat(list_filter(tags, lambda x: x <> 5), [k % 7, 3]))) AS new, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders JOIN t ON k = o_orderkey),
 p AS (SELECT k AS id, CASE WHEN new <> tags THEN array_to_string(new, ',') END AS tags, CASE WHEN k % 5 = 0 AND NOT (k % 2 = 0 AND o_custkey <> 0) THEN 11 END AS correspondent, CASE WHEN k % 7 = 0 AND k % 3 <> 0 THEN 12 END AS document_type,
   CASE WHEN k % 4 = 0 AND k % 3 < 2 THEN 'A better title' END AS title, CASE WHEN k % 6 = 0 AND k % 2 = 0 THEN '2020-02-02' END AS created,
   concat_ws('; ', CASE WHEN k % 5 = 0 AND k % 2 = 0 AND o_custkey <> 0 THEN 'correspondent: existing value preserved' END, CASE WHEN k % 7 = 0 AND k % 3 = 0 THEN 'document_type: existing value preserved' END, CASE WHEN k % 4 = 0 AND k % 3 = 2 THEN 'title: non-generic existing title preserved' END) AS withheld FROM o)
 SELECT *, concat_ws(',', CASE WHEN correspondent IS NOT NULL THEN 'correspondent' END, CASE WHEN created IS NOT NULL THEN 'created' END, CASE WHEN document_type IS NOT NULL THEN 'document_type' END, CASE WHEN tags IS NOT NULL THEN 'tags' END, CASE WHEN title IS NOT NULL THEN 'title' END) AS patch_fields FROM p""",
    "vocabulary_gate": """WITH p AS (SELECT s_suppkey % 10 AS document_id, 'tag' AS kind, s_suppkey::INTEGER AS pos, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey % 2 END AS existing_id,
   CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 2 = 1 THEN 'N' || s_suppkey ELSE lower(s_name) END AS new_name FROM supplier WHERE s_suppkey % 3 <> 0)
 SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY document_id, coalesce(existing_id::VARCHAR, 'new ' || pos) ORDER BY pos) = 1""",
    "patched_custom_fields": """WITH c AS (SELECT *, o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderstatus END END AS old FROM orders),
 p AS (SELECT *, coalesce(CASE WHEN k % 5 <> 0 AND coalesce(old, '') = '' THEN o_orderpriority ELSE old END, CASE WHEN k % 7 = 0 THEN o_orderstatus END) AS one, CASE WHEN k % 4 = 0 THEN o_custkey::VARCHAR END AS two FROM c),
 q AS (SELECT *, one IS DISTINCT FROM old OR two IS NOT NULL AS changed FROM p)
 SELECT k AS id, CASE WHEN changed THEN concat_ws(';', '1=' || one, '2=' || two) END AS custom_fields, CASE WHEN k % 5 <> 0 AND old <> '' THEN 'custom_field:1: existing value preserved' ELSE '' END AS withheld, CASE WHEN changed THEN 'custom_fields' ELSE '' END AS patch_fields FROM q""",
    "filled_custom_values": """SELECT o_orderkey AS document_id, 1 AS field_id, CASE WHEN o_orderkey % 5 <> 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 2 = 0) THEN o_orderpriority WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderstatus END AS value FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 5 <> 0""",
}
ORACLES["decision_summary"] = f"SELECT CASE WHEN patch_fields <> '' THEN 'applied' ELSE 'no_change' END AS status, patch_fields, count(*) AS n FROM ({ORACLES['apply_patch']}) GROUP BY 1, 2"
ORACLES["generic_titles"] = r"""WITH p AS (SELECT page_id, regexp_extract(url, '([^/]+)$', 1) AS file FROM pages),
 t AS (SELECT page_id, file, trim(CASE WHEN page_id % 3 = 0 THEN 'Untitled ' ELSE regexp_replace(file, '\.[^.]*$', ' ') END) AS title, regexp_replace(file, '(.)\.[^.]*$', '\1') AS stem FROM p)
 SELECT page_id, title = '' OR lower(title) IN ('untitled', 'document', 'scan', 'scanned document') OR (stem <> '' AND regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') = regexp_replace(lower(stem), '[^a-z0-9]+', '', 'g')) AS generic,
 CASE WHEN file <> '' THEN file ELSE 'document-' || page_id END AS download FROM t"""
QUERIES = {n: f for n, f in globals().items() if n in ORACLES}
