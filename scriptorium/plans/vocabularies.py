"""Queries over the controlled vocabulary: part names stand for tags, line items for usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.operators import vocabulary as ops
from scriptorium.plans.texts import duck_tokens
from scriptorium.sources.tables import table


def _names(spark, sf_dir):
    """Each part name once: id is its smallest key, usage its line items."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    used = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return p.join(used, "p_partkey", "left").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"), F.coalesce(F.sum("n"), F.lit(0)).alias("document_count")).select(F.lit("tag").alias("kind"), "id", "name", "document_count", F.col("id").alias("position"))


def _variants(spark, sf_dir):
    """The names and forms of them that repeat each: plural, generic word added, modifier in front."""
    n = _names(spark, sf_dir)
    made = [n.select("kind", (F.col("id") + k * 1_000_000).alias("id"), form.alias("name"), F.lit(0).cast("long").alias("document_count"), (F.col("position") + k * 1_000_000).alias("position")) for k, form in ((1, F.concat("name", F.lit("s"))), (2, F.concat("name", F.lit(" files"))), (3, F.concat(F.lit("annual "), F.col("name"))))]
    for m in made:
        n = n.union(m)
    return n


def vocabulary_tokens(spark, sf_dir):
    v = _variants(spark, sf_dir).withColumn("t", tx.name_tokens(F.col("name"), "tag"))
    return v.select("id", F.array_join("t", " ").alias("tokens"), tx.compact(F.col("t")).alias("compact"), tx.initials(F.col("t")).alias("initials"))


def vocabulary_listing(spark, sf_dir):
    return ops.listing(_names(spark, sf_dir), 20).select("id", "name", "document_count", "rank")


def hidden_vocabulary_filter(spark, sf_dir):
    n = _names(spark, sf_dir).withColumn("is_inbox_tag", F.col("id") % 5 == 0)
    return ops.visible(n, ops.hidden_names("Cold X,, old  widget", " Hot BOLT ")).select("id", "name")


def visible_document_tags(spark, sf_dir):
    n = _names(spark, sf_dir).withColumn("is_inbox_tag", F.col("id") % 5 == 0)
    li = table(spark, sf_dir, "lineitem")
    d = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list("l_partkey")).alias("tags"))
    return ops.visible_tags(d, n, []).select("id", F.array_join("tags", ",").alias("tags"))


def lexical_duplicates(spark, sf_dir):
    return ops.duplicates(_names(spark, sf_dir)).select("key", "keep_id", "keep_name", "merge_id", "merge_name", "score", "reason")


def lexical_variants(spark, sf_dir):
    """Duplicates among names and their variants that are equal once normalised, or modified."""
    d = ops.duplicates(_variants(spark, sf_dir))
    return d.filter("score = 1.0").select("key", "keep_id", "merge_id", "reason")


def canonical_pair_order(spark, sf_dir):
    n = _names(spark, sf_dir).select(F.struct("id", F.col("document_count").alias("usage"), "name").alias("x"), (F.col("id") % 8).alias("g"))
    p = n.select(F.col("x").alias("a"), "g").join(n.select(F.col("x").alias("b"), "g"), "g").filter("a.id < b.id")
    return ops.canonical_order(p).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), F.col("keep.id").alias("keep_id"))


def merge_entities_effect(spark, sf_dir):
    """Assignments of parts to orders after merging each odd key into the even one before it."""
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.lit("tag").alias("kind"), F.col("l_partkey").alias("id"))
    m = table(spark, sf_dir, "part").filter("p_partkey % 2 = 1").select(F.lit("tag").alias("kind"), F.col("p_partkey").alias("merge_id"), (F.col("p_partkey") - 1).alias("keep_id"))
    return ops.merge_assignments(a, m).groupBy("id").agg(F.count("*").alias("n_documents"))


def reviewed_suggestions(spark, sf_dir):
    """Lexical suggestions and pairs named by a model, without those of dismissed keys."""
    n = _names(spark, sf_dir)
    model = n.select("kind", F.col("id").alias("keep_id"), (F.col("id") + 1).alias("merge_id"), F.lit("same subject").alias("reason"), "position")
    found = ops.review(ops.duplicates(n), model, n)
    dismissed = n.filter("id % 3 = 0").select(F.concat_ws(":", "kind", F.col("id"), F.col("id") + 1).alias("key"))
    return ops.without_dismissed(found, dismissed).select("key", "keep_id", "merge_id", "reason", "source")


def _long_words(spark, sf_dir):
    """The words of five letters or more, with the number of documents that hold each, as a vocabulary."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("name")).filter(F.length("name") >= 5)
    top = t.groupBy("name").agg(F.count("*").alias("document_count"))
    return top.select(F.lit("tag").alias("kind"), F.xxhash64("name").alias("id"), "name", "document_count", F.lit(0).alias("position"))


def candidate_ranking(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text", F.array().cast("array<long>").alias("current_ids"))
    r = ops.rank_candidates(docs, _long_words(spark, sf_dir), "tag", 20)
    return r.select("document_id", "name", F.round("score", 4).alias("score"), "rank")


def best_duplicates(spark, sf_dir):
    """What each modified name repeats: the name it modifies, or one that is nearer."""
    n = _names(spark, sf_dir)
    p = n.select("kind", "id", F.concat("name", F.lit(" records")).alias("name"))
    return ops.best_duplicate(p, n).select("id", "matched_id", "score", "reason")


NAMES = "SELECT p_name AS name, min(p_partkey) AS id, coalesce(sum(n), 0)::BIGINT AS document_count FROM part LEFT JOIN (SELECT l_partkey AS p_partkey, count(*) AS n FROM lineitem GROUP BY 1) USING (p_partkey) GROUP BY 1"
VARIANTS = f"""WITH n AS ({NAMES}), v AS (SELECT id, name, document_count FROM n UNION ALL SELECT id + 1000000, name || 's', 0 FROM n UNION ALL SELECT id + 2000000, name || ' files', 0 FROM n UNION ALL SELECT id + 3000000, 'annual ' || name, 0 FROM n),
 w AS (SELECT id, unnest(regexp_extract_all(strip_accents(lower(name)), '[\\p{{L}}\\p{{N}}]+')) AS t, generate_subscripts(regexp_extract_all(strip_accents(lower(name)), '[\\p{{L}}\\p{{N}}]+'), 1) AS k FROM v),
 s AS (SELECT id, k, CASE WHEN t IN ('taxes') THEN 'tax' WHEN t = 'policies' THEN 'policy' WHEN t = 'receipts' THEN 'receipt' WHEN t = 'invoices' THEN 'invoice' WHEN t LIKE '%ies' AND length(t) > 4 THEN left(t, length(t) - 3) || 'y'
   WHEN t LIKE '%s' AND length(t) > 3 AND t NOT LIKE '%ss' AND t NOT LIKE '%us' AND t NOT LIKE '%is' THEN left(t, length(t) - 1) ELSE t END AS t FROM w),
 k AS (SELECT v.id, any_value(name) AS name, any_value(document_count) AS document_count, coalesce(string_agg(t, ' ' ORDER BY k) FILTER (t NOT IN ('document','documents','record','records','file','files')), '') AS tokens FROM v LEFT JOIN s ON s.id = v.id GROUP BY v.id)"""
ORACLES = {
    "vocabulary_tokens": f"{VARIANTS} SELECT id, tokens, replace(tokens, ' ', '') AS compact, array_to_string(list_transform(string_split(tokens, ' '), lambda x: x[1]), '') AS initials FROM k",
    "vocabulary_listing": f"SELECT id, name, document_count, (row_number() OVER (ORDER BY document_count DESC, lower(name), id))::INTEGER AS rank FROM ({NAMES}) QUALIFY rank <= 20",
    "hidden_vocabulary_filter": f"SELECT id, name FROM ({NAMES}) WHERE id % 5 <> 0 AND lower(name) NOT IN ('cold x', 'old widget', 'hot bolt')",
    "visible_document_tags": f"""SELECT l_orderkey AS id, coalesce(array_to_string(list(l_partkey ORDER BY l_partkey) FILTER (l_partkey NOT IN (SELECT id FROM ({NAMES}) WHERE id % 5 = 0)), ','), '') AS tags FROM lineitem GROUP BY 1""",
    "lexical_duplicates": f"""WITH n AS ({NAMES}), k AS (SELECT *, replace(lower(name), ' ', '') AS c FROM n), p AS (
 SELECT a.id AS aid, b.id AS bid, a.name AS an, b.name AS bn, a.document_count AS au, b.document_count AS bu, greatest(2.0 * least(length(a.c), length(b.c)) / (length(a.c) + length(b.c)), 0.96 * least(length(a.c), length(b.c)) / greatest(length(a.c), length(b.c))) AS score
 FROM k a JOIN k b ON a.id < b.id AND (contains(a.c, b.c) OR contains(b.c, a.c))), f AS (SELECT *, (au > bu OR (au = bu AND (length(an) > length(bn) OR (length(an) = length(bn) AND an <= bn)))) AS first FROM p WHERE score >= 0.86)
 SELECT 'tag:' || aid || ':' || bid AS key, CASE WHEN first THEN aid ELSE bid END AS keep_id, CASE WHEN first THEN an ELSE bn END AS keep_name, CASE WHEN first THEN bid ELSE aid END AS merge_id, CASE WHEN first THEN bn ELSE an END AS merge_name,
 round(score, 4)::DOUBLE AS score, 'near-duplicate normalized name (' || round_even(score * 100, 0)::INTEGER || '% similar)' AS reason FROM f""",
    "lexical_variants": f"""{VARIANTS}, p AS (SELECT a.id AS aid, b.id AS bid, a.document_count AS au, b.document_count AS bu, a.name AS an, b.name AS bn FROM k a JOIN k b ON a.id < b.id AND replace(a.tokens, ' ', '') = replace(b.tokens, ' ', '')),
 f AS (SELECT *, (au > bu OR (au = bu AND (length(an) > length(bn) OR (length(an) = length(bn) AND an <= bn)))) AS first FROM p)
 SELECT 'tag:' || aid || ':' || bid AS key, CASE WHEN first THEN aid ELSE bid END AS keep_id, CASE WHEN first THEN bid ELSE aid END AS merge_id, 'same normalized name (100% similar)' AS reason FROM f""",
    "canonical_pair_order": f"""WITH n AS ({NAMES}) SELECT a.id AS a_id, b.id AS b_id, CASE WHEN a.document_count > b.document_count OR (a.document_count = b.document_count AND (length(a.name) > length(b.name) OR (length(a.name) = length(b.name) AND a.name <= b.name))) THEN a.id ELSE b.id END AS keep_id
 FROM n a JOIN n b ON a.id % 8 = b.id % 8 AND a.id < b.id""",
    "merge_entities_effect": "SELECT id, count(DISTINCT d) AS n_documents FROM (SELECT l_orderkey AS d, CASE WHEN l_partkey % 2 = 1 AND l_partkey IN (SELECT p_partkey FROM part) THEN l_partkey - 1 ELSE l_partkey END AS id FROM lineitem) GROUP BY id",
    "candidate_ranking": f"""WITH t AS (SELECT doc_id, unnest(list_distinct({duck_tokens('text')})) AS w FROM documents),
 top AS (SELECT w AS name, count(*) AS n FROM t WHERE length(w) >= 5 GROUP BY w),
 one AS (SELECT name, n, CASE WHEN t LIKE '%ies' AND length(t) > 4 THEN left(t, length(t) - 3) || 'y' WHEN t LIKE '%s' AND length(t) > 3 AND t NOT LIKE '%ss' AND t NOT LIKE '%us' AND t NOT LIKE '%is' THEN left(t, length(t) - 1) ELSE t END AS key FROM (SELECT name, n, strip_accents(name) AS t FROM top)),
 d AS (SELECT DISTINCT doc_id, CASE WHEN t LIKE '%ies' AND length(t) > 4 THEN left(t, length(t) - 3) || 'y' WHEN t LIKE '%s' AND length(t) > 3 AND t NOT LIKE '%ss' AND t NOT LIKE '%us' AND t NOT LIKE '%is' THEN left(t, length(t) - 1) ELSE t END AS key FROM (SELECT doc_id, strip_accents(w) AS t FROM t)),
 s AS (SELECT documents.doc_id, one.name, n, (CASE WHEN d.key IS NOT NULL THEN 3.2::DOUBLE ELSE 0.0::DOUBLE END) + least(0.35::DOUBLE, ln(1 + n) / 30) AS score FROM documents CROSS JOIN one LEFT JOIN d ON d.doc_id = documents.doc_id AND d.key = one.key)
 SELECT doc_id AS document_id, name, round(score, 4) AS score, (row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 12) DESC, n DESC, name))::INTEGER AS rank FROM s QUALIFY rank <= 20""",
    "best_duplicates": f"SELECT id, id AS matched_id, 1.0::DOUBLE AS score, 'same normalized name' AS reason FROM ({NAMES})",
}
ORACLES["reviewed_suggestions"] = f"""WITH x AS (SELECT key, keep_id, merge_id, reason, 'lexical' AS source FROM ({ORACLES['lexical_duplicates']})),
 n AS ({NAMES}), m AS (SELECT 'tag:' || a.id || ':' || b.id AS key, a.id AS keep_id, b.id AS merge_id, 'same subject' AS reason, 'model' AS source FROM n a JOIN n b ON b.id = a.id + 1),
 u AS (SELECT * FROM x UNION ALL SELECT * FROM m WHERE key NOT IN (SELECT key FROM x))
 SELECT * FROM u WHERE key NOT IN (SELECT 'tag:' || id || ':' || (id + 1) FROM n WHERE id % 3 = 0)"""
QUERIES = {f.__name__: f for f in (vocabulary_tokens, vocabulary_listing, hidden_vocabulary_filter, visible_document_tags, lexical_duplicates, lexical_variants, canonical_pair_order, merge_entities_effect, reviewed_suggestions, candidate_ranking, best_duplicates)}
