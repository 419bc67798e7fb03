"""Queries over document texts: tokens, similarity, pages, chunks, transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.operators import models, pages, similarity
from scriptorium.sources.tables import table


def duck_tokens(c: str) -> str:
    """DuckDB's words of a text, as functions.text.tokens without NFKC."""
    joined = rf"regexp_replace(coalesce({c}, ''), '([\p{{L}}\p{{N}}_])-\s*\n\s*([\p{{L}}\p{{N}}_])', '\1\2', 'g')"
    bare = f"regexp_replace({joined}, '(?im){tx.PAGE_MARKER}', ' ', 'g')"
    return rf"regexp_extract_all(replace(replace(lower({bare}), 'ß', 'ss'), 'ς', 'σ'), '[\p{{L}}\p{{N}}]+')"


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _pages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("document_id"), (F.col("turn") + 1).cast("int").alias("page_number"), "text")


def token_stats(spark, sf_dir):
    t = _documents(spark, sf_dir).select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), tx.characters(F.col("t")).cast("long").alias("n_chars"))


def meaningful_text(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", tx.meaningful(tx.tokens(F.col("text"))).alias("meaningful"))


def token_counts(spark, sf_dir):
    """How often each word occurs, and in how many documents."""
    t = _documents(spark, sf_dir).select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("token"))
    return t.groupBy("token", "doc_id").count().groupBy("token").agg(F.sum("count").alias("n"), F.count("*").alias("n_documents"))


def numeric_terms(spark, sf_dir):
    t = _documents(spark, sf_dir).select("doc_id", tx.numeric_terms(tx.tokens(F.col("text"))).alias("t"))
    return t.filter(F.size("t") > 0).select("doc_id", F.size("t").cast("long").alias("n_terms"), F.array_join("t", " ").alias("terms"))


def _pairs(spark, sf_dir):
    """Each even document beside the next one; every fifth pair beside a shortened copy of itself."""
    d = _documents(spark, sf_dir)
    even = d.filter(F.col("doc_id") % 2 == 0).select((F.col("doc_id") / 2).cast("long").alias("pair_id"), F.col("text").alias("existing"))
    odd = d.filter(F.col("doc_id") % 2 == 1).select(((F.col("doc_id") - 1) / 2).cast("long").alias("pair_id"), F.col("text").alias("other"))
    both = even.join(odd, "pair_id")
    cut = F.col("existing").substr(F.lit(1), (F.length("existing") * 0.9).cast("int"))
    return both.select("pair_id", "existing", F.when(F.col("pair_id") % 5 == 0, cut).otherwise(F.col("other")).alias("generated"))


def ocr_compare_pairs(spark, sf_dir):
    return similarity.compare_pairs(_pairs(spark, sf_dir))


def mismatch_snippets(spark, sf_dir):
    return similarity.mismatch_snippets(_pairs(spark, sf_dir)).select("pair_id", F.explode("snippets").alias("s")).select("pair_id", "s.*")


def assembled_documents(spark, sf_dir):
    return pages.assemble(_pages(spark, sf_dir))


def page_round_trip(spark, sf_dir):
    return pages.disassemble(assembled_documents(spark, sf_dir))


def chunk_documents(spark, sf_dir):
    return pages.chunks(_pages(spark, sf_dir), 1000)


def chunk_page_ranges(spark, sf_dir):
    """First and last page and number of chunks of each document: packing loses no page that has text."""
    c = chunk_documents(spark, sf_dir)
    return c.groupBy("document_id").agg(F.min("page_start").alias("first_page"), F.max("page_end").alias("last_page"))


def representative_text(spark, sf_dir):
    return pages.representative_texts(_pages(spark, sf_dir), 2000)


def _scaffolded(spark, sf_dir):
    """Documents inside the scaffolding that models put around transcripts."""
    t = F.col("text")
    wrapped = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("<think>\nfirst look\n</think>\n```text\n"), t, F.lit("\n```\n")))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("<|ref|>title<|/ref|><|det|>[[1, 2]]<|/det|>"), t, F.lit("<|end|>")))
        .when(F.col("doc_id") % 4 == 2, F.concat(t, F.lit("\n\n\n \n"), t))
        .otherwise(F.concat(F.lit("\n "), t, F.lit(" \n")))
    )
    return _documents(spark, sf_dir).select("doc_id", wrapped.alias("text"))


def clean_ocr(spark, sf_dir):
    out = tx.clean_transcript(F.col("text"))
    return _scaffolded(spark, sf_dir).select("doc_id", out.alias("text"), tx.is_refusal(out).alias("refusal"))


def trim_runaway(spark, sf_dir):
    """Documents with a loop behind them: the loop goes where it makes up half of the text."""
    loop = F.repeat(F.lit("\nPage 1 of 1"), 40)
    t = _documents(spark, sf_dir).select("doc_id", F.concat("text", F.when(F.col("doc_id") % 2 == 0, loop).otherwise(F.lit(""))).alias("text"))
    return t.select("doc_id", tx.trim_loop(F.col("text")).alias("text"))


def pages_typed_text(spark, sf_dir):
    """Pages whose markup names one of three words, as the OCR test looks for its markers."""
    p = table(spark, sf_dir, "pages")
    has = F.contains("html", F.lit("<nav>")) | F.contains("html", F.lit("<form")) | F.contains("html", F.lit("<aside"))
    return p.select("page_id", has.alias("marked"), F.sha2(F.col("html").cast("binary"), 256).alias("sha256"))


def budgeted_groups(spark, sf_dir):
    """The names of each brand's parts in groups of at most 16 and 300 characters of JSON."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.length("p_name") + 2).alias("chars"))
    groups = pages.budgeted_groups(p, ["p_brand"], ["p_partkey"], "chars", 16, 300)
    return groups.select("p_brand", "p_partkey", F.col("group").alias("group_no"))


def map_reduce_stub(spark, sf_dir):
    c = chunk_documents(spark, sf_dir)
    asked = models.asked(c.select("document_id", "chunk_index", F.col("text").alias("prompt")))
    found = asked.select("document_id", "chunk_index", F.get_json_object("answer", "$.words").alias("finding"))
    return models.map_reduce(found, lambda xs: str(sum(map(int, xs))), most_items=4)


T = duck_tokens("text")
_WS = "' ' || chr(9) || chr(10) || chr(13)"
_FILLED = f"list_filter(list_transform({{}}, lambda p: trim(p, {_WS})), lambda p: p <> '')"
_CUT = "list_transform(range(0, length({0}), 968), lambda i: substr({0}, i + 1, 968))"
#: Pieces of pages, then greedy runs of them one by one; limit 1000, so 968 for a piece.
_CHUNKS = f"""
WITH RECURSIVE t AS (SELECT conv_id AS document_id, turn + 1 AS page, trim(text, {_WS}) AS t FROM conversations),
k AS (SELECT *, {_FILLED.format("regexp_split_to_array(t, '\\n\\s*\\n')")} AS paragraphs, {_FILLED.format("string_split(t, chr(10))")} AS lines FROM t),
c AS (SELECT document_id, page, CASE WHEN t = '' THEN [] WHEN length(t) <= 968 THEN [t] ELSE
    list_reduce(list_transform(CASE WHEN len(paragraphs) > 1 THEN paragraphs WHEN len(lines) > 1 THEN lines ELSE [t] END, lambda p: [p]), lambda acc, x:
      CASE WHEN length(x[1]) > 968 THEN acc || {_CUT.format("x[1]")} || ['']
        WHEN acc[len(acc)] = '' THEN acc[1:len(acc) - 1] || x
        WHEN length(acc[len(acc)]) + 2 + length(x[1]) <= 968 THEN acc[1:len(acc) - 1] || [acc[len(acc)] || chr(10) || chr(10) || x[1]]
        ELSE acc || x END, ['']::VARCHAR[]) END AS pieces FROM k),
u AS (SELECT document_id, page, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS nth FROM c),
i AS (SELECT document_id, page, '[Page ' || page || ']' || chr(10) || piece AS x, row_number() OVER (PARTITION BY document_id ORDER BY page, nth) AS k FROM u WHERE piece <> ''),
r AS (
  SELECT document_id, page, x, k, 0 AS g, length(x) + 2 AS used FROM i WHERE k = 1
  UNION ALL SELECT i.document_id, i.page, i.x, i.k, CASE WHEN used + 2 + length(i.x) > 1000 THEN g + 1 ELSE g END, CASE WHEN used + 2 + length(i.x) > 1000 THEN 2 ELSE used + 2 END + length(i.x)
  FROM r JOIN i ON i.document_id = r.document_id AND i.k = r.k + 1
), chunk AS (
  SELECT document_id, g::INTEGER AS chunk_index, min(page)::INTEGER AS page_start, max(page)::INTEGER AS page_end, string_agg(x, chr(10) || chr(10) ORDER BY k) AS text FROM r GROUP BY document_id, g
)"""
_LOOP = "CASE WHEN len({u}) >= 3 THEN list_filter(range(1, least({most}, len({u}) // 3) + 1), lambda p: {u}[len({u}) - 2 * p + 1:len({u})] = {u}[len({u}) - 3 * p + 1:len({u}) - p])[1] END"
_KEPT = f"rtrim(array_to_string({{u}}[1:len({{u}}) - (len({{u}}) - {{p}} - coalesce(list_max(list_filter(range(1, len({{u}}) - {{p}} + 1), lambda k: {{u}}[k] <> {{u}}[k + {{p}}])), 0)) // {{p}} * {{p}}], {{glue}}), {_WS})"
ORACLES = {
    "chunk_documents": f"{_CHUNKS} SELECT * FROM chunk",
    "map_reduce_stub": f"""{_CHUNKS}
SELECT document_id, sum(len(regexp_extract_all(text, '\\S+')))::BIGINT::VARCHAR AS finding, CASE WHEN count(*) = 1 THEN 0 WHEN count(*) <= 4 THEN 1 WHEN count(*) <= 16 THEN 2 WHEN count(*) <= 64 THEN 3 ELSE 4 END::INTEGER AS levels
FROM chunk GROUP BY document_id""",
    "budgeted_groups": """
WITH RECURSIVE i AS (SELECT p_brand, p_partkey, length(p_name) + 3 AS s, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part),
r AS (
  SELECT p_brand, p_partkey, k, 0 AS g, 2 + s AS used, 1 AS n FROM i WHERE k = 1
  UNION ALL SELECT i.p_brand, i.p_partkey, i.k, CASE WHEN n = 16 OR used + s > 300 THEN g + 1 ELSE g END, CASE WHEN n = 16 OR used + s > 300 THEN 2 ELSE used END + s, CASE WHEN n = 16 OR used + s > 300 THEN 1 ELSE n + 1 END
  FROM r JOIN i ON i.p_brand = r.p_brand AND i.k = r.k + 1
) SELECT p_brand, p_partkey, g::BIGINT AS group_no FROM r""",
    "representative_text": f"""
WITH t AS (SELECT conv_id AS document_id, turn + 1 AS page, trim(text, {_WS}) AS t FROM conversations),
f AS (SELECT *, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY document_id) AS n, sum(length('[Page ' || page || ']') + 3 + length(t)) OVER (PARTITION BY document_id) - 2 <= 2000 AS whole
  FROM t WHERE t <> '' WINDOW w AS (PARTITION BY document_id ORDER BY page)),
r AS (SELECT *, greatest(128, 2000 // least(n, 8) - 24) AS room FROM f
  WHERE whole OR k IN (SELECT round_even(i * (n - 1)::DOUBLE / greatest(least(n, 8) - 1, 1), 0)::BIGINT FROM range(8) x(i) WHERE i < least(n, 8))),
s AS (SELECT document_id, k, '[Page ' || page || ']' || chr(10) || CASE WHEN whole OR length(t) <= room THEN t ELSE substr(t, 1, room - greatest(32, room // 4) - 5) || ' [...] ' || right(t, greatest(32, room // 4)) END AS x FROM r)
SELECT document_id, substr(coalesce(string_agg(x, chr(10) || chr(10) ORDER BY k), ''), 1, 2000) AS text FROM (SELECT DISTINCT document_id FROM t) LEFT JOIN s USING (document_id) GROUP BY document_id""",
    "trim_runaway": f"""
WITH t AS (SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN repeat(chr(10) || 'Page 1 of 1', 40) ELSE '' END AS x FROM documents),
u AS (SELECT *, trim(x, {_WS}) AS w, string_split(trim(x, {_WS}), chr(10)) AS l, string_split(trim(x, {_WS}), ' ') AS v FROM t),
p AS (SELECT *, {_LOOP.format(u="l", most=40)} AS pl, {_LOOP.format(u="v", most=60)} AS pv FROM u),
k AS (SELECT *, CASE WHEN pl IS NOT NULL THEN {_KEPT.format(u="l", p="pl", glue="chr(10)")} END AS kl, CASE WHEN pv IS NOT NULL THEN {_KEPT.format(u="v", p="pv", glue="' '")} END AS kv FROM p)
SELECT doc_id, CASE WHEN 2 * length(kl) <= length(w) THEN kl WHEN 2 * length(kv) <= length(w) THEN kv ELSE x END AS text FROM k""",
    "token_stats": f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, coalesce(list_sum(list_transform(t, lambda x: length(x))), 0)::BIGINT AS n_chars FROM (SELECT doc_id, {T} AS t FROM documents)",
    "meaningful_text": f"SELECT doc_id, coalesce(list_sum(list_transform(t, lambda x: length(x))), 0) >= 24 AND len(list_distinct(t)) >= 5 AS meaningful FROM (SELECT doc_id, {T} AS t FROM documents)",
    "token_counts": f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_documents FROM (SELECT doc_id, unnest({T}) AS token FROM documents) GROUP BY token",
    "numeric_terms": f"SELECT doc_id, len(t) AS n_terms, array_to_string(t, ' ') AS terms FROM (SELECT doc_id, list_filter({T}, lambda x: regexp_matches(x, '[1-9]')) AS t FROM documents) WHERE len(t) > 0",
    "assembled_documents": "SELECT conv_id AS document_id, string_agg('--- Page ' || (turn + 1) || ' ---' || chr(10) || trim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10) || chr(10) ORDER BY turn) || chr(10) AS text FROM conversations GROUP BY conv_id",
    "page_round_trip": "SELECT conv_id AS document_id, (turn + 1)::INTEGER AS page_number, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM conversations",
    "chunk_page_ranges": "SELECT conv_id AS document_id, (min(turn) + 1)::INTEGER AS first_page, (max(turn) + 1)::INTEGER AS last_page FROM conversations WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' GROUP BY conv_id",
    "pages_typed_text": "SELECT page_id, contains(html, '<nav>') OR contains(html, '<form') OR contains(html, '<aside') AS marked, sha256(html) AS sha256 FROM pages",
    "ocr_compare_pairs": f"""
WITH p AS (
  SELECT e.doc_id // 2 AS pair_id, {duck_tokens('e.text')} AS l,
    CASE WHEN (e.doc_id // 2) % 5 = 0 THEN {duck_tokens("substr(e.text, 1, (length(e.text) * 0.9)::INTEGER - CASE WHEN (length(e.text) * 0.9)::INTEGER > length(e.text) * 0.9 THEN 1 ELSE 0 END)")} ELSE {duck_tokens('o.text')} END AS r
  FROM documents e JOIN documents o ON o.doc_id = e.doc_id + 1 WHERE e.doc_id % 2 = 0
), w AS (
  SELECT pair_id, 1 AS l, 0 AS r, unnest(l) AS item, generate_subscripts(l, 1) AS k, len(l) AS n FROM p
  UNION ALL SELECT pair_id, 0, 1, unnest(r), generate_subscripts(r, 1), len(r) FROM p
), i AS (
  SELECT pair_id, 't' AS kind, item, l, r FROM w
  UNION ALL SELECT pair_id, 'n', item, l, r FROM w WHERE regexp_matches(item, '[1-9]')
  UNION ALL SELECT pair_id, 's', '1 ' || item, l, r FROM w WHERE n < 3
  UNION ALL SELECT pair_id, 's', x, l, r FROM (
    SELECT pair_id, l, r, '3 ' || item || ' ' || lead(item) OVER v || ' ' || lead(item, 2) OVER v AS x FROM w WHERE n >= 3 WINDOW v AS (PARTITION BY pair_id, l ORDER BY k)) WHERE x IS NOT NULL
), c AS (SELECT pair_id, kind, item, sum(l) AS l, sum(r) AS r FROM i GROUP BY ALL),
s AS (SELECT pair_id,
    coalesce(sum(least(l, r)) FILTER (kind = 't'), 0) tb, coalesce(sum(l) FILTER (kind = 't'), 0) tl, coalesce(sum(r) FILTER (kind = 't'), 0) tr,
    coalesce(sum(least(l, r)) FILTER (kind = 's'), 0) sb, coalesce(sum(l + r) FILTER (kind = 's'), 0) sn,
    coalesce(sum(least(l, r)) FILTER (kind = 'n'), 0) nb, coalesce(sum(l) FILTER (kind = 'n'), 0) nl, coalesce(sum(r) FILTER (kind = 'n'), 0) nr,
    count(*) FILTER (kind = 't' AND l > 0 AND r > 0) cm, count(*) FILTER (kind = 't') ds FROM c GROUP BY pair_id),
m AS (SELECT p.pair_id, coalesce(tl, 0) tl, coalesce(tr, 0) tr, coalesce(nl, 0) nl, coalesce(nr, 0) nr,
    CASE WHEN coalesce(tl + tr, 0) = 0 THEN 1.0::DOUBLE ELSE (2.0 * tb)::DOUBLE / (tl + tr)::DOUBLE END t,
    CASE WHEN coalesce(ds, 0) = 0 THEN 1.0::DOUBLE ELSE cm::DOUBLE / ds::DOUBLE END v,
    CASE WHEN coalesce(sn, 0) = 0 THEN 1.0::DOUBLE ELSE (2.0 * sb)::DOUBLE / sn::DOUBLE END s,
    least(coalesce(tl, 0), coalesce(tr, 0))::DOUBLE / greatest(1, coalesce(tl, 0), coalesce(tr, 0))::DOUBLE g,
    CASE WHEN coalesce(nl + nr, 0) = 0 THEN 1.0::DOUBLE ELSE (2.0 * nb)::DOUBLE / (nl + nr)::DOUBLE END n
  FROM p LEFT JOIN s USING (pair_id)),
f AS (SELECT *, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (0.50::DOUBLE * t + 0.15::DOUBLE * v + 0.20::DOUBLE * s + 0.10::DOUBLE * g + 0.05::DOUBLE * n)
    * CASE WHEN nl > 0 AND nr > 0 AND n < 0.5 THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END)), 4) AS score FROM m)
SELECT pair_id, score, score >= 0.82 AND g >= 0.65 AND t >= 0.72 AND ((nl = 0 AND nr = 0) OR n >= 0.75) AS is_similar,
  round(t, 4) AS token_overlap, round(v, 4) AS vocabulary_overlap, round(s, 4) AS shingle_overlap, round(g, 4) AS length_agreement,
  round(n, 4) AS numeric_overlap, tl::BIGINT AS existing_tokens, tr::BIGINT AS generated_tokens FROM f""",
    "clean_ocr": r"""
WITH s AS (SELECT doc_id, CASE doc_id % 4
    WHEN 0 THEN '<think>' || chr(10) || 'first look' || chr(10) || '</think>' || chr(10) || '```text' || chr(10) || text || chr(10) || '```' || chr(10)
    WHEN 1 THEN '<|ref|>title<|/ref|><|det|>[[1, 2]]<|/det|>' || text || '<|end|>'
    WHEN 2 THEN text || chr(10) || chr(10) || chr(10) || ' ' || chr(10) || text
    ELSE chr(10) || ' ' || text || ' ' || chr(10) END AS x FROM documents),
a AS (SELECT doc_id, regexp_replace(x, '(?is)^\s*<think>.*?</think>\s*', '') AS x FROM s),
b AS (SELECT doc_id, regexp_replace(x, '(?is)^\s*```[a-z]*\s*\n?(.*?)\n?```\s*$', '\1') AS x FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(x, '(?s)<\|ref\|>.*?<\|/ref\|>|<\|det\|>.*?<\|/det\|>', '', 'g'), '<[|｜][^<>\n]{0,64}?[|｜]>', '', 'g') AS x FROM b),
d AS (SELECT doc_id, trim(regexp_replace(x, '\n(?:[ \t]*\n){2,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM c)
SELECT doc_id, text, regexp_matches(lower(text), '^(i cannot|i can''t|i am unable|i''m unable|sorry, i)') AS refusal FROM d""",
}

QUERIES = {f.__name__: f for f in (token_stats, meaningful_text, token_counts, numeric_terms, ocr_compare_pairs, mismatch_snippets, assembled_documents, page_round_trip, chunk_documents, chunk_page_ranges, representative_text, clean_ocr, trim_runaway, pages_typed_text, budgeted_groups, map_reduce_stub)}
