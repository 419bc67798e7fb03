"""Queries over structured answers: one is made for each part, of one of the schemas, with faults of every kind.

The text of an answer is one SQL expression that both engines read alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import answers as ops
from scriptorium.sources.tables import table


def _field(f: ops.Field, k: str, objects: list[str]) -> list[str]:
    """SQL expressions of a field's values, the usual one first; k: a number that varies."""
    if f.kind == "integer":
        return [f"({k} % 50)", "'\"x\"'", "'1.5'", "'null'", "'\" 12 \"'", "'true'", "'2.0'", "'{}'"]
    if f.kind == "number":
        return [f"'0.' || ({k} % 10)", "'1.01'", "'-0.5'", "'\"0.5\"'", "'\"high\"'", "'null'", "'[]'", "'1'", "'false'"]
    if f.kind == "any":
        return [f"'{{\"a\":[' || {k} || ']}}'", "'null'"]
    if f.kind == "text":
        usual = f"'\"' || {_pick(k, list(f.choices))} || '\"'" if f.choices else f"'\"word  ' || {k} || '\"'"
        return [usual, "'\"\"'", "'5'", "'null'", "'\"  \"'", f"'\"' || repeat('long  word ', {int((f.most or 90) // 10 + 9)}) || '\"'", "'{}'"]
    if f.kind == "one":
        return [objects[0], "'null'", objects[1], "'5'", "'[]'"]
    if not f.of:
        return ["'[3,1,3]'", "'\"x\"'", "'[1,\"a\",2.5,\"7\",true]'", f"'[' || repeat('1,', {int(f.most)}) || '1]'", "'null'", "'[]'"]
    one, two = objects
    return [f"'[' || {one} || ',' || {two} || ']'", "'[]'", f"'[' || {one} || ']'", "'null'", "'{}'", f"'[5,' || {two} || ']'", f"'[' || repeat('{{}},', {int(f.most)}) || '{{}}]'", f"'[' || repeat({one} || ',', {int(f.most) - 1}) || {two} || ']'"]


def _pick(k: str, names: list[str]) -> str:
    return f"CASE {k} % {len(names)} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


def _object(schema: str, k: str) -> str:
    """SQL expression of an object's JSON; nested objects are columns named by their schema and 1 or 2."""
    parts = []
    for n, (name, f) in enumerate(ops.SCHEMAS[schema].items()):
        usual, *odd = _field(f, k, [f"{f.of}1", f"{f.of}2"])
        cases = " ".join(f"WHEN {5 * i + 1} THEN ',\"{name}\":' || {x}" for i, x in enumerate(odd))
        if schema == "MetadataChoice" and name in ("existing_id", "new_name"):
            usual = f"CASE WHEN {k} % 2 = {n} THEN '' || {usual} ELSE 'null' END"
        parts.append(f"CASE ({k} * 7 + {11 * n}) % 61 WHEN 0 THEN '' {cases} ELSE ',\"{name}\":' || {usual} END")
    parts.append(f"CASE {k} % 23 WHEN 4 THEN ',\"zz_extra\":1' WHEN 9 THEN ',\"aa\":null,\"Zz\":[]' ELSE '' END")
    return f"'{{' || substr({' || '.join(parts)}, 2) || '}}'"


_NESTED = sorted({f.of for fields in ops.SCHEMAS.values() for f in fields.values() if f.of})
_NAMES = list(ops.SCHEMAS)
_INNER = {f"{name}{i}": _object(name, f"(id * {a} + {b})") for name in _NESTED for i, a, b in ((1, 3, 1), (2, 5, 2))}
_SCHEMA = _pick("id", _NAMES)
_ROOT = f"CASE id % {len(_NAMES)} " + " ".join(f"WHEN {i} THEN {_object(name, 'seed')}" for i, name in enumerate(_NAMES)) + " END"
_TEXT = "CASE id % 97 WHEN 5 THEN 'no ' || body WHEN 6 THEN '[' || body || ']' WHEN 7 THEN '```json' || chr(10) || body || chr(10) || '```' ELSE body END"


def _answers(spark, sf_dir):
    """id, schema, answer: the text of a model's answer."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id")).withColumn("seed", F.floor(F.col("id") / len(_NAMES)))
    rows = rows.select("id", "seed", *(F.expr(x).alias(name) for name, x in _INNER.items()))
    rows = rows.select("id", F.expr(_SCHEMA).alias("schema"), F.expr(_ROOT).alias("body"))
    return rows.select("id", "schema", F.expr(_TEXT).alias("answer"))


def answer_errors(spark, sf_dir):
    """The first twelve errors of every answer, with their paths."""
    rows = _answers(spark, sf_dir).select("id", "schema", ops.parsed(F.col("answer")).alias("v"))
    found = rows.select("id", "schema", F.posexplode(ops.errors(F.col("v"), F.col("schema"))).alias("nth", "e"))
    return found.select("id", "schema", "nth", "e.path", F.col("e.type").alias("error"))


def answer_choices(spark, sf_dir):
    """The values of choices without errors."""
    rows = _answers(spark, sf_dir).filter("schema = 'MetadataChoice'").select("id", ops.read(F.col("answer"), "MetadataChoice").alias("x")).filter("x.value is not null").select("id", "x.value.*")
    return rows.select("id", "existing_id", "new_name", "confidence", "reason", "evidence", F.array_join("source_pages", ",").alias("pages"))


def answer_tag_reviews(spark, sf_dir):
    """The values of tag reviews without errors; long assessments are cut to 697 characters and dots."""
    rows = _answers(spark, sf_dir).filter("schema = 'TagReview'").select("id", ops.read(F.col("answer"), "TagReview").alias("x")).filter("x.value is not null").select("id", "x.value.*")
    return rows.select("id", F.size("tags").cast("long").alias("n_tags"), F.array_join(F.transform("tags", lambda t: F.coalesce(t["existing_id"].cast("string"), t["new_name"])), ",").alias("names"), "assessment")


def _rules_sql() -> str:
    null = lambda x: "NULL" if x is None else str(x)
    rows = []
    for schema, fields in ops.SCHEMAS.items():
        for n, (name, f) in enumerate(fields.items()):
            choices = "NULL" if not f.choices else "[" + ", ".join(f"'{c}'" for c in f.choices) + "]"
            of = "NULL" if f.of is None else f"'{f.of}'"
            wrong = {"integer": "int_type", "number": "float_type", "text": "string_type", "list": "list_type", "one": "model_type", "any": ""}[f.kind]
            rows.append(f"('{schema}', '{name}', {n}, '{f.kind}', {f.required}, {f.nullable}, {null(f.least)}::DOUBLE, {null(f.most)}::DOUBLE, {choices}::VARCHAR[], {of}, {f.collapse < 0}, {(schema, name) in ops.SHORTENED}, '{wrong}')")
    return "VALUES " + ", ".join(rows)


_WHOLE = r"CASE json_type({x}) WHEN 'VARCHAR' THEN CASE WHEN regexp_matches(trim({x} ->> '$'), '^[+-]?[0-9]+$') THEN try_cast(trim({x} ->> '$') AS BIGINT) END WHEN 'BOOLEAN' THEN CASE {x} ->> '$' WHEN 'true' THEN 1 ELSE 0 END WHEN 'DOUBLE' THEN CASE WHEN ({x} ->> '$')::DOUBLE % 1 = 0 THEN ({x} ->> '$')::DOUBLE::BIGINT END WHEN 'UBIGINT' THEN ({x} ->> '$')::BIGINT WHEN 'BIGINT' THEN ({x} ->> '$')::BIGINT END"
_REAL = r"CASE json_type(x) WHEN 'VARCHAR' THEN CASE WHEN regexp_matches(trim(x ->> '$'), '^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN try_cast(trim(x ->> '$') AS DOUBLE) END WHEN 'BOOLEAN' THEN CASE x ->> '$' WHEN 'true' THEN 1 ELSE 0 END WHEN 'DOUBLE' THEN (x ->> '$')::DOUBLE WHEN 'UBIGINT' THEN (x ->> '$')::DOUBLE WHEN 'BIGINT' THEN (x ->> '$')::DOUBLE END"
_COLLAPSED = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_BASE = f"""
WITH k AS (SELECT p_partkey AS id, p_partkey // {len(_NAMES)} AS seed FROM part),
i AS (SELECT id, seed, {', '.join(f'{x} AS {name}' for name, x in _INNER.items())} FROM k),
b AS (SELECT id, {_SCHEMA} AS schema, {_ROOT} AS body FROM i),
a AS (SELECT id, schema, regexp_replace({_TEXT}, '(?is)^\\s*```[a-z]*\\s*\\n?(.*?)\\n?```\\s*$', '\\1') AS t FROM b),
f(type, field, pos, kind, required, nullable, least, most, choices, of, filled, shortened, wrong) AS ({_rules_sql()}),
o0 AS (SELECT id, schema AS type, '' AS path, []::INT[] AS ord, t::JSON AS j FROM a WHERE json_valid(t)),
c0 AS (SELECT o0.*, f.* EXCLUDE (type), j -> field AS x FROM o0 JOIN f ON f.type = o0.type WHERE json_type(j) = 'OBJECT'),
n AS (
  SELECT id, of AS type, field AS path, [pos] AS ord, x AS j FROM c0 WHERE kind = 'one' AND json_type(x) <> 'NULL'
  UNION ALL SELECT id, of, field || '.' || (nth - 1), [pos, nth], item FROM (SELECT *, unnest(json_extract(x, '$[*]')) AS item, unnest(range(1, json_array_length(x)::BIGINT + 1)) AS nth FROM c0 WHERE kind = 'list' AND of IS NOT NULL AND json_type(x) = 'ARRAY' AND json_array_length(x) <= most)
),
o AS (SELECT * FROM o0 UNION ALL SELECT * FROM n),
c AS (SELECT o.*, f.* EXCLUDE (type), j -> field AS x, CASE WHEN path = '' THEN field ELSE path || '.' || field END AS place FROM o JOIN f ON f.type = o.type WHERE json_type(j) = 'OBJECT'),
m AS (SELECT *, {_WHOLE.format(x='x')} AS whole, {_REAL} AS number, CASE WHEN json_type(x) = 'VARCHAR' THEN CASE WHEN shortened AND length({_COLLAPSED.format("x ->> '$'")}) > most THEN rtrim(substr({_COLLAPSED.format("x ->> '$'")}, 1, most::INT - 3)) || '...'
    WHEN shortened THEN {_COLLAPSED.format("x ->> '$'")} ELSE x ->> '$' END END AS text FROM c),
w AS (SELECT *, CASE WHEN x IS NULL THEN CASE WHEN required THEN 'missing' END
  WHEN kind = 'any' OR (nullable AND json_type(x) = 'NULL') THEN NULL
  WHEN choices IS NOT NULL THEN CASE WHEN text IS NULL OR NOT list_contains(choices, text) THEN 'literal_error' END
  WHEN json_type(x) = 'NULL' THEN wrong
  WHEN kind = 'text' THEN CASE WHEN text IS NULL THEN wrong WHEN length(text) < least THEN 'string_too_short' WHEN length(text) > most THEN 'string_too_long' WHEN filled AND {_COLLAPSED.format('text')} = '' THEN 'value_error' END
  WHEN kind = 'integer' THEN CASE WHEN whole IS NULL THEN wrong END
  WHEN kind = 'number' THEN CASE WHEN number IS NULL THEN wrong WHEN number > most THEN 'less_than_equal' WHEN number < least THEN 'greater_than_equal' END
  WHEN kind = 'list' THEN CASE WHEN json_type(x) <> 'ARRAY' THEN wrong WHEN json_array_length(x) > most THEN 'too_long' END END AS error FROM m),
e1 AS (
  SELECT id, []::INT[] AS home, []::INT[] AS ord, '' AS path, 'json_invalid' AS error FROM a WHERE NOT json_valid(t)
  UNION ALL SELECT id, ord, ord, path, 'model_type' FROM o WHERE json_type(j) <> 'OBJECT'
  UNION ALL SELECT id, ord, ord || [pos], place, error FROM w WHERE error IS NOT NULL
  UNION ALL SELECT id, ord, ord || [pos, nth::INT], place || '.' || (nth - 1), 'int_type' FROM (
    SELECT *, unnest(json_extract(x, '$[*]')) AS item, unnest(range(1, json_array_length(x)::BIGINT + 1)) AS nth FROM w WHERE kind = 'list' AND of IS NULL AND error IS NULL AND json_type(x) = 'ARRAY') WHERE ({_WHOLE.format(x='item')}) IS NULL
  UNION ALL SELECT id, ord, ord || [1000 + rank() OVER (PARTITION BY id, path ORDER BY key)::INT], CASE WHEN path = '' THEN key ELSE path || '.' || key END, 'extra_forbidden'
    FROM (SELECT id, type, ord, path, unnest(json_keys(j)) AS key FROM o WHERE json_type(j) = 'OBJECT') u WHERE NOT EXISTS (FROM f WHERE f.type = u.type AND f.field = u.key)
),
e2 AS (
  SELECT * FROM e1 UNION ALL SELECT id, ord, ord || [2000], path, 'value_error' FROM o WHERE type = 'MetadataChoice' AND json_type(j) = 'OBJECT' AND NOT EXISTS (FROM e1 WHERE e1.id = o.id AND e1.home = o.ord)
    AND coalesce(json_type(j -> 'existing_id') <> 'NULL', false) = coalesce(json_type(j -> 'new_name') = 'VARCHAR' AND length(j ->> 'new_name') > 0, false)
),
e AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY ord) - 1 AS nth, path, error FROM e2)"""

ORACLES = {
    "answer_errors": f"{_BASE} SELECT id, schema, nth::INTEGER AS nth, path, error FROM e JOIN a USING (id) WHERE nth < 12",
    "answer_choices": f"""{_BASE}
SELECT id, {_WHOLE.format(x="(j -> 'existing_id')")} AS existing_id, substr({_COLLAPSED.format("j ->> 'new_name'")}, 1, 100) AS new_name, number AS confidence, j ->> 'reason' AS reason, coalesce(j ->> 'evidence', '') AS evidence,
  array_to_string(list_sort(list_distinct(list_transform(coalesce(json_extract(j -> 'source_pages', '$[*]'), []), lambda p: {_WHOLE.format(x='p')}))), ',') AS pages
FROM w WHERE type = 'MetadataChoice' AND path = '' AND field = 'confidence' AND id NOT IN (SELECT id FROM e)""",
    "answer_tag_reviews": f"""{_BASE}
SELECT id, json_array_length(j -> 'tags')::BIGINT AS n_tags, text AS assessment,
  array_to_string(list_transform(json_extract(j -> 'tags', '$[*]'), lambda t: coalesce(({_WHOLE.format(x="(t -> 'existing_id')")})::VARCHAR, substr({_COLLAPSED.format("t ->> 'new_name'")}, 1, 100))), ',') AS names
FROM w WHERE type = 'TagReview' AND field = 'assessment' AND id NOT IN (SELECT id FROM e)""",
}

QUERIES = {f.__name__: f for f in (answer_errors, answer_choices, answer_tag_reviews)}
