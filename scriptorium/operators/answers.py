"""Structured answers of models under closed schemas, checked and read as column expressions.

A schema is data: fields with kinds, bounds and nested schemas, two levels deep. errors() is one
expression over a VARIANT and a literal of all schemas, so each row may follow a schema of
its own; it returns the errors with their paths (`tags.3.confidence`). value() reads the typed value.
Lists are checked inside the row, item by item; nothing is exploded. Rules:

* keys that the schema does not know are errors, after those of its fields;
* a whole number may come as a number without fraction or as digits, a number as a numeric string,
  and true and false as 1 and 0; text comes as text only;
* a list that is too long gives that error alone; rules over a whole object count only if its
  fields are right; errors keep the order of the fields, and the first twelve are given;
* text is measured before white space is collapsed.

Objects that name a key twice are no JSON here.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions import text as tx

MOST_ERRORS = 12


@dataclass(frozen=True)
class Field:
    """kind: integer, number, text, any, one (a nested object), list (of objects, or of whole numbers without `of`)."""

    kind: str
    required: bool = False
    nullable: bool = False
    least: float | None = None
    most: float | None = None
    choices: tuple[str, ...] = ()
    of: str | None = None
    collapse: int = 0  # white space collapses; cut to so many characters; negative: may not be blank then


def _chosen(**before: Field) -> dict[str, Field]:
    shared = {"confidence": Field("number", True, least=0, most=1), "reason": Field("text", True, least=1, most=500), "evidence": Field("text", most=500), "source_pages": Field("list", most=30)}
    return before | shared


_KINDS = ("tag", "correspondent", "document_type")

#: Names, bounds and nesting of the answers.
SCHEMAS: dict[str, dict[str, Field]] = {
    "MetadataChoice": _chosen(existing_id=Field("integer", nullable=True), new_name=Field("text", nullable=True, collapse=100)),
    "ScalarCandidate": _chosen(value=Field("text", True, least=1, most=300, collapse=-300)),
    "CustomFieldCandidate": _chosen(field_id=Field("integer", True), value=Field("any", True)),
    "NewCustomFieldCandidate": _chosen(
        name=Field("text", True, least=1, most=100, collapse=-100),
        data_type=Field("text", True, choices=("string", "longtext", "boolean", "integer", "float", "monetary", "date", "url")),
        value=Field("any", True),
    ),
    "ChunkAnalysis": {
        "correspondent_candidates": Field("list", most=4, of="MetadataChoice"),
        "document_type_candidates": Field("list", most=4, of="MetadataChoice"),
        "tag_candidates": Field("list", most=12, of="MetadataChoice"),
        "title_candidates": Field("list", most=4, of="ScalarCandidate"),
        "date_candidates": Field("list", most=6, of="ScalarCandidate"),
        "custom_field_candidates": Field("list", most=20, of="CustomFieldCandidate"),
        "new_custom_field_candidates": Field("list", most=8, of="NewCustomFieldCandidate"),
    },
    "MetadataProposal": {
        "correspondent": Field("one", nullable=True, of="MetadataChoice"),
        "document_type": Field("one", nullable=True, of="MetadataChoice"),
        "tags": Field("list", most=20, of="MetadataChoice"),
        "title": Field("one", nullable=True, of="ScalarCandidate"),
        "document_date": Field("one", nullable=True, of="ScalarCandidate"),
        "custom_fields": Field("list", most=30, of="CustomFieldCandidate"),
        "new_custom_fields": Field("list", most=10, of="NewCustomFieldCandidate"),
        "summary": Field("text", most=700),
    },
    "VocabularyVerdict": {
        "kind": Field("text", True, choices=_KINDS),
        "proposed_name": Field("text", True, least=1, most=160),
        "decision": Field("text", True, choices=("create", "reuse", "drop")),
        "existing_id": Field("integer", nullable=True),
        "name": Field("text", nullable=True, most=100),
        "reason": Field("text", True, least=1, most=400),
    },
    "VocabularyReview": {"verdicts": Field("list", most=24, of="VocabularyVerdict")},
    "VocabularyMergeSuggestion": {"kind": Field("text", True, choices=_KINDS), "keep_id": Field("integer", True), "merge_id": Field("integer", True), "reason": Field("text", True, least=1, most=400)},
    "VocabularyAudit": {"suggestions": Field("list", most=40, of="VocabularyMergeSuggestion")},
    "TagReview": {"tags": Field("list", True, most=12, of="MetadataChoice"), "assessment": Field("text", True, least=1, most=700)},
}
#: Text that is shortened before it is measured: collapsed, and if longer than most, cut to three less and dots.
SHORTENED = {("TagReview", "assessment")}


_RULE = "name string, kind string, required boolean, nullable boolean, least double, most double, choices array<string>, of string, filled boolean, shortened boolean, wrong string"
_WRONG = {"integer": "int_type", "number": "float_type", "text": "string_type", "list": "list_type", "one": "model_type", "any": ""}
_ERRORS = "array<struct<path:string,type:string>>"


def _rules() -> Column:
    """The schemas as a literal: from a schema's name to the rules of its fields, in order."""
    rules = {
        schema: [
            {"name": name, "kind": f.kind, "required": f.required, "nullable": f.nullable, "least": f.least, "most": f.most, "choices": list(f.choices) or None, "of": f.of,
             "filled": f.collapse < 0, "shortened": (schema, name) in SHORTENED, "wrong": _WRONG[f.kind]}
            for name, f in fields.items()
        ]
        for schema, fields in SCHEMAS.items()
    }
    return F.from_json(F.lit(json.dumps(rules)), f"map<string,array<struct<{_RULE.replace(' ', ':').replace(',:', ',')}>>>")


def _kind(v: Column) -> Column:
    """First letters of a value's type: STRI, BOOL, VOID (JSON null), ARRA, OBJE, else a number; null without a value."""
    return F.left(F.schema_of_variant(v), F.lit(4))


def _as(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _number(v: Column, k: Column) -> Column:
    text = F.trim(_as(v, "string"))
    numeric = F.when(text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    return F.when(k == "STRI", numeric).when(~k.isin("VOID", "ARRA", "OBJE"), _as(v, "double"))


def _integer(v: Column, k: Column) -> Column:
    text = F.trim(_as(v, "string"))
    whole = F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("long"))
    return F.when(k == "STRI", whole).when(~k.isin("VOID", "ARRA", "OBJE") & (_as(v, "double") % 1 == 0), _as(v, "long")).when(k == "BOOL", _as(v, "int"))


def _short(text: Column, most: Column) -> Column:
    return tx.bound(tx.collapsed(text), lambda t: F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(F.left(t, most - 3), r"(?U)\s+\z", ""), F.lit("..."))))


def _scalar_error(v: Column, k: Column, r: Column) -> Column:
    """What is wrong with a value by its field's rule, lists and objects aside; null if nothing is."""

    def of_number(x: Column) -> Column:
        return F.when(x.isNull(), r["wrong"]).when(x > r["most"], "less_than_equal").when(x < r["least"], "greater_than_equal")

    def of_text(x: Column) -> Column:
        length = F.length(x)
        literal = r["choices"].isNotNull() & ~F.coalesce(F.array_contains(r["choices"], x), F.lit(False))
        blank = r["filled"] & (tx.collapsed(x) == "")
        return F.when(literal, "literal_error").when(x.isNull(), r["wrong"]).when(length < r["least"], "string_too_short").when(length > r["most"], "string_too_long").when(blank, "value_error")

    text = F.when(k == "STRI", _as(v, "string"))
    text = F.when(r["shortened"], _short(text, r["most"].cast("int"))).otherwise(text)
    number = F.when(r["kind"] == "integer", _integer(v, k)).otherwise(_number(v, k))
    return (
        F.when(v.isNull(), F.when(r["required"], "missing"))
        .when((r["kind"] == "any") | ((k == "VOID") & r["nullable"]), F.lit(None).cast("string"))
        .when(k == "VOID", F.when(r["choices"].isNotNull(), "literal_error").otherwise(r["wrong"]))
        .when(r["kind"] == "text", tx.bound(text, of_text))
        .when(r["kind"].isin("integer", "number"), tx.bound(number, of_number))
        .when((r["kind"] == "list") & (k != "ARRA"), r["wrong"])
        .when((r["kind"] == "list") & (F.size(_as(v, "array<variant>")) > r["most"]), "too_long")
    )


def _error(path: Column, kind: Column) -> Column:
    return F.struct(path.alias("path"), kind.alias("type"))


def _one_if(kind: Column, path: Column) -> Column:
    return tx.bound(kind, lambda k: F.when(k.isNull(), F.array().cast(_ERRORS)).otherwise(F.array(_error(path, k))))


def _object_errors(v: Column, schema: Column, rules: Column, path: Column, nested: bool) -> Column:
    """Errors of an object by its schema's rules; nested: whether its fields may be objects themselves."""
    below = lambda name: F.when(path == "", name).otherwise(F.concat(path, F.lit("."), name))

    def of_field(x: Column, r: Column, at: Column) -> Column:
        k, item_at = _kind(x), lambda i: F.concat(at, F.lit("."), i.cast("string"))
        numbers = lambda: F.flatten(F.transform(_as(x, "array<variant>"), lambda y, i: _one_if(F.when(_integer(y, _kind(y)).isNull(), "int_type"), item_at(i))))
        wrong = _scalar_error(x, k, r)
        inside = F.when((r["kind"] == "list") & r["of"].isNull() & (k == "ARRA"), numbers())
        if nested:
            objects = F.transform(_as(x, "array<variant>"), lambda y, i: _object_errors(y, r["of"], rules, item_at(i), False))
            inside = inside.when((r["kind"] == "list") & (k == "ARRA"), F.flatten(objects)).when((r["kind"] == "one") & (k != "VOID"), _object_errors(x, r["of"], rules, at, False))
        return tx.bound(wrong, lambda w: F.when(w.isNull(), F.coalesce(inside, F.array().cast(_ERRORS))).otherwise(F.array(_error(at, w))))

    def of_keys(m: Column) -> Column:
        fields = rules[schema]
        found = F.flatten(F.transform(fields, lambda r: of_field(m[r["name"]], r, below(r["name"]))))
        extra = F.array_sort(F.array_except(F.map_keys(m), F.transform(fields, lambda r: r["name"])))
        found = F.concat(found, F.transform(extra, lambda key: _error(below(key), F.lit("extra_forbidden"))))
        value_, name = m["existing_id"], m["new_name"]
        named = F.coalesce(F.length(F.when(_kind(name) == "STRI", _as(name, "string"))) > 0, F.lit(False))
        both_or_none = (schema == "MetadataChoice") & (F.coalesce(_kind(value_) != "VOID", F.lit(False)) == named)
        return tx.bound(found, lambda e: F.when((F.size(e) == 0) & both_or_none, F.array(_error(path, F.lit("value_error")))).otherwise(e))

    keys = F.when(_kind(v) == "OBJE", _as(v, "map<string,variant>"))
    return F.when(keys.isNull(), F.array(_error(path, F.lit("model_type")))).otherwise(tx.bound(keys, of_keys))


def parsed(answer: Column) -> Column:
    """The VARIANT of an answer without its code fence; null if it is no JSON."""
    return F.try_parse_json(F.regexp_replace(answer, "(?isdU)" + tx.CODE_FENCE, "$1"))


def errors(v: Column, schema: Column) -> Column:
    """The first MOST_ERRORS errors of parsed answers; each row may have a schema of its own."""
    found = tx.bound(_rules(), lambda rules: _object_errors(v, schema, rules, F.lit(""), True))
    return F.slice(F.when(v.isNull(), F.array(_error(F.lit(""), F.lit("json_invalid")))).otherwise(found), 1, MOST_ERRORS)


def value(v: Column, schema: str) -> Column:
    """The typed value of an answer without errors, with what is left out filled in."""

    def of_field(m: Column, name: str, f: Field) -> Column:
        x = m[name]
        if f.kind == "any":
            return F.to_json(x)
        if f.kind in ("integer", "number"):
            return (_integer if f.kind == "integer" else _number)(x, _kind(x))
        if f.kind == "text":
            text = F.when(_kind(x) == "STRI", _as(x, "string"))
            text = _short(text, F.lit(int(f.most))) if (schema, name) in SHORTENED else text
            text = F.left(tx.collapsed(text), F.lit(abs(f.collapse))) if f.collapse else text
            return text if f.required or f.nullable else F.coalesce(text, F.lit(""))
        if f.kind == "one":
            return F.when(_kind(x) == "OBJE", value(x, f.of))
        items = F.coalesce(_as(x, "array<variant>"), F.array().cast("array<variant>"))
        if f.of:
            return F.transform(items, lambda i: value(i, f.of))
        numbers = F.transform(items, lambda i: _integer(i, _kind(i)))
        return F.sort_array(F.array_distinct(numbers)) if schema == "MetadataChoice" else numbers

    return tx.bound(_as(v, "map<string,variant>"), lambda m: F.struct(*(of_field(m, name, f).alias(name) for name, f in SCHEMAS[schema].items())))


def read(answer: Column, schema: str) -> Column:
    """struct(value, errors) of an answer's text: the typed value if there are no errors."""

    def checked(v: Column) -> Column:
        return tx.bound(errors(v, F.lit(schema)), lambda e: F.struct(F.when(F.size(e) == 0, value(v, schema)).alias("value"), e.alias("errors")))

    return tx.bound(parsed(answer), checked)
