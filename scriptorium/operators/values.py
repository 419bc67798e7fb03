"""Typed field values: text in, normalised text and an error out; never an exception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as tx

# Error texts by type.
ERRORS = {
    "string": "string value exceeds 128 characters",
    "boolean": "invalid boolean value",
    "integer": "invalid integer value",
    "integer_range": "integer value is out of range",
    "float": "invalid floating-point value",
    "float_finite": "floating-point value must be finite",
    "date": "invalid ISO date value",
    "url": "URL must start with http:// or https://",
    "monetary": "invalid monetary value",
    "select": "value is not an existing select option",
    "documentlink": "document-link values require manual assignment",
}


def _result(value: Column | None, error: Column | None) -> Column:
    value = F.lit(None).cast("string") if value is None else value.cast("string")
    error = F.lit(None).cast("string") if error is None else error
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def _unless(ok: Column, kind: str) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(ERRORS[kind]))


def string(v: Column) -> Column:
    out = tx.collapsed(v)
    return _result(out, _unless(F.length(out) <= 128, "string"))


def longtext(v: Column) -> Column:
    return _result(tx.strip(v), None)


def boolean(v: Column) -> Column:
    low = F.lower(tx.strip(v))
    out = F.when(low.isin("true", "yes", "1"), True).when(low.isin("false", "no", "0"), False)
    return _result(out, _unless(out.isNotNull(), "boolean"))


def integer(v: Column) -> Column:
    plain = tx.strip(F.replace(v, F.lit(","), F.lit("")))
    well = plain.rlike(r"^[-+]?\d+$")
    n = F.when(well, plain.try_cast("decimal(38,0)"))
    inside = (n >= -(2**31)) & (n < 2**31)
    error = F.when(~well, ERRORS["integer"]).otherwise(_unless(inside, "integer_range"))
    return _result(n.cast("decimal(38,0)"), error)


def plain_double(x: Column) -> Column:
    """A finite double as Python prints it: plain from 1e-4 to below 1e16, else with an exponent.

    Java's digits always read back as x but are not always the fewest, so long ones are tried with 15 and 16, the least of all numbers with one.
    """
    as_java = x.cast("string")
    fewer = [F.when(t.cast("double") == x, t) for t in (F.format_string("%.0e", x), F.format_string("%.14e", x), F.format_string("%.15e", x))]
    digits = F.when((x != 0) & ((F.length(as_java) > 16) | (F.abs(x) < 1e-322)), F.coalesce(*fewer, as_java)).otherwise(as_java)

    def shown(d: Column) -> Column:
        short = F.rtrim(d.try_cast("decimal(38,21)").cast("string"), F.lit("0"))
        plain = F.when(~F.contains(F.upper(d), F.lit("E")), d).otherwise(tx.bound(short, lambda s: F.when(s.endswith("."), F.concat(s, F.lit("0"))).otherwise(s)))
        parts = r"^(-?\d(?:\.\d*?[1-9])?)\.?0*[eE]\+?(-?)0*(\d+)$"
        part = lambda k: F.regexp_extract(d, parts, k)
        power = F.when(F.length(part(3)) < 2, F.lpad(part(3), 2, "0")).otherwise(part(3))
        raised = F.concat(part(1), F.lit("e"), F.when(part(2) == "-", "-").otherwise("+"), power)
        return F.when(x == 0, d).when((F.abs(x) >= 1e-4) & (F.abs(x) < 1e16), plain).otherwise(raised)

    return tx.bound(digits, shown)


def floating(v: Column) -> Column:
    plain = F.lower(tx.strip(F.replace(v, F.lit(","), F.lit(""))))
    special = plain.rlike(r"^[-+]?(nan|inf|infinity)$")
    well = plain.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)(e[-+]?\d+)?$")
    x = F.when(well, plain.try_cast("double"))
    error = F.when(special, ERRORS["float_finite"]).when(~well, ERRORS["float"]).otherwise(_unless(F.abs(x) < float("inf"), "float_finite"))
    return _result(tx.bound(x, lambda y: F.when(F.abs(y) < float("inf"), plain_double(y))), error)


def date(v: Column) -> Column:
    head = F.left(v, F.lit(10))
    d = F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))
    return _result(F.date_format(d, "yyyy-MM-dd"), _unless(d.isNotNull(), "date"))


def url(v: Column) -> Column:
    out = tx.strip(v)
    return _result(out, _unless(out.startswith("http://") | out.startswith("https://"), "url"))


def monetary(v: Column, currency: Column | None = None) -> Column:
    """Amounts go through a decimal; they equal those through a double to 15 digits."""
    pattern = r"^([A-Za-z]{3})?\s*([-+]?\d+(?:\.\d{1,2})?)$"
    plain = F.replace(tx.strip(v), F.lit(","), F.lit(""))
    well = plain.rlike(pattern)
    unit = F.upper(F.coalesce(F.nullif(F.regexp_extract(plain, pattern, 1), F.lit("")), currency if currency is not None else F.lit(""), F.lit("")))
    amount = F.when(well, F.regexp_extract(plain, pattern, 2)).try_cast("decimal(38,2)")
    return _result(F.concat(unit, amount.cast("string")), _unless(well, "monetary"))


def select(v: Column, options: Column) -> Column:
    """options: array of (id, label); the first by id or folded label."""
    raw = tx.strip(v)
    found = F.get(F.filter(options, lambda o: (o["id"] == raw) | (tx.casefold(o["label"]) == tx.casefold(raw))), 0)
    return _result(found["id"], _unless(found.isNotNull(), "select"))


def normalized(v: Column, data_type: Column, currency: Column | None = None, options: Column | None = None) -> Column:
    """struct(value, error) by data type; null stays null without an error."""
    options = F.array().cast("array<struct<id:string,label:string>>") if options is None else options
    by_type = {"string": string(v), "longtext": longtext(v), "boolean": boolean(v), "integer": integer(v), "float": floating(v), "date": date(v), "url": url(v), "monetary": monetary(v, currency), "select": select(v, options), "documentlink": _result(None, F.lit(ERRORS["documentlink"]))}
    out = F.when(v.isNull(), _result(None, None))
    for name, value in by_type.items():
        out = out.when(data_type == name, value)
    return out.otherwise(_result(None, F.concat(F.lit("unsupported custom-field type: "), F.coalesce(data_type, F.lit("None")))))


def with_normalized(values: DataFrame, currency: str | None = None) -> DataFrame:
    """values (value, data_type, ...) -> value replaced by its normal form, and error."""
    n = normalized(F.col("value"), F.col("data_type"), F.col(currency) if currency else None)
    return values.withColumn("_n", n).withColumns({"value": F.col("_n.value"), "error": F.col("_n.error")}).drop("_n")
