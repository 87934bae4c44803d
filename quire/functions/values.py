"""Coercion of extracted values and rule checks, as column expressions that never fail."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "MMM d, yyyy", "dd.MM.yyyy")


def to_date(value: Column) -> Column:
    """ISO first, then day/month/year, month names and dotted dates; else null."""
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)).cast("date") for f in DATE_FORMATS])


def to_number(value: Column) -> Column:
    """Currency signs, spaces and grouping commas are left out; else null."""
    return F.regexp_replace(value, r"[^0-9.\-]", "").try_cast("decimal(18,2)")


def to_boolean(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return F.when(low.isin("true", "yes", "y", "1", "on"), True).when(low.isin("false", "no", "n", "0", "off"), False)


def coerced(value: Column, field_type: Column) -> Column:
    """The value's canonical string for a field type; null where it cannot be read."""
    return (
        F.when(field_type == "number", to_number(value).cast("string"))
        .when(field_type == "integer", to_number(value).cast("long").cast("string"))
        .when(field_type == "boolean", to_boolean(value).cast("string"))
        .when(field_type.isin("date", "datetime"), to_date(value).cast("string"))
        .otherwise(value))


def check_required(value: Column, required: Column) -> Column:
    return F.when(required & value.isNull(), "required")


def check_date(value: Column, field_type: Column) -> Column:
    return F.when((field_type == "date") & value.isNotNull() & to_date(value).isNull(), "not a date")


def check_enum(value: Column, allowed: Column) -> Column:
    return F.when(allowed.isNotNull() & value.isNotNull() & ~F.array_contains(allowed, value), "not allowed")


def check_regex(value: str, regex: str) -> Column:
    """The pattern is a column: each field has its own."""
    return F.when(F.expr(f"{regex} is not null and {value} is not null and not ({value} rlike {regex})"), "pattern")


def check_range(value: Column, field_type: Column, low: Column, high: Column) -> Column:
    n = to_number(value).cast("double")
    return F.when(field_type.isin("number", "integer") & ((n < low) | (n > high)), "out of range")


def check_length(value: Column, shortest: Column, longest: Column) -> Column:
    return F.when((F.length(value) < shortest) | (F.length(value) > longest), "length")


def errors(*checks: Column) -> Column:
    return F.filter(F.array(*checks), lambda e: e.isNotNull())


def adjusted(confidence: Column, value: Column, required: Column, invalid: Column) -> Column:
    return F.when(required & value.isNull(), 0.0).when(invalid, F.least(confidence, F.lit(0.4))).otherwise(confidence)


def decision(threshold: Column, missing: Column, invalid: Column, document: Column, weakest: Column) -> Column:
    """Where a document goes; the first reason counts."""
    return (
        F.when(threshold.isNull(), "pending_review:no_threshold").when(missing, "pending_review:missing")
        .when(invalid, "pending_review:invalid").when(document < threshold, "pending_review:document_confidence")
        .when(weakest < threshold, "pending_review:field_confidence").otherwise("validated:ok"))


# The schema fragment of each field type; a value may always be null.
TYPE_SCHEMAS = {
    "string": '{"type":["string","null"]}', "number": '{"type":["number","null"]}', "integer": '{"type":["integer","null"]}',
    "boolean": '{"type":["boolean","null"]}', "date": '{"format":"date","type":["string","null"]}',
    "datetime": '{"format":"date-time","type":["string","null"]}', "enum": '{"type":["string","null"]}',
    "array": '{"items":{},"type":["array","null"]}', "object": '{"type":["object","null"]}',
}


def type_schema(field_type: Column) -> Column:
    return reduce(lambda said, kv: F.when(field_type == kv[0], kv[1]).otherwise(said), TYPE_SCHEMAS.items(), F.lit(None).cast("string"))


def duration_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds between two timestamps without zone."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.floor((micros(end) - micros(start)) / 1000).cast("long")


def backoff(attempt: Column, first: int, factor: int, most: int) -> Column:
    return F.least(F.lit(first) * F.pow(F.lit(factor), attempt), F.lit(most)).cast("long")
