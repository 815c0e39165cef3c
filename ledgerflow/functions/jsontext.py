"""JSON parsing, rendering and metadata maps, on VARIANT."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, SparkSession, functions as F

VARIANT_MAP = "map<string,variant>"


# The session setting by which VARIANT keeps the last value of a repeated key instead of refusing the text.
REPEATED_KEYS = "spark.sql.variant.allowDuplicateKeys"


def keep_last_keys(spark: SparkSession | None = None) -> None:
    """Let a session's JSON parsing keep the last value of a repeated key; the setting counts when a query is planned."""
    spark = spark or SparkSession.active()
    if spark.conf.get(REPEATED_KEYS, "false") != "true":
        spark.conf.set(REPEATED_KEYS, "true")


def strict_json(text: Column, exact: bool = True) -> Column:
    """Parse JSON strictly to VARIANT; NULL for anything that is not one value.

    ``try_parse_json`` stops after the first value and ignores what follows, so
    the text is parsed inside an array and inside an object: only a single
    complete value fits both. Of repeated keys in one object the last one's value
    stays, for which the active session is set (``keep_last_keys``); with
    ``exact=False`` its setting is left alone, and unless it was set such texts
    count as unparsable. All of it runs on the JVM.
    """
    if exact:
        keep_last_keys()
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    single = F.try_variant_get(in_array, "$[1]", "variant").isNull()
    return F.when(single & in_object.isNotNull(), F.try_variant_get(in_array, "$[0]", "variant"))


def json_or_default(text: Column, default: str, exact: bool = True) -> Column:
    """Empty or unparsable text falls back to the JSON text ``default``."""
    fallback = F.parse_json(F.lit(default))
    # An absent field is told without the parser, which refuses a text slowly.
    return F.when(text == "", fallback).otherwise(F.coalesce(strict_json(text, exact), fallback))


def variant_kind(value: Column) -> Column:
    """One of object, array, string, boolean, null, integer, decimal."""
    schema = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | (schema == "VOID"), "null")
        .when(schema.startswith("OBJECT"), "object")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema == "STRING", "string")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema == "BIGINT", "integer")
        .otherwise("decimal")
    )


def variant_truthy(value: Column) -> Column:
    """False for null, '', 0, false, [] and {}; true otherwise."""
    schema, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    known = (
        F.when(schema == "STRING", text != "")
        .when(schema == "BOOLEAN", text == "true")
        .otherwise(~text.isin("0", "0.0", "-0.0", "[]", "{}"))
    )
    return F.coalesce(known, F.lit(False))


def float_text(value: Column) -> Column:
    """Shortest text of a double: plain from 1e-4 up to 1e16, else with a signed exponent."""
    size = F.abs(value)
    digits = value.cast("decimal(38,20)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(digits, r"(\.\d*?)0+$", "$1"), r"\.$", ".0")
    raw = value.cast("string")
    exponent = F.regexp_extract(raw, r"E(-?)(\d+)$", 2)
    sign = F.when(F.regexp_extract(raw, r"E(-?)(\d+)$", 1) == "-", "-").otherwise("+")
    mantissa = F.regexp_replace(F.regexp_extract(raw, r"^(.*)E", 1), r"\.0$", "")
    scientific = F.concat(mantissa, F.lit("e"), sign, F.when(F.length(exponent) < 2, F.lpad(exponent, 2, "0")).otherwise(exponent))
    return F.when((size == 0) | ((size >= 1e-4) & (size < 1e16)), plain).otherwise(scientific)


def variant_text(value: Column) -> Column:
    """A metadata value as text, NULL for null; booleans are ``True``/``False``."""
    schema, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    fraction = schema.startswith("DECIMAL") | schema.isin("DOUBLE", "FLOAT")
    return (
        F.when(schema == "BOOLEAN", F.initcap(text))
        .when(fraction, float_text(F.try_variant_get(value, "$", "double")))
        .otherwise(text)
    )


def is_object(value: Column) -> Column:
    """The value is a JSON object."""
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def as_variant_map(value: Column) -> Column:
    """The members of a JSON object; NULL when the value is not an object."""
    return F.when(is_object(value), F.try_variant_get(value, "$", VARIANT_MAP))


def to_variant(value: Column) -> Column:
    return value.cast("variant")


def merge_metadata(base: Column, extra: Mapping[str, Column], optional: Mapping[str, Column] | None = None) -> Column:
    """Right-biased merge of a MAP<STRING, VARIANT> with fixed entries.

    ``extra`` entries are always set, even to null; an ``optional`` entry is set
    only when its column is neither NULL nor empty and otherwise leaves ``base``
    as it is. Overridden keys are removed from the base first, so no session
    setting on repeated map keys is needed.
    """
    pairs = [c for name, col in extra.items() for c in (F.lit(name), to_variant(col))]
    always = F.create_map(*pairs) if pairs else F.create_map().cast(VARIANT_MAP)
    empty = F.create_map().cast(VARIANT_MAP)
    names = list(extra)
    merged = F.map_filter(F.coalesce(base, empty), lambda k, _: ~k.isin(*names) if names else F.lit(True))
    merged = F.map_concat(merged, always)
    for name, col in (optional or {}).items():
        merged = F.when(F.coalesce(col, F.lit("")) != "", _with_entry(merged, name, col)).otherwise(merged)
    return merged


def _with_entry(base: Column, name: str, value: Column) -> Column:
    others = F.map_filter(base, lambda k, _: k != name)
    return F.map_concat(others, F.create_map(F.lit(name), to_variant(value)))


def metadata_text(metadata: Column) -> Column:
    """Metadata map as compact JSON text, NULL for a NULL map."""
    return F.to_json(metadata)


# JSON short escapes.
_SHORT_ESCAPES = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def json_quote(text: Column) -> Column:
    """Text as a JSON string literal that leaves non-ASCII characters as they are."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    # One fold over the few control characters: 32 nested calls make methods that the JVM does not compile.
    escapes = F.split(F.lit(" ".join(_SHORT_ESCAPES.get(chr(code), f"\\u{code:04x}") for code in range(32))), " ")
    escaped = F.aggregate(F.sequence(F.lit(0), F.lit(31)), out, lambda done, code: F.replace(done, F.chr(code), F.get(escapes, code)))
    out = F.when(text.rlike(r"[\x00-\x1f]"), escaped).otherwise(out)
    return F.when(text.isNull(), "null").otherwise(F.concat(F.lit('"'), out, F.lit('"')))


def sorted_json(members: Mapping[str, Column], raw: tuple[str, ...] = ()) -> Column:
    """JSON object text with sorted keys, ``", "`` and ``": "`` separators.

    Columns are texts; those named in ``raw`` already hold JSON.
    """
    parts: list[Column] = []
    for i, name in enumerate(sorted(members)):
        value = F.coalesce(members[name], F.lit("null")) if name in raw else json_quote(members[name])
        parts += [F.lit(("{" if i == 0 else ", ") + json.dumps(name, ensure_ascii=False) + ": "), value]
    return F.concat(*parts, F.lit("}")) if parts else F.lit("{}")
