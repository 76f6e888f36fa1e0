"""JSON from language models: lenient parsing, validation, coercion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import strip

#: One JSON value and nothing after it: brackets and quotes are balanced by the parser, what is left over by this.
_WHOLE = r"(?s)^\s*(?:\{.*\}|\[.*\]|\"(?:[^\"\\]|\\.)*\"|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)\s*$"

def _strict(text: Column) -> Column:
    """The value as VARIANT, null if it isn't one whole JSON value. A trailing second value makes the ends of an array."""
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    one = F.regexp_like(text, F.lit(_WHOLE)) & (F.try_variant_get(alone, "$[1]", "variant").isNull()) & alone.isNotNull()
    return F.when(one, F.try_parse_json(text))


def lenient_json(text: Column) -> Column:
    """A VARIANT from text that may stand in a code fence or between other words; null if there is no value."""
    bare = strip(F.coalesce(text, F.lit("")))
    fenced = F.regexp_replace(F.regexp_replace(bare, "^`+|`+$", ""), "^(?i:json)", "")
    bare = strip(F.when(F.startswith(bare, F.lit("```")), fenced).otherwise(bare))
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.coalesce(_strict(bare), F.when(inner != "", _strict(inner)))


def source_number(value: Column) -> Column:
    """An int from a VARIANT: whole numbers as they are, fractions cut, texts by their first digits, lists by their first, at any depth."""
    # The brackets that a value's text begins with are those of lists, each the first of the one around it.
    first = F.regexp_replace(F.to_json(value), r"^\[+", "")
    text = F.try_variant_get(F.try_parse_json(F.regexp_extract(first, r'(?s)^"(?:[^"\\]|\\.)*+"', 0)), "$", "string")
    number = F.regexp_extract(first, r"^-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?", 0).try_cast("double").try_cast("int")
    return F.when(F.startswith(first, F.lit('"')), F.regexp_extract(text, r"\d+", 0).try_cast("int")).otherwise(number)


def recipe(value: Column) -> Column:
    """The answer's fields from a VARIANT; null if `found` is missing or isn't a boolean."""
    get = lambda path, kind: F.try_variant_get(value, path, kind)
    fields = F.struct(
        get("$.found", "boolean").alias("found"),
        get("$.dish", "string").alias("dish"),
        F.coalesce(get("$.ingredients", "array<string>"), F.array().cast("array<string>")).alias("ingredients"),
        F.coalesce(get("$.steps", "array<string>"), F.array().cast("array<string>")).alias("steps"),
        source_number(get("$.source_n", "variant")).alias("source_n"),
        get("$.notes", "string").alias("notes"),
    )
    return F.when(get("$.found", "boolean").isNotNull(), fields)
