"""Column expressions for text: slugs, normalisation, tokens, phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A character of a word, and any other character.
WORD = r"[\p{L}\p{N}_]"
NO_WORD = r"[^\p{L}\p{N}_]"


def slug(value: Column) -> Column:
    """Lower-case identifier with every other run of characters turned into one underscore."""
    cleaned = F.regexp_replace(F.lower(value.cast("string")), r"[^a-z0-9._:/=-]+", "_")
    return F.btrim(cleaned, F.lit("_"))


def squash(value: Column) -> Column:
    """Whitespace collapsed, trimmed, lower-cased."""
    return F.lower(F.btrim(F.regexp_replace(value, r"(?U)\s+", " ")))


def contains_phrase(haystack: Column, phrase: Column) -> Column:
    """Whole-word containment of a phrase in text that was squashed before."""
    pattern = F.concat(
        F.lit(r"(?<![\p{L}\p{N}_])\Q"), squash(phrase), F.lit(r"\E(?![\p{L}\p{N}_])")
    )
    return F.regexp_like(haystack, pattern)


def ascii_ratio(value: Column) -> Column:
    kept = F.length(F.regexp_replace(value, r"[^\x00-\x7F]", ""))
    return F.when(F.length(value) > 0, kept / F.length(value)).otherwise(F.lit(1.0))


def comma_list(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, ","), lambda x: F.btrim(x)), lambda x: x != "")
