"""Multilingual tokens, sentences and boundary phrases of a turn."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholders, single ideographs, kana runs, hangul runs, letter words.
TOKEN = (
    r"(?i)<url>|<email>|<number>|[㐀-䶿一-鿿]|[぀-ヿー]+|[가-힯]+|"
    r"[\p{L}\p{Nl}\p{No}]+(?:['’][\p{L}\p{Nl}\p{No}]+)?"
)
SENTENCE_END = r"(?U)(?<=[.!?。！？])\s+"
START_MAX = 8
END_MAX = 6


def tokens(normalized: Column) -> Column:
    return F.transform(F.regexp_extract_all(normalized, F.lit(TOKEN), F.lit(0)), F.lower)


def sentences(normalized: Column) -> Column:
    parts = F.transform(F.split(normalized, SENTENCE_END), lambda s: F.btrim(s))
    return F.filter(parts, lambda s: s != "")


def _phrase(position: str, n: Column, words: Column) -> Column:
    return F.struct(
        F.lit(position).alias("position"), n.alias("n_tokens"), F.array_join(words, " ").alias("phrase")
    )


def _ends(words: Column, start: str, end: str) -> Column:
    """Prefixes of up to eight and suffixes of up to six tokens; nothing without tokens."""
    size = F.size(words)
    prefixes = F.transform(
        F.sequence(F.lit(1), F.least(F.lit(START_MAX), size)),
        lambda n: _phrase(start, n, F.slice(words, 1, n)),
    )
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.lit(END_MAX), size)),
        lambda n: _phrase(end, n, F.slice(words, -n, n)),
    )
    none = F.array().cast("array<struct<position:string,n_tokens:int,phrase:string>>")
    return F.when(size > 0, F.concat(prefixes, suffixes)).otherwise(none)


def boundary_phrases(turn_tokens: Column, sentence_tokens: Column) -> Column:
    """Distinct boundary phrases of a turn and of its sentences."""
    of_turn = _ends(turn_tokens, "prompt_start", "prompt_end")
    of_sentences = F.flatten(
        F.transform(sentence_tokens, lambda s: _ends(s, "sentence_start", "sentence_end"))
    )
    return F.array_distinct(F.concat(of_turn, of_sentences))
