"""Protected literals, numbers and locked spans of prompts, and checks that they survive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numbers, with a Unicode or an ASCII idea of "inside a word".
NUMBER = r"(?U)(?<!\w)[+-]?\d+(?:[.,:]\d+)*(?:st|nd|rd|th)?"
NUMBER_ASCII = r"(?<![A-Za-z0-9_])[+-]?\d+(?:[.,:]\d+)*(?:st|nd|rd|th)?"

# Quoted strings, URLs and e-mail addresses that must stay unchanged.
QUOTED = r"""(?U)"([^"\n]+)"|“([^”\n]+)”|(?<!\w)'([^'\n]+)'"""
QUOTED_EACH = (r'"([^"\n]+)"', r"“([^”\n]+)”", r"(?U)(?<!\w)'([^'\n]+)'")
URL = r"""https?://[^\s<>"']+"""
EMAIL = r"(?U)\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b"

# Nine families of literals protected in paraphrases.
LITERALS = (
    r"https?://[^\s,;]+",
    r"(?U)\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b",
    r"(?U)#[\w-]+",
    r"""(?U)"[^"\n]+"|(?<!\w)'[^'\n]+'(?!\w)""",
    r"-?\d+(?:\.\d+)?,-?\d+(?:\.\d+)?",
    r"(?U)\$\s?\d[\d,]*(?:\.\d+)?",
    r"(?U)\b\d+(?:[.:,-]\d+)*(?:\s?(?:AM|PM|am|pm|%|m|s|min|h|day|week|month|year)s?)?\b",
    r"(?U)\b[A-Z][A-Z0-9_-]{1,}\b",
    r"(?U)\b(?:Open|Cloud|Online)[A-Z][A-Za-z0-9_-]*\b",
)

# Temporal and scope expressions locked in paraphrases.
TEMPORAL_SCOPE = (
    r"\b(?:next|last|past|this|current|recent|previous)\s+"
    r"(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|"
    r"day|week|month|year|morning|afternoon|evening|night)\b",
    r"\b(?:today|tomorrow|yesterday|tonight)\b",
    r"\b(?:all|every|each|only|exact|exactly|one-time)\b",
)

# Words that change what is asked or allowed.
NEGATION_SCOPE = ("no", "not", "never", "only", "without", "except", "exact", "exactly")
MODALS = ("can", "could", "would", "will", "should", "must", "need")
PRONOUNS = ("he", "she", "him", "her", "his", "hers", "they", "them", "their", "theirs")
ENTITY_TYPES = (
    "PERSON", "ORGANIZATION", "LOCATION", "CITY", "STATE_OR_PROVINCE", "COUNTRY", "NATIONALITY",
    "MISC", "DATE", "TIME", "DURATION", "MONEY", "PERCENT", "ORDINAL", "NUMBER", "URL", "EMAIL",
)

# Code-like spans masked in instructions.
MASK = (
    r"(?sU)```.*?```|`[^`\n]+`|https?://\S+|\"[^\"\n]{1,80}\"|(?<![\w])/[\w.\-/]*[\w/]"
    r"|\$[A-Za-z_(][\w)]*|(?<![\w-])--?[A-Za-z][\w-]*"
    r"|\b[\w-]+\.(?:py|json|csv|txt|md|sh|c|cpp|h|js|ts|html|log|db|toml|yaml|yml|ics|pem|key|crt"
    r"|tex|cob|v|so|ini|conf|parquet|jsonl|R|stan)\b|\b\w+_\w+\b|\b\w+\(\)"
)
MASKED = r"⟦(\d+)⟧"


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def numeric_tokens(text: Column, ascii_only: bool = False) -> Column:
    return F.array_sort(F.array_distinct(find_all(text, NUMBER_ASCII if ascii_only else NUMBER)))


def _clean(values: Column, trailing: str) -> Column:
    kept = F.filter(values, lambda v: F.btrim(v) != "")
    return F.transform(F.array_sort(F.array_distinct(kept)), lambda v: F.rtrim(v, F.lit(trailing)))


def protected_strings(text: Column) -> Column:
    """Quoted strings (one scan over all quote styles), URLs and e-mails, in order of text."""
    quoted = F.transform(find_all(text, QUOTED), lambda m: F.substring(m, F.lit(2), F.length(m) - 2))
    return _clean(F.concat(quoted, find_all(text, URL), find_all(text, EMAIL)), ".,;")


def protected_strings_per_style(text: Column) -> Column:
    """As above with a scan per quote style and question marks trimmed as well, as a set."""
    quoted = F.concat(*[find_all(text, p, 1) for p in QUOTED_EACH])
    return F.array_distinct(_clean(F.concat(quoted, find_all(text, URL), find_all(text, EMAIL)), ".?,;"))


def by_position(values: Column, text: Column) -> Column:
    placed = F.transform(values, lambda v: F.struct(F.instr(text, v).alias("at"), v.alias("v")))
    return F.transform(F.array_sort(placed), lambda s: s["v"])


def protected_literals(text: Column) -> Column:
    found = F.concat(*[find_all(text, p) for p in LITERALS])
    return by_position(F.array_distinct(found), text)


def missing(values: Column, text: Column) -> Column:
    return F.filter(values, lambda v: ~F.contains(text, v))


def missing_ignoring_case(values: Column, text: Column) -> Column:
    low = F.lower(text)
    return F.filter(values, lambda v: ~F.contains(low, F.lower(v)))


def longest_first(values: Column, text: Column) -> Column:
    keyed = F.transform(
        values,
        lambda v: F.struct((-F.length(v)).alias("n"), F.instr(text, v).alias("at"), v.alias("v")),
    )
    return F.transform(F.array_sort(keyed), lambda s: s["v"])


def locked_spans(text: Column, entities: Column | None = None) -> Column:
    """Literals, temporal and scope terms and named entities; spans inside a longer span drop."""
    values = F.concat(
        protected_literals(text), *[find_all(text, "(?iU)" + p) for p in TEMPORAL_SCOPE]
    )
    if entities is not None:
        named = F.filter(
            entities,
            lambda e: e["ner"].isin(*ENTITY_TYPES) & ~F.lower(e["text"]).isin(*PRONOUNS),
        )
        values = F.concat(values, F.transform(named, lambda e: e["text"]))
    ordered = longest_first(F.array_distinct(values), text)
    return F.filter(
        ordered,
        lambda v: ~F.exists(ordered, lambda k: (F.length(k) > F.length(v)) & F.contains(k, v)),
    )


def _indexed_by_length(literals: Column) -> Column:
    """(index, literal), longest first, keeping the text order of equally long ones."""
    keyed = F.transform(
        literals, lambda v, i: F.struct((-F.length(v)).alias("n"), i.alias("i"), v.alias("v"))
    )
    return F.transform(
        F.array_sort(keyed), lambda s, i: F.struct(i.alias("i"), s["v"].alias("v"))
    )


def _placeholder(i: Column) -> Column:
    return F.concat(F.lit("PROTECTEDITEM"), i.cast("string"), F.lit("TOKEN"))


def shield_literals(text: Column, literals: Column) -> Column:
    """Literals replaced by placeholders, longest first."""
    return F.aggregate(
        _indexed_by_length(literals), text, lambda acc, s: F.replace(acc, s["v"], _placeholder(s["i"]))
    )


def restore_literals(shielded: Column, literals: Column) -> Column:
    """Placeholders replaced by their literals, in whatever case they came back."""
    quoted = lambda v: F.regexp_replace(v, r"([\\$])", r"\\$1")
    return F.aggregate(
        F.reverse(_indexed_by_length(literals)),
        shielded,
        lambda acc, s: F.regexp_replace(acc, F.concat(F.lit("(?i)"), _placeholder(s["i"])), quoted(s["v"])),
    )


def mask_spans(text: Column) -> Column:
    return find_all(text, MASK)


def mask_text(text: Column) -> Column:
    """Spans replaced by numbered markers."""
    parts = F.split(text, MASK)
    return F.array_join(
        F.transform(
            parts,
            lambda p, i: F.when(
                i < F.size(parts) - 1, F.concat(p, F.lit("⟦"), i.cast("string"), F.lit("⟧"))
            ).otherwise(p),
        ),
        "",
    )


def unmask_text(masked: Column, spans: Column) -> Column:
    """Markers replaced by their spans; NULL unless each span is used exactly once."""
    used = F.transform(find_all(masked, MASKED, 1), lambda x: x.cast("int"))
    parts = F.split(masked, MASKED)
    wanted = F.transform(spans, lambda s, i: i)
    filled = F.array_join(
        F.transform(
            parts,
            lambda p, i: F.concat(p, F.coalesce(F.get(spans, F.get(used, i)), F.lit(""))),
        ),
        "",
    )
    return F.when(F.array_sort(used) == wanted, filled)


def words(text: Column) -> Column:
    return find_all(F.lower(text), r"[A-Za-z]+(?:'[A-Za-z]+)?")


def terms(word_list: Column, vocabulary) -> Column:
    return F.array_sort(F.array_intersect(F.array_distinct(word_list), F.array(*[F.lit(v) for v in vocabulary])))
