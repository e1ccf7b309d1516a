"""Request texts: placeholder normalisation, request-format detection, word features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Opening of a sentence, with an optional greeting and an optional addressee.
LEAD = (
    r"(?:^|[.!?]\s+)(?:(?:hi|hello|hey)(?:\s+there)?[!,.:\-\s]+)?"
    r"(?:(?:chatgpt|gpt|claude|assistant)[!,.:\-\s]+)?"
)

# Imperative verbs that open a direct request.
VERBS = (
    "find|book|send|check|search|schedule|buy|order|pay|upload|download|open|create|write|edit|fix|"
    "update|delete|summarize|analyse|analyze|tell|explain|generate|make|show|give"
)

# Fixed values, in matching order: id, template, family, pattern after the lead, risk.
FORMATS = (
    ("wondering_if_could", "I was wondering if you could {TASK}.", "mitigated_modal", r"i\s+(?:was|am|'m)\s+wondering\s+if\s+you\s+could\b", "low"),
    ("appreciate_if_could", "I would appreciate it if you could {TASK}.", "gratitude_modal", r"i(?:\s+would|'d)\s+appreciate\s+it\s+if\s+you\s+could\b", "low"),
    ("would_you_mind", "Would you mind {TASK}?", "mitigated_modal", r"would\s+you\s+mind\b", "low"),
    ("do_you_mind", "Do you mind {TASK}?", "mitigated_modal", r"do\s+you\s+mind\b", "low"),
    ("is_it_possible", "Is it possible for you to {TASK}?", "mitigated_modal", r"is\s+it\s+possible(?:\s+for\s+you)?\s+to\b", "low"),
    ("are_you_able_to", "Are you able to {TASK}?", "modal_request", r"are\s+you\s+able\s+to\b", "low"),
    ("it_would_be_great_if", "It would be great if you could {TASK}.", "mitigated_modal", r"it\s+would\s+be\s+(?:great|helpful|nice)\s+if\s+you\s+could\b", "low"),
    ("id_be_grateful_if", "I'd be grateful if you could {TASK}.", "gratitude_modal", r"i(?:\s+would|'d)\s+be\s+grateful\s+if\s+you\s+could\b", "low"),
    ("could_you_please", "Could you please {TASK}?", "polite_modal", r"could\s+you\s+please\b", "low"),
    ("can_you_please", "Can you please {TASK}?", "polite_modal", r"can\s+you\s+please\b", "low"),
    ("would_you_please", "Would you please {TASK}?", "polite_modal", r"would\s+you\s+please\b", "low"),
    ("please_could_you", "Please, could you {TASK}?", "polite_modal", r"please[,]?\s+could\s+you\b", "low"),
    ("please_can_you", "Please, can you {TASK}?", "polite_modal", r"please[,]?\s+can\s+you\b", "low"),
    ("could_you_help_me", "Could you help me {TASK}?", "help_seeking", r"could\s+you\s+(?:please\s+)?help\s+me\b", "low"),
    ("can_you_help_me", "Can you help me {TASK}?", "help_seeking", r"can\s+you\s+(?:please\s+)?help\s+me\b", "low"),
    ("would_you_help_me", "Would you help me {TASK}?", "help_seeking", r"would\s+you\s+(?:please\s+)?help\s+me\b", "low"),
    ("please_help_me", "Please help me {TASK}.", "help_seeking", r"please\s+help\s+me\b", "low"),
    ("kindly", "Kindly {TASK}.", "polite_imperative", r"kindly\b", "low"),
    ("please_imperative", "Please {TASK}.", "polite_imperative", r"please\b", "low"),
    ("id_like_you_to", "I'd like you to {TASK}.", "desire_statement", r"i(?:\s+would|'d)\s+like\s+you\s+to\b", "low"),
    ("i_need_you_to", "I need you to {TASK}.", "need_statement", r"i\s+need\s+you\s+to\b", "low"),
    ("i_want_you_to", "I want you to {TASK}.", "want_statement", r"i\s+want\s+you\s+to\b", "low"),
    ("could_you", "Could you {TASK}?", "modal_request", r"could\s+you\b", "low"),
    ("can_you", "Can you {TASK}?", "modal_request", r"can\s+you\b", "low"),
    ("would_you", "Would you {TASK}?", "modal_request", r"would\s+you\b", "low"),
    ("help_me", "Help me {TASK}.", "help_seeking", r"help\s+me\b", "low"),
    ("why_cant_you", "Why can't you {TASK}?", "challenging_request", r"why\s+can(?:no|')t\s+you\b", "medium"),
    ("just_imperative", "Just {TASK}.", "blunt_imperative", rf"just\s+(?:{VERBS})\b", "medium"),
    ("direct_imperative", "{TASK}.", "direct_imperative", rf"(?:{VERBS})\b", "low"),
)

# Formats that only a closing "please" or "thanks" gives away.
SUFFIX_FORMATS = (
    ("please_suffix", "{TASK}, please.", "polite_imperative", "low"),
    ("thanks_suffix", "{TASK}, thanks.", "gratitude_imperative", "low"),
)
GREETING = r"^\s*(?:hi|hello|hey)\b"
SUFFIX_PLEASE = r"(?:,|\s)\s*please[.!?\s]*$"
SUFFIX_THANKS = r"(?:,|\s)\s*(?:thanks|thank\s+you)(?:\s+(?:in\s+advance|so\s+much))?[.!?\s]*$"

# Spans replaced by placeholders, in order.
PLACEHOLDERS = (
    (r"(?s)```.*?```", " <CODE> "),
    (r"(?i)https?://\S+|www\.\S+|<url>", " <URL> "),
    (r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b", " <EMAIL> "),
    (r"\b\d{5,}\b", " <NUMBER> "),
)
WORD = r"[a-z]+(?:'[a-z]+)?|<url>|<email>|<number>"


def _unicode(pattern: str) -> str:
    return "(?U)" + pattern


def normalize_request(text: Column) -> Column:
    """Code, URLs, e-mails and long numbers become placeholders; whitespace is collapsed."""
    for pattern, token in PLACEHOLDERS:
        text = F.regexp_replace(text, _unicode(pattern), token)
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit("(?iU)" + pattern))


def modifiers(normalized: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(_found(normalized, GREETING), "greeting_prefix"),
            F.when(_found(normalized, SUFFIX_PLEASE), "please_suffix"),
            F.when(_found(normalized, SUFFIX_THANKS), "thanks_suffix"),
        )
    )


def request_openings(normalized: Column) -> Column:
    """Every phrase that opens a request somewhere in the text, from a single scan.

    The alternatives stand in matching order, so each place yields its first format.
    """
    anything = "|".join(pattern for _, _, _, pattern, _ in FORMATS)
    return F.regexp_extract_all(normalized, F.lit(f"(?iU){LEAD}({anything})"), F.lit(1))


def request_format(openings: Column, mods: Column) -> Column:
    """Id of the first format, in matching order, among the openings; NULL without any.

    A closing "please" or "thanks" decides for direct imperatives and texts without opening.
    """
    place = lambda phrase: F.coalesce(
        *[
            F.when(F.regexp_like(phrase, F.lit(f"(?iU)^(?:{pattern})$")), i)
            for i, (_, _, _, pattern, _) in enumerate(FORMATS, 1)
        ]
    )
    first = F.array_min(F.transform(openings, place))
    direct = len(FORMATS)  # the direct imperative is the last format
    by_suffix = F.when(F.array_contains(mods, "please_suffix"), "please_suffix").when(
        F.array_contains(mods, "thanks_suffix"), "thanks_suffix"
    )
    name = F.element_at(F.array(*[F.lit(f[0]) for f in FORMATS]), F.coalesce(first, F.lit(direct)))
    return (
        F.when(first.isNull(), by_suffix)
        .when(first == direct, F.coalesce(by_suffix, name))
        .otherwise(name)
    )


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(normalize_request(text)), F.lit(WORD), F.lit(0))


def word_features(tokens: Column) -> Column:
    """Unigram and adjacent-bigram features with repetitions.

    The tokens are bound once, through a one-element array, because they are read twice.
    """

    def both(t: Column) -> Column:
        unigrams = F.transform(t, lambda w: F.concat(F.lit("w="), w))
        shifted = F.slice(t, 2, F.greatest(F.size(t), F.lit(1)))
        bigrams = F.zip_with(
            F.slice(t, 1, F.size(shifted)),
            shifted,
            lambda a, b: F.concat(F.lit("b="), a, F.lit("_"), b),
        )
        return F.concat(unigrams, bigrams)

    return F.element_at(F.transform(F.array(tokens), both), 1)
