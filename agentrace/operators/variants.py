"""Prompt variants: templates, sentence permutations, audits, candidate choice and summaries."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agentrace.functions import literals as L

# Id, tone and sentence of each of the fifteen tone forms.
TONE_FORMS = (
    ("p01", "polite", "Could you {task}?"),
    ("p02", "polite", "Is it possible to {task}?"),
    ("p03", "polite", "Can you please {task}?"),
    ("p04", "polite", "Please help me {task}."),
    ("p05", "polite", "{Task}, please."),
    ("n01", "neutral", "Can you {task}?"),
    ("n02", "neutral", "Are you able to {task}?"),
    ("n03", "neutral", "Can you help me {task}?"),
    ("n04", "neutral", "Please {task}."),
    ("n05", "neutral", "{Task}."),
    ("i01", "impolite", "Just {task}."),
    ("i02", "impolite", "{Task}. Do it."),
    ("i03", "impolite", "This time, {task}."),
    ("i04", "impolite", "You need to {task}."),
    ("i05", "impolite", "Why can't you {task}?"),
)
CONTEXT_SENSITIVE = ("i03", "i05")
REVIEW_FLAGS = (
    "task_equivalent",
    "authorization_equivalent",
    "tone_preserved",
    "information_order_preserved",
    "target_language_correct",
)
MIN_LENGTH_RATIO, MAX_LENGTH_RATIO, MIN_SIMILARITY = 0.70, 1.35, 0.45


def tone_templates(tasks: DataFrame) -> DataFrame:
    """Fifteen tone forms per (task_id, context, task). Tasks that do not start with a
    lower-case letter are kept with ``valid`` false and no prompt."""
    core = F.rtrim(F.btrim("task"), F.lit(".?!"))
    first = F.substring("core", 1, 1)
    lower = (F.col("core") != "") & (F.lower(first) == first) & (F.upper(first) != first)
    forms = F.array(
        *[
            F.struct(
                F.lit(i).alias("form"),
                F.lit(t).alias("tone"),
                F.lit(s).alias("template"),
                F.lit(i in CONTEXT_SENSITIVE).alias("context_sensitive"),
            )
            for i, t, s in TONE_FORMS
        ]
    )
    capital = F.concat(F.upper(first), F.substring(F.col("core"), F.lit(2), F.length("core")))
    body = F.replace(
        F.replace(F.col("template"), F.lit("{task}"), F.col("core")), F.lit("{Task}"), capital
    )
    context = F.btrim(F.coalesce("context", F.lit("")))
    prompt = F.when(context != "", F.concat(context, F.lit("\n\n"), body)).otherwise(body)
    return (
        tasks.withColumn("core", core)
        .withColumn("valid", lower)
        .select("task_id", "context", "core", "valid", F.inline(forms))
        .select(
            "task_id",
            "form",
            "tone",
            "context_sensitive",
            "valid",
            F.when(F.col("valid"), prompt).alias("prompt"),
        )
    )


def split_sentences(text: Column) -> Column:
    protected = F.regexp_replace(text, r"\b(Dr|Mr|Mrs|Ms|Prof|St)\.", "$1<DOT>")
    parts = F.split(protected, r"""(?<=[.!?])\s+(?=["“”'A-Z])""")
    cleaned = F.transform(parts, lambda p: F.btrim(F.replace(p, F.lit("<DOT>"), F.lit("."))))
    return F.filter(cleaned, lambda p: p != "")


def rotate(items: Column) -> Column:
    return F.concat(F.slice(items, 2, F.size(items)), F.slice(items, 1, 1))


def seeded_permutation(items: Column, key: Column) -> Column:
    """Order by the hash of (key, position); the identity is rotated by one instead."""
    tagged = F.transform(
        items,
        lambda s, i: F.struct(
            F.sha2(F.concat_ws("|", key, i.cast("string")), 256).alias("h"), i.alias("i"), s.alias("s")
        ),
    )
    order = F.array_sort(tagged)
    shuffled = F.transform(order, lambda t: t["s"])
    identity = F.transform(order, lambda t: t["i"]) == F.transform(items, lambda s, i: i)
    return F.when(F.size(items) < 2, items).when(identity, rotate(items)).otherwise(shuffled)


def controlled_permutation(tasks: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Context moved behind the request, or independent requests rotated after the preamble.

    Needs ``sentences``, ``dataset``, ``trajectory_type``. Tasks of ``exclusions`` keep their
    order because a sentence refers back to the first one.
    """
    s = F.col("sentences")
    n = F.size(s)
    rotation = (F.col("dataset") == "trajectory") & (F.col("trajectory_type") == "parallel") & (n > 2)
    actions = F.concat(F.slice(s, 1, 1), F.slice(s, 3, n), F.slice(s, 2, 1))
    marked = tasks.join(
        exclusions.select("task_id", F.lit(True).alias("excluded")), "task_id", "left"
    )
    status = (
        F.when(n < 2, "not_applicable")
        .when(F.coalesce("excluded", F.lit(False)), "excluded_dependency")
        .when(rotation, "parallel_action_rotation")
        .otherwise("context_to_end")
    )
    permuted = (
        F.when(F.col("transformation").isin("not_applicable", "excluded_dependency"), s)
        .when(F.col("transformation") == "parallel_action_rotation", actions)
        .otherwise(rotate(s))
    )
    return (
        marked.withColumn("transformation", status)
        .withColumn("permuted", permuted)
        .withColumn("multiset_preserved", F.array_sort("permuted") == F.array_sort("sentences"))
        .withColumn("order_changed", F.col("permuted") != F.col("sentences"))
        .drop("excluded")
    )


def context_to_end(text: Column) -> Column:
    """First sentence moved to the end, everything else unchanged; NULL for one sentence."""
    body = F.regexp_replace(text, r"^\s+|\s+$", "")
    first = F.regexp_extract(body, r"(?s)^(.+?[.!?])(?=\s+\S)", 1)
    rest = F.regexp_replace(F.substring(body, F.length(first) + 1, F.length(body)), r"^\s+", "")
    gap = F.when(F.contains(rest, F.lit("\n")), "\n\n").otherwise(" ")
    return F.when(first != "", F.concat(rest, gap, first, F.lit("\n")))


def literal_audit(pairs: DataFrame, source: str, variant: str, ascii_numbers: bool = False) -> DataFrame:
    """Literals and numbers of the source that the variant lost."""
    s, v = F.col(source), F.col(variant)
    return pairs.withColumns(
        {
            "missing_strings": L.missing(L.protected_strings(s), v),
            "missing_numbers": F.array_except(
                L.numeric_tokens(s, ascii_numbers), L.numeric_tokens(v, ascii_numbers)
            ),
        }
    ).withColumn("passed", (F.size("missing_strings") == 0) & (F.size("missing_numbers") == 0))


def eligibility(audited: DataFrame, review: str = "review") -> DataFrame:
    """Literals kept, every review flag true, and not context-sensitive."""
    flags = [F.coalesce(F.col(f"{review}.{f}"), F.lit(False)) for f in REVIEW_FLAGS]
    every = flags[0]
    for flag in flags[1:]:
        every = every & flag
    return audited.withColumn("eligible_pilot", F.col("passed") & every & ~F.col("context_sensitive"))


def audit_summary(audited: DataFrame, keys) -> DataFrame:
    return audited.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if("eligible_pilot").alias("eligible"),
        F.count_if(~F.col("passed")).alias("literal_check_failures"),
        F.count_if("context_sensitive").alias("context_sensitive_candidates"),
        F.count_if(~F.col("eligible_pilot")).alias("needs_review"),
    )


def review_queue(audited: DataFrame) -> DataFrame:
    return audited.filter(~F.col("eligible_pilot"))


@F.pandas_udf(T.DoubleType())
def surface_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio, which no built-in function computes."""
    return pd.Series(
        [SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right, strict=True)], dtype="float64"
    )


def surface_guards(pairs: DataFrame, source: str, candidate: str) -> DataFrame:
    """Deterministic guards of a paraphrase candidate and the list of those that fail."""
    s, c = F.col(source), F.col(candidate)
    asks = lambda x: F.coalesce(F.regexp_replace(x, r"\s+$", "").endswith("?"), F.lit(False))
    base = pairs.withColumns(
        {
            "_ws": L.words(s),
            "_wc": L.words(c),
            "missing_literals": L.missing_ignoring_case(L.protected_literals(s), c),
        }
    )
    measured = base.withColumns(
        {
            "length_ratio": F.size("_wc") / F.greatest(F.lit(1), F.size("_ws")),
            "surface_similarity": surface_ratio(F.array_join("_ws", " "), F.array_join("_wc", " ")),
        }
    )
    failures = F.array_compact(
        F.array(
            F.when(F.size("missing_literals") > 0, "missing_protected_literal"),
            F.when(F.array_join("_ws", " ") == F.array_join("_wc", " "), "identity"),
            F.when(asks(s) != asks(c), "question_force_changed"),
            F.when(
                L.terms(F.col("_ws"), L.NEGATION_SCOPE) != L.terms(F.col("_wc"), L.NEGATION_SCOPE),
                "negation_or_scope_marker_changed",
            ),
            F.when(
                ~F.col("length_ratio").between(MIN_LENGTH_RATIO, MAX_LENGTH_RATIO),
                "length_ratio_outside_guard",
            ),
            F.when(F.col("surface_similarity") < MIN_SIMILARITY, "surface_similarity_too_low"),
        )
    )
    return (
        measured.withColumn("failures", failures)
        .withColumn("passed", F.size("failures") == 0)
        .drop("_ws", "_wc")
    )


def choose_candidate(candidates: DataFrame, order) -> DataFrame:
    """Best candidate per task: passed first, then the given order; one map-side minimum."""
    rest = [c for c in candidates.columns if c != "task_id"]
    rank = F.struct((~F.col("passed")).alias("_failed"), *order)
    return (
        candidates.groupBy("task_id")
        .agg(F.min_by(F.struct(*rest), rank).alias("_best"))
        .select("task_id", "_best.*")
    )


def candidate_order(candidates: DataFrame) -> DataFrame:
    """Rank of each candidate of a task: passed, more similar, smaller id."""
    w = Window.partitionBy("task_id").orderBy(
        (~F.col("passed")).asc(), F.desc("surface_similarity"), F.asc("candidate_id")
    )
    return candidates.withColumn("rank", F.row_number().over(w))


def route_formulation(tasks: DataFrame, reorderings: DataFrame, paraphrases: DataFrame) -> DataFrame:
    """Reordering where there is one, else the chosen paraphrase; eligible by origin."""
    r = reorderings.select("task_id", F.col("prompt").alias("_r"))
    p = paraphrases.select("task_id", F.col("prompt").alias("_p"), F.col("passed").alias("_ok"))
    return (
        tasks.select("task_id")
        .join(r, "task_id", "left")
        .join(p, "task_id", "left")
        .select(
            "task_id",
            F.coalesce("_r", "_p").alias("prompt"),
            F.when(F.col("_r").isNotNull(), "information_reordering")
            .when(F.col("_p").isNotNull(), "constrained_paraphrasing")
            .alias("subtype"),
            F.when(F.col("_r").isNotNull(), True).otherwise(F.coalesce("_ok", F.lit(False))).alias("strict_mt_eligible"),
        )
    )
