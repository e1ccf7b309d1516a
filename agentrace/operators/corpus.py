"""Conversation corpus: turns, deduplication, phrase counts, request formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentrace.functions import phrases as P
from agentrace.functions import requests as R
from agentrace.functions.rows import inline_once

LABEL_NAME = {-1: "impolite", 0: "neutral", 1: "polite"}
MIN_WORDS, MAX_WORDS = 3, 120
MIN_EVIDENCE, CUTOFF = 10, 0.15


def first_user_turn(turns: DataFrame) -> DataFrame:
    """Earliest user turn of each conversation; a map-side combined minimum, not a window."""
    rest = [c for c in turns.columns if c not in ("conv_id", "turn")]
    return (
        turns.filter(F.col("role") == "user")
        .groupBy("conv_id")
        .agg(
            F.min("turn").alias("turn"),
            F.min_by(F.struct(*rest), "turn").alias("_r"),
        )
        .select("conv_id", "turn", "_r.*")
    )


def with_normalized(turns: DataFrame, text: str = "text") -> DataFrame:
    return turns.withColumn("normalized", R.normalize_request(F.coalesce(F.col(text), F.lit(""))))


def with_digest(turns: DataFrame) -> DataFrame:
    return with_normalized(turns).withColumn("digest", F.sha2(F.lower("normalized"), 256))


def dedup_turns(turns: DataFrame) -> DataFrame:
    """First occurrence, in (conversation, turn) order, of every distinct non-empty user text.

    Copies are combined before the shuffle, so a text with very many copies costs one row per
    task. Empty texts leave behind the aggregation: a filter before it would normalise twice.
    """
    users = with_digest(turns.filter(F.col("role") == "user"))
    rest = [c for c in users.columns if c not in ("digest", "role", "text")]
    return (
        users.groupBy("digest")
        .agg(
            F.min_by(F.struct(*rest), F.struct("conv_id", "turn")).alias("_r"),
            F.count(F.lit(1)).alias("copies"),
        )
        .select("digest", "_r.*", "copies")
        .filter(F.col("normalized") != "")
    )


def turn_phrases(turns: DataFrame) -> DataFrame:
    """One row per distinct boundary phrase of each turn; needs ``normalized``, ``language``."""
    tokenised = turns.select(
        "language",
        P.tokens(F.col("normalized")).alias("_t"),
        F.transform(P.sentences(F.col("normalized")), P.tokens).alias("_s"),
    )
    return inline_once(
        tokenised, P.boundary_phrases(F.col("_t"), F.col("_s")), "phrase", "language"
    )


def phrase_counts(turns: DataFrame, min_count: int = 5) -> DataFrame:
    """Number of turns per boundary phrase with at least ``min_count`` of them."""
    return (
        turn_phrases(turns)
        .groupBy("language", "position", "n_tokens", "phrase")
        .agg(F.count(F.lit(1)).alias("turn_count"))
        .filter(F.col("turn_count") >= min_count)
    )


def frequency_order() -> list[Column]:
    return [F.desc("turn_count"), F.asc("language"), F.asc("position"), F.asc("n_tokens"), F.asc("phrase")]


def corpus_counters(turns: DataFrame) -> DataFrame:
    """Turn counters per language; a text seen before, in any language, is a duplicate."""
    users = turns.filter(F.col("role") == "user")
    seen = with_normalized(users).groupBy("language").agg(
        F.count(F.lit(1)).alias("user_turns"),
        F.count_if(F.col("normalized") == "").alias("empty_turns"),
    )
    unique = dedup_turns(turns).groupBy("language").agg(
        F.count(F.lit(1)).alias("unique_turns"),
        F.count_if(F.size(P.tokens(F.col("normalized"))) > 0).alias("tokenised_turns"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return seen.join(unique, "language", "left").select(
        "language",
        "user_turns",
        "empty_turns",
        zero("unique_turns"),
        zero("tokenised_turns"),
        (F.col("user_turns") - F.col("empty_turns") - F.coalesce("unique_turns", F.lit(0))).alias("duplicate_turns"),
    )


def request_counters(first_turns: DataFrame) -> DataFrame:
    """Filter funnel of the request study in one pass."""
    n_words = F.size(F.split("normalized", " "))
    english = F.col("language") == "en"
    clean = english & ~F.col("toxic")
    sized = clean & n_words.between(MIN_WORDS, MAX_WORDS)
    return first_turns.agg(
        F.count(F.lit(1)).alias("first_user_turns"),
        F.count_if(english).alias("english_first_user_turns"),
        F.count_if(english & F.col("toxic")).alias("toxic_skipped"),
        F.count_if(clean & ~n_words.between(MIN_WORDS, MAX_WORDS)).alias("length_skipped"),
        F.count_if(sized & F.col("format_id").isNull()).alias("unmatched_english_turns"),
        F.count_if(sized & F.col("format_id").isNotNull()).alias("matched_request_turns"),
    )


def with_format(turns: DataFrame) -> DataFrame:
    text = F.col("normalized")
    found = turns.withColumns({"modifiers": R.modifiers(text), "_openings": R.request_openings(text)})
    return found.withColumn(
        "format_id", R.request_format(F.col("_openings"), F.col("modifiers"))
    ).drop("_openings")


def eligible_requests(first_turns: DataFrame) -> DataFrame:
    n_words = F.size(F.split("normalized", " "))
    return first_turns.withColumn("n_words", n_words).filter(
        (F.col("language") == "en")
        & ~F.col("toxic")
        & F.col("n_words").between(MIN_WORDS, MAX_WORDS)
        & F.col("format_id").isNotNull()
    )


def corpus_format_stats(requests: DataFrame) -> DataFrame:
    """Frequency, predicted labels, modifiers and median length per request format.

    Lengths are between 3 and 120 words, so the exact median keeps at most 118 counters.
    """
    has = lambda m: F.count_if(F.array_contains("modifiers", m))
    return requests.groupBy("format_id").agg(
        F.count(F.lit(1)).alias("corpus_count"),
        F.count_if(F.col("predicted") == 1).alias("corpus_predicted_polite"),
        F.count_if(F.col("predicted") == 0).alias("corpus_predicted_neutral"),
        F.count_if(F.col("predicted") == -1).alias("corpus_predicted_impolite"),
        has("greeting_prefix").alias("greeting_prefix"),
        has("please_suffix").alias("please_suffix"),
        has("thanks_suffix").alias("thanks_suffix"),
        F.percentile("n_words", F.lit(0.5)).alias("corpus_median_words"),
    )


def labelled_format_stats(labelled: DataFrame) -> DataFrame:
    return (
        labelled.groupBy("format_id")
        .agg(
            F.count("format_id").alias("labelled_count"),
            F.avg("score").alias("labelled_mean_score"),
            F.count_if(F.col("label") == 1).alias("labelled_polite"),
            F.count_if(F.col("label") == 0).alias("labelled_neutral"),
            F.count_if(F.col("label") == -1).alias("labelled_impolite"),
        )
        .filter(F.col("labelled_count") > 0)
    )


def evidence_class() -> Column:
    """Class from the labelled mean when it rests on enough rows, else from the majority of
    predictions (the larger label wins ties), else unclassified."""
    mean = F.col("labelled_mean_score")
    by_mean = (
        F.when(mean >= CUTOFF, "polite").when(mean <= -CUTOFF, "impolite").otherwise("neutral")
    )
    pos, mid, neg = (
        F.col(f"corpus_predicted_{n}") for n in ("polite", "neutral", "impolite")
    )
    by_votes = (
        F.when((pos >= mid) & (pos >= neg), "polite").when(mid >= neg, "neutral").otherwise("impolite")
    )
    return (
        F.when(F.col("labelled_count") >= MIN_EVIDENCE, by_mean)
        .when(pos + mid + neg > 0, by_votes)
        .otherwise("unclassified")
    )


def format_dimension(spark) -> DataFrame:
    rows = [(i, t, f, risk) for i, t, f, _, risk in R.FORMATS] + list(R.SUFFIX_FORMATS)
    return spark.createDataFrame(
        rows, "format_id string, template string, family string, authorization_change_risk string"
    )


def format_library(formats: DataFrame, corpus: DataFrame, labelled: DataFrame) -> DataFrame:
    """Every known format with what both corpora say about it."""
    joined = formats.join(corpus, "format_id", "left").join(labelled, "format_id", "left")
    counts = [
        c
        for c in joined.columns
        if c.startswith(("corpus_", "labelled_"))
        and c not in ("corpus_median_words", "labelled_mean_score")
    ]
    filled = joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})
    return filled.withColumn("assigned_class", evidence_class())


def page_sample(
    rows: DataFrame, index: str, total: int, pages: int, page_size: int, seed: int
) -> DataFrame:
    """One page of consecutive rows per equal-width stratum, at a hash-chosen offset.

    A page touches at most two blocks of ``page_size`` rows, so the pages are found with an
    equi-join on the block number instead of a range join over all rows.
    """
    spark = rows.sparkSession
    top = max(0, total - page_size)
    width = max(1, (top + 1) // pages)
    i = F.col("page")
    key = F.sha2(F.concat_ws("|", F.lit(str(seed)), i.cast("string")), 256)
    pick = F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % width
    offsets = (
        spark.range(pages)
        .withColumnRenamed("id", "page")
        .withColumn("offset", F.least(F.lit(top), i * width + pick))
        .withColumn(
            "_block",
            F.explode(
                F.sequence(
                    F.floor(F.col("offset") / page_size),
                    F.floor((F.col("offset") + page_size - 1) / page_size),
                )
            ),
        )
    )
    return (
        rows.withColumn("_block", F.floor(F.col(index) / page_size))
        .join(offsets, "_block")
        .filter((F.col(index) >= F.col("offset")) & (F.col(index) < F.col("offset") + page_size))
        .drop("_block")
    )
