"""Line dedup: windows of three consecutive lines that occurred before are removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentrace.llm.keys import KEY, keyed, null_safe
from agentrace.llm.registry import query, table

WINDOW = 3


def window_occurrences(source: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per place of a window: ``doc_id, text_hash, pos, h1, h2`` (128 bits of hash)."""
    lines = source.select(*KEY, F.split("text", "\n").alias("lines"))
    places = F.when(
        F.size("lines") >= window, F.sequence(F.lit(0), F.size("lines") - window)
    ).otherwise(F.array().cast("array<int>"))
    cut = F.transform(
        places, lambda i: F.array_join(F.slice("lines", i + 1, window), "\n")
    )
    return lines.select(*KEY, F.posexplode(cut).alias("pos", "window")).select(
        *KEY, "pos", F.xxhash64("window").alias("h1"), F.xxhash64(F.lit(1), "window").alias("h2")
    )


def repeated_places(source: DataFrame, window: int = WINDOW) -> DataFrame:
    """Places of every window but its first: ``doc_id, text_hash, pos``.

    The first place is the smallest (doc_id, text_hash, pos), nulls first. Counts and minima are
    combined in each task before the shuffle, so a window that stands everywhere is no hot key
    there. The join that follows asks for one more key column than the aggregation has, so both of
    its sides are plain shuffles, of which adaptive execution splits a hot window.
    """
    places = window_occurrences(source, window)
    place = F.struct(*KEY, "pos")
    both = F.col("h1").bitwiseXOR(F.col("h2")).alias("h3")
    repeated = (
        places.groupBy("h1", "h2")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where(~F.col("first").eqNullSafe(F.col("last")))
        .select("h1", "h2", both, "first")
    )
    return (
        places.withColumn("h3", both).join(repeated, ["h1", "h2", "h3"])
        .where(~place.eqNullSafe(F.col("first")))
        .select(*KEY, "pos")
    )


def deduped(
    docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: ``row`` (a struct of all columns but the text), ``doc_id, text,
    n_lines, n_removed``; ``text`` is without repeats.

    Lines end at line feeds. Every window of three lines is hashed; all its places after the first,
    in the order of ids, are covered, and covered lines are left out, so overlapping windows merge
    into longer passages. Texts of fewer than three lines have no window and stay. A null text
    counts as empty; rows that repeat id and text share their places and so stay or go alike.
    What is gathered for one row is the window places of one document.
    """
    source = keyed(docs, id_col, text_col)
    gone = repeated_places(source, window).groupBy(*KEY).agg(F.collect_set("pos").alias("places"))
    rest = [c for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*rest).alias("row"),
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        text.alias("text"),
    )
    lines = F.split("text", "\n")
    # A line is covered if a window starts at most two lines before it.
    covered = F.array_distinct(
        F.flatten(F.transform("places", lambda p: F.sequence(p, p + (window - 1))))
    )
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("covered"))
    kept = F.transform(left, lambda i: F.element_at(F.col("lines"), i + 1))
    return (
        null_safe(rows, gone, [*KEY], "left")
        .withColumn("covered", covered)
        .withColumn("lines", lines)
        .select(
            "row",
            "doc_id",
            F.when(F.col("covered").isNull(), F.col("text"))
            .otherwise(F.array_join(kept, "\n"))
            .alias("text"),
            F.size("lines").cast("long").alias("n_lines"),
            F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("n_removed"),
        )
    )


def line_dedup(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, text, n_lines, n_removed`` of ``deduped``."""
    return deduped(docs, **options).drop("row")


DEDUP_SQL = f"""
WITH lines AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
places AS (
  SELECT doc_id, ls, unnest(range(len(ls) - {WINDOW - 1})) AS pos FROM lines),
windows AS (
  SELECT doc_id, pos, array_to_string(ls[pos + 1 : pos + {WINDOW}], chr(10)) AS win FROM places),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS nth FROM windows),
covered AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + {WINDOW})) AS at FROM ranked WHERE nth > 1),
line AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS at FROM lines),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.at) FILTER (WHERE c.at IS NULL) AS text,
         count(*) AS n_lines, count(c.at) AS n_removed
  FROM line l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.at = c.at GROUP BY l.doc_id)
SELECT doc_id, coalesce(text, '') AS text, n_lines, n_removed FROM kept
"""


@query("op3_line_dedup", DEDUP_SQL)
def op3_line_dedup(spark, sf_dir):
    return line_dedup(table(spark, sf_dir, "documents"))
