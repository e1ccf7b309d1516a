"""Mixing sources to target weights: whole repeats plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentrace.llm.keys import null_safe
from agentrace.llm.registry import query, table

WEIGHTS = (5, 2, 1)
CAP = 3
SHARE = 1.0
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words between ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights=WEIGHTS, cap: float = CAP, share: float = SHARE
) -> DataFrame:
    """One row per source: ``source, source_size, target``.

    ``sizes`` has columns source and size. Sources sorted by code point (null last) weigh
    ``weights`` in turn and share ``share`` of all sizes; no target exceeds ``cap`` times its
    source's size, and what a source can't take is shared again by weight. In the order of
    cap / weight the full sources come first, so one pass over running sums settles who is full.
    The windows hold one row per source, whatever the number of documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, 0)
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    per_source = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn).cast("double"))
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("all_weight", F.sum("weight").over(everything))
    )
    level = (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    settled = (
        per_source.withColumn("level", level)
        .withColumn("full", F.min((F.col("ratio") <= F.col("level")).cast("int")).over(upto))
        .withColumn(
            "open_level",
            F.min(F.when(F.col("full") == 0, F.struct("ratio", "source", "level"))).over(
                everything
            )["level"],
        )
    )
    target = F.when(F.col("full") == 1, F.col("most")).otherwise(
        F.least("most", F.col("open_level") * F.col("weight"))
    )
    return settled.select("source", "source_size", target.alias("target"))


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of seed and key; null counts as empty."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def copies_of(rate: str, seed: str) -> Column:
    """Whole repeats, and one more if the number of the id is below the fraction."""
    extra = uniform(F.col("doc_id"), seed) < F.col(rate) - F.floor(rate)
    return F.floor(rate).cast("long") + extra.cast("long")


def mixing_plan(
    docs: DataFrame,
    weights=WEIGHTS,
    cap: float = CAP,
    share: float = SHARE,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per input row: ``doc_id, size, source, source_size, target, rate, copies, taken``.

    rate = target / source_size; a document is taken floor(rate) times, and once more if the number
    that its id hashes to is below the fraction. Null texts have size 0; a source of size 0 has
    rate 0; a null source is a source of its own, sorted last. Repeated rows decide alike. An empty
    table gives an empty plan. Only (source, size) sums are shuffled by source, pre-aggregated in
    each task; the documents are joined with one small row per source.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col).cast("string")).alias("size"),
    )
    planned = null_safe(sized, source_targets(sized, weights, cap, share), ["source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
    return (
        planned.withColumn("rate", F.coalesce(rate, F.lit(0.0)))
        .withColumn("copies", copies_of("rate", seed))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select("doc_id", "size", "source", "source_size", "target", "rate", "copies", "taken")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as many times as its plan says, all columns kept.

    The rate depends on the source alone and the extra copy on the id alone, so the rows meet one
    small row per source instead of being joined with their own plan. Options are those of
    ``mixing_plan`` but the column names.
    """
    weights, cap = options.get("weights", WEIGHTS), options.get("cap", CAP)
    share, seed = options.get("share", SHARE), options.get("seed", SEED)
    sized = docs.select("source", word_count(F.col("text")).alias("size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
    rates = source_targets(sized, weights, cap, share).select(
        "source", F.coalesce(rate, F.lit(0.0)).alias("rate")
    )
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source")
    return (
        null_safe(rows, rates, ["source"])
        .withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies_of("rate", seed).cast("int"))))
        .select("row.*")
    )


MIX_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([{", ".join(map(str, WEIGHTS))}][
           CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS INTEGER)]
         AS DOUBLE) AS weight,
         source_size * {float(CAP)}::DOUBLE AS most
  FROM per_source),
summed AS (
  SELECT *, most / weight AS ratio,
         CAST(sum(source_size) OVER () AS DOUBLE) AS budget, sum(weight) OVER () AS all_weight
  FROM weighed),
levelled AS (
  SELECT *, (budget - coalesce(sum(most) OVER earlier, 0)) / (all_weight - coalesce(sum(weight) OVER earlier, 0)) AS level
  FROM summed
  WINDOW earlier AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
settled AS (
  SELECT *, min(CASE WHEN ratio <= level THEN 1 ELSE 0 END)
           OVER (ORDER BY ratio, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING) AS "full"
  FROM levelled),
opened AS (
  SELECT level FROM settled WHERE "full" = 0 ORDER BY ratio, source ASC NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN "full" = 1 THEN most
              ELSE least(most, (SELECT level FROM opened) * weight) END AS target
  FROM settled),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT)
           / {float(1 << 52)}::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM rated
"""


@query("op8_source_mix", MIX_SQL)
def source_mix(spark, sf_dir):
    plan = mixing_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")
