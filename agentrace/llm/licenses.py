"""License scan by diagonal voting, in DataFrame operations only.

Every rolling word k-gram of a document is joined by hash with the positions of that gram in the
templates. A hit at word p of a document and word t of a template votes for the diagonal p - t:
text that follows the template word by word puts all its votes on one diagonal, and a word put in
or left out moves the rest to a neighbouring one. Diagonals close together are merged, and a merged
span counts if it covers enough of its template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agentrace.llm.keys import KEY, keyed
from agentrace.llm.registry import query, table

# The phrases that must be reported wherever they stand, and their labels.
BASE = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)
# Sentences of public licenses and notices, in words, and the labels they give.
NOTICES = (
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this "
        "software and associated documentation files the software to deal in the software "
        "without restriction",
        "mit",
    ),
    ("released under the mit license", "mit"),
    (
        "licensed under the apache license version 2 0 the license you may not use this file "
        "except in compliance with the license",
        "apache",
    ),
    ("licensed under the apache license version 2 0", "apache"),
    (
        "this program is free software you can redistribute it and or modify it under the terms "
        "of the gnu general public license as published by the free software foundation",
        "gpl",
    ),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    (
        "redistribution and use in source and binary forms with or without modification are "
        "permitted provided that the following conditions are met",
        "bsd",
    ),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution 4 0 license", "cc-by"),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "mpl",
    ),
)
GRAM = 2
#: Diagonals that differ by no more than this belong to one span.
DRIFT = 2
#: Share of a notice's grams that a span must cover.
COVER = 0.7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of digits, letters and non-ASCII characters, with A-Z in lower case."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), BETWEEN), lambda w: w != "")


def template_positions(spark: SparkSession, base=BASE, notices=NOTICES) -> DataFrame:
    """One row per template and gram, and one for the empty gram that ends every document.

    The size is that of the constants, so the table may be broadcast.
    """
    rows = [(-1, "", 0, 0, "", False)]
    for number, (phrase, label) in enumerate((*base, *notices)):
        tokens = phrase.split()
        grams = [" ".join(tokens[i : i + GRAM]) for i in range(len(tokens) - GRAM + 1)]
        rows += [(number, g, t, len(grams), label, number < len(base)) for t, g in enumerate(grams)]
    return spark.createDataFrame(
        rows, "template int, gram string, at int, grams int, label string, is_base boolean"
    ).withColumn("gram_hash", F.xxhash64("gram"))


def license_scan(
    docs: DataFrame,
    base=BASE,
    notices=NOTICES,
    drift: int = DRIFT,
    cover: float = COVER,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: ``doc_id, n_words, spans``.

    ``spans`` is an array of (label, is_base, first_word, n_words, score) by position: every exact
    place of a base phrase with score 1, and every verified span of a notice with the share of the
    notice's grams that it covers. Null and empty texts have no words and no spans; repeated rows
    give equal rows. Votes are equality of the gram's words as well as of its hash, so a hash that
    collides can't add one. Grams that stand in no template leave at the broadcast join, before
    any shuffle, so a hot source or phrase moves only its own hits, and what is gathered in one
    row is the hits of one document.
    """
    spark = docs.sparkSession
    tokens = keyed(docs, id_col, text_col).select(*KEY, words(F.col("text")).alias("words"))
    paired = F.zip_with(
        "words",
        F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    grams = tokens.select(
        *KEY, F.posexplode(F.concat(paired, F.array(F.lit("")))).alias("pos", "gram")
    )
    hits = (
        grams.withColumn("gram_hash", F.xxhash64("gram"))
        .join(F.broadcast(template_positions(spark, base, notices)), ["gram_hash", "gram"])
        .withColumn("diagonal", F.col("pos") - F.col("at"))
    )
    votes = hits.groupBy(*KEY, "template", "diagonal").agg(
        F.first("grams").alias("grams"),
        F.first("label").alias("label"),
        F.first("is_base").alias("is_base"),
        F.collect_set("at").alias("covered"),
        F.count("*").alias("n"),
    )
    diagonals = Window.partitionBy(*KEY, "template").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(diagonals) > F.when(
        F.col("is_base"), 0
    ).otherwise(drift)
    merged = (
        votes.withColumn("new", F.coalesce(far, F.lit(True)).cast("int"))
        .withColumn("span", F.sum("new").over(diagonals))
        .groupBy(*KEY, "template", "span")
        .agg(
            F.first("grams").alias("grams"),
            F.first("label").alias("label"),
            F.first("is_base").alias("is_base"),
            F.min("diagonal").alias("first_word"),
            F.min(F.col("diagonal") + F.array_min("covered")).alias("from"),
            F.max(F.col("diagonal") + F.array_max("covered") + GRAM).alias("upto"),
            F.array_distinct(F.flatten(F.collect_list("covered"))).alias("covered"),
            F.sum("n").alias("n"),
        )
    )
    score = F.size("covered") / F.col("grams")
    kept = F.col("template") >= 0
    kept &= F.when(F.col("is_base"), score == 1).otherwise(score >= cover)
    span = F.struct(
        F.col("from").alias("first_word"),
        "label",
        "is_base",
        (F.col("upto") - F.col("from")).alias("n_words"),
        score.alias("score"),
    )
    ended = F.col("template") == -1
    return (
        merged.groupBy(*KEY)
        .agg(
            F.max(F.when(ended, F.col("first_word"))).cast("long").alias("n_words"),
            F.max(F.when(ended, F.col("n"))).cast("int").alias("repeats"),
            F.sort_array(F.collect_list(F.when(kept, span))).alias("spans"),
        )
        .withColumn("row", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
        .select("doc_id", "n_words", "spans")
    )


def _labels(spans: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")


def scan_sql(base=BASE, notices=NOTICES, drift=DRIFT, cover=COVER) -> str:
    grams = []
    for number, (phrase, label) in enumerate((*base, *notices)):
        tokens = phrase.split()
        for at in range(len(tokens) - GRAM + 1):
            gram, n = " ".join(tokens[at : at + GRAM]), len(tokens) - GRAM + 1
            grams.append(f"({number}, '{gram}', {at}, {n}, '{label}', {number < len(base)})")
    return rf"""
WITH words AS (
  SELECT doc_id, list_filter(
    regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
    lambda x: x <> '') AS w FROM documents),
gram AS (SELECT doc_id, w[i + 1] || ' ' || w[i + 2] AS gram, i AS pos FROM (SELECT *, unnest(range(len(w) - 1)) AS i FROM words)),
template(t, gram, tpos, grams, label, is_base) AS (VALUES {", ".join(grams)}),
vote AS (SELECT DISTINCT doc_id, t, grams, label, is_base, pos - tpos AS diagonal, tpos FROM gram JOIN template USING (gram)),
stepped AS (
  SELECT doc_id, t, diagonal,
         CASE WHEN diagonal - lag(diagonal) OVER w <= CASE WHEN is_base THEN 0 ELSE {drift} END THEN 0 ELSE 1 END AS new
  FROM (SELECT DISTINCT doc_id, t, diagonal, is_base FROM vote) WINDOW w AS (PARTITION BY doc_id, t ORDER BY diagonal)),
placed AS (SELECT doc_id, t, diagonal, sum(new) OVER (PARTITION BY doc_id, t ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM stepped),
span AS (
  SELECT doc_id, t, span, label, is_base, min(diagonal + tpos) AS first_word, count(DISTINCT tpos) / grams::DOUBLE AS score
  FROM vote JOIN placed USING (doc_id, t, diagonal) GROUP BY doc_id, t, span, label, is_base, grams),
kept AS (SELECT * FROM span WHERE CASE WHEN is_base THEN score = 1 ELSE score >= {cover} END),
told AS (
  SELECT doc_id, count(*) FILTER (WHERE is_base) AS n_base, min(first_word) FILTER (WHERE is_base) AS first_word,
         max(first_word) FILTER (WHERE is_base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE is_base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM kept GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM words LEFT JOIN told USING (doc_id)
"""


@query("op7_license_scan", scan_sql())
def op7_license_scan(spark, sf_dir):
    scan = license_scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["is_base"])
    starts = F.transform(base, lambda s: s["first_word"].cast("long"))
    return scan.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        _labels(base).alias("base_labels"),
        _labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )
