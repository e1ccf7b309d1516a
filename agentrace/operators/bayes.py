"""Multinomial naive Bayes over exploded word features, trained and scored as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentrace.functions.requests import word_features, word_tokens
from agentrace.functions.rows import explode_once

LABELS = (-1, 0, 1)
ALPHA = 1.0


def _c(label: int) -> str:
    return f"c_{'m1' if label < 0 else label}"


def _words():
    return word_features(word_tokens(F.coalesce("text", F.lit(""))))


def document_features(docs: DataFrame, id_col: str, *carry: str) -> DataFrame:
    """(id, feature, freq) counted per document."""
    return (
        explode_once(docs, _words(), "feature", id_col, *carry)
        .groupBy(id_col, *carry, "feature")
        .agg(F.count(F.lit(1)).alias("freq"))
    )


def feature_counts(docs: DataFrame) -> DataFrame:
    """Occurrences of each feature per class, classes side by side.

    Occurrences go straight into per-feature counters, which combine map-side; there is no
    per-document table in between.
    """
    return explode_once(docs, _words(), "feature", "label").groupBy("feature").agg(
        *[F.count_if(F.col("label") == lab).alias(_c(lab)) for lab in LABELS]
    )


def class_totals(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """One row: documents and feature occurrences per class, and the vocabulary size."""
    n_docs = docs.agg(*[F.count_if(F.col("label") == lab).alias(f"d{_c(lab)}") for lab in LABELS])
    totals = counts.agg(
        *[F.sum(_c(lab)).alias(f"t{_c(lab)}") for lab in LABELS], F.count(F.lit(1)).alias("vocab")
    )
    return totals.withColumns(
        {f"d{_c(lab)}": n_docs.select(f"d{_c(lab)}").scalar() for lab in LABELS}
    )


def score(doc_ids: DataFrame, features: DataFrame, counts: DataFrame, totals: DataFrame, id_col: str) -> DataFrame:
    """Log scores per class and the predicted label; the smallest label wins ties.

    Class totals are one row and enter as scalar values. Features meet their counts in an
    equi-join whose frequent words adaptive execution splits; documents without any feature
    keep their prior.
    """
    per_doc = (
        features.select(id_col, "feature", "freq")
        .join(counts, "feature", "left")
        .groupBy(id_col)
        .agg(
            F.sum("freq").alias("_n"),
            *[
                F.sum(F.col("freq") * F.log(F.coalesce(F.col(_c(lab)), F.lit(0)) + ALPHA)).alias(f"s{_c(lab)}")
                for lab in LABELS
            ],
        )
    )
    scalar = lambda c: totals.select(c).scalar()
    all_docs = sum((scalar(f"d{_c(lab)}") for lab in LABELS[1:]), scalar(f"d{_c(LABELS[0])}"))
    scores = {}
    for lab in LABELS:
        prior = F.log(scalar(f"d{_c(lab)}") / all_docs)
        denominator = scalar(f"t{_c(lab)}") + ALPHA * scalar("vocab")
        n, s = F.coalesce("_n", F.lit(0)), F.coalesce(f"s{_c(lab)}", F.lit(0.0))
        scores[f"score_{_c(lab)[2:]}"] = prior + s - n * F.log(denominator)
    joined = doc_ids.join(per_doc, id_col, "left").withColumns(scores)
    m1, zero, one = (F.col(f"score_{_c(lab)[2:]}") for lab in LABELS)
    label = F.when((m1 >= zero) & (m1 >= one), -1).when(zero >= one, 0).otherwise(1)
    return joined.select(*doc_ids.columns, *scores, label.alias("predicted"))


def confusion(scored: DataFrame, keys=()) -> DataFrame:
    return scored.groupBy(*keys, "label", "predicted").agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(scored: DataFrame, keys=()) -> DataFrame:
    """Accuracy, macro F1 (zero for undefined ratios) and the 3×3 confusion counts."""
    g, p = F.col("label"), F.col("predicted")
    name = lambda lab: "m1" if lab < 0 else str(lab)
    table = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[
            F.count_if((g == a) & (p == b)).alias(f"gold_{name(a)}_pred_{name(b)}")
            for a in LABELS
            for b in LABELS
        ],
    )
    cell = lambda a, b: F.col(f"gold_{name(a)}_pred_{name(b)}")
    right = cell(-1, -1) + cell(0, 0) + cell(1, 1)
    f1 = []
    for lab in LABELS:
        others = [x for x in LABELS if x != lab]
        wrong = cell(others[0], lab) + cell(others[1], lab) + cell(lab, others[0]) + cell(lab, others[1])
        # 2PR/(P+R) = 2tp/(2tp+fp+fn) whenever it is defined.
        f1.append(F.when(cell(lab, lab) > 0, 2 * cell(lab, lab) / (2 * cell(lab, lab) + wrong)).otherwise(0.0))
    return table.withColumn("accuracy", right / F.col("n")).withColumn(
        "macro_f1", (f1[0] + f1[1] + f1[2]) / 3
    )
