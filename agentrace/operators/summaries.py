"""Pair scores rolled up to variant, family-in-task, task and dataset-by-model level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentrace.operators.logs import dataset_name
from agentrace.operators.stats import exact_quantiles

FAMILIES = ("tone", "multilingual", "formulation")


def variant_scores(pairs: DataFrame, task_keys: Sequence[str]) -> DataFrame:
    """One row per variant with its own pairs and the baseline of its task.

    The baseline minus the variant mean is ``delta_baseline_minus_variant``.
    """
    form_keys = [*task_keys, "family", "form"]
    sim = F.col("similarity")

    def stats(kind: str, prefix: str):
        only = F.when(F.col("comparison") == kind, sim)
        return [
            F.avg(only).alias(f"{prefix}_mean"),
            F.min(only).alias(f"{prefix}_min"),
            F.max(only).alias(f"{prefix}_max"),
        ]

    per_form = (
        pairs.filter(F.col("family") != "source")
        .groupBy(*form_keys)
        .agg(
            *stats("source_variant", "source_variant"),
            *stats("variant_internal", "variant_internal"),
            F.count_if(F.col("comparison") == "source_variant").alias("n_source_variant_pairs"),
        )
    )
    # Filtered by kind, so the plan of the baseline does not contain the source-variant join.
    source = (
        pairs.filter(F.col("comparison") == "source_internal")
        .groupBy(*task_keys)
        .agg(*stats("source_internal", "source_internal"))
    )
    return (
        per_form.filter(F.col("source_variant_mean").isNotNull())
        .join(source, list(task_keys), "left")
        .withColumn(
            "delta_baseline_minus_variant",
            F.col("source_internal_mean") - F.col("source_variant_mean"),
        )
    )


def with_subsets(variants: DataFrame, eligible: str = "strict_mt_eligible") -> DataFrame:
    """Rows of the strict subset twice (``strict`` and ``all``), the others once, in one pass."""
    subsets = F.when(F.col(eligible), F.array(F.lit("strict"), F.lit("all"))).otherwise(
        F.array(F.lit("all"))
    )
    return variants.withColumn("subset", F.explode(subsets))


def task_family_scores(variants: DataFrame, task_keys: Sequence[str]) -> DataFrame:
    return variants.groupBy("subset", *task_keys, "family").agg(
        F.count(F.lit(1)).alias("variant_count"),
        F.avg("source_internal_mean").alias("source_internal_mean"),
        F.avg("source_variant_mean").alias("source_variant_mean"),
        F.avg("variant_internal_mean").alias("variant_internal_mean"),
        F.avg("delta_baseline_minus_variant").alias("delta_baseline_minus_variant"),
    )


def baseline_scores(pairs: DataFrame, task_keys: Sequence[str]) -> DataFrame:
    """Source-internal mean per task."""
    return (
        pairs.filter(F.col("comparison") == "source_internal")
        .groupBy(*task_keys)
        .agg(F.avg("similarity").alias("baseline"))
    )


def summary_long(task_family: DataFrame) -> DataFrame:
    """Equal-weight mean over tasks per (subset, dataset, model, family)."""
    return (
        task_family.withColumn("dataset", dataset_name(F.col("task_id")))
        .groupBy("subset", "dataset", "model", "family")
        .agg(
            F.count(F.lit(1)).alias("n_tasks"),
            F.avg("source_internal_mean").alias("baseline"),
            F.avg("source_variant_mean").alias("source_variant"),
            F.avg("variant_internal_mean").alias("variant_internal"),
            F.avg("delta_baseline_minus_variant").alias("delta_baseline_minus_variant"),
        )
    )


def summary_wide(task_family: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row per (subset, dataset, model): task-mean baseline and per-family columns."""
    tf = task_family.withColumn("dataset", dataset_name(F.col("task_id")))
    fam = lambda f, c: F.avg(F.when(F.col("family") == f, F.col(c)))
    wide = tf.groupBy("subset", "dataset", "model").agg(
        *[fam(f, "source_variant_mean").alias(f"{f}_source_variant") for f in FAMILIES],
        *[fam(f, "delta_baseline_minus_variant").alias(f"{f}_delta") for f in FAMILIES],
        *[F.count_if(F.col("family") == f).alias(f"{f}_tasks") for f in FAMILIES],
    )
    base = (
        baseline.withColumn("dataset", dataset_name(F.col("task_id")))
        .groupBy("dataset", "model")
        .agg(F.avg("baseline").alias("baseline"), F.count(F.lit(1)).alias("baseline_tasks"))
    )
    return wide.join(base, ["dataset", "model"], "left")


def boxplot_stats(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles, 1.5-IQR whiskers and mean per group."""
    quartiles = exact_quantiles(values, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    means = values.groupBy(*keys).agg(F.avg(value).alias("mean"))
    q = quartiles.join(means, list(keys))
    lo, hi = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    whisk = (
        values.join(q.select(*keys, lo.alias("lo"), hi.alias("hi")), list(keys))
        .groupBy(*keys)
        .agg(
            F.min(F.when(F.col(value) >= F.col("lo"), F.col(value))).alias("whisker_low"),
            F.max(F.when(F.col(value) <= F.col("hi"), F.col(value))).alias("whisker_high"),
        )
    )
    return q.join(whisk, list(keys))


def scatter_bins(values: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Count-weighted cells: x on a 0.05 grid, y on a 1/36 grid (half-even rounding)."""
    return values.groupBy(
        *keys,
        F.rint(F.col(x) / 0.05).cast("int").alias("x_cell"),
        F.rint(F.col(y) * 36).cast("int").alias("y_cell"),
    ).agg(F.count(F.lit(1)).alias("n"))


def histogram(values: DataFrame, keys: Sequence[str], value: str, bins: int = 20) -> DataFrame:
    """Share of values per equal-width bin of [0, 1]; the last bin is closed."""
    counts = values.groupBy(
        *keys, F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    return counts.join(totals, list(keys)).select(
        *keys, "bin", "n", (F.col("n") / F.col("total")).alias("share")
    )
