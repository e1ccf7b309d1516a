"""The plan of an experiment: every form of every task, prompts that replace others, task attributes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentrace.operators.logs import dataset_name

FAMILIES = ("source", "tone", "multilingual", "information_order", "formulation")
COLUMNS = (
    "task_id string, dataset string, family string, form string, prompt string, tone string, "
    "language string, subtype string, strict_mt_eligible boolean"
)
TASK_COLUMNS = ("task_category", "domain")


def is_true(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _rows(forms: DataFrame, family: str, eligible: Column) -> DataFrame:
    given = ("task_id", "form", "prompt", "tone", "language", "subtype")
    own = {c: F.col(c) if c in forms.columns else F.lit(None).cast("string") for c in given}
    return forms.select(*[c.alias(n) for n, c in own.items()], F.lit(family).alias("family"), eligible.alias("strict_mt_eligible"))


def experiment_plan(
    sources: DataFrame,
    tone: DataFrame,
    multilingual: DataFrame,
    information_order: DataFrame,
    formulation: DataFrame,
    families: Sequence[str] = FAMILIES,
    datasets: Sequence[str] | None = None,
) -> DataFrame:
    """One row per task and form of the chosen families, all with the same columns.

    All inputs have ``task_id, form, prompt`` (``sources`` without ``form``) and what else of tone,
    language and subtype they know. Strict eligibility is decided by family: sources always; tone
    and translated forms by ``eligible_pilot``, tone forms that are ``context_sensitive`` never;
    reordered forms only enter the plan if eligible; formulations bring ``strict_mt_eligible``.
    A missing flag counts as false. Forms of tasks that have no source are left out; filters on
    family leave whole inputs unread, and those on dataset reach the scans.
    """
    eligible = is_true("eligible_pilot")
    parts = {
        "source": lambda: _rows(sources.withColumn("form", F.lit("source")), "source", F.lit(True)),
        "tone": lambda: _rows(tone, "tone", eligible & ~is_true("context_sensitive")),
        "multilingual": lambda: _rows(multilingual, "multilingual", eligible),
        "information_order": lambda: _rows(information_order.filter(eligible), "information_order", F.lit(True)),
        "formulation": lambda: _rows(formulation, "formulation", is_true("strict_mt_eligible")),
    }
    unknown = set(families) - set(parts)
    if unknown:
        raise ValueError(f"no such family: {', '.join(sorted(unknown))}")
    chosen = [parts[f]() for f in FAMILIES if f in families]
    if not chosen:
        return sources.sparkSession.createDataFrame([], COLUMNS)
    plan = chosen[0]
    for more in chosen[1:]:
        plan = plan.unionByName(more)
    if tuple(families) != ("source",):
        known = sources.select("task_id").distinct()
        plan = plan.join(known, "task_id", "left_semi")
    plan = plan.withColumn("dataset", dataset_name(F.col("task_id")))
    if datasets is not None:
        plan = plan.filter(F.col("dataset").isin(list(datasets)))
    return plan.select("task_id", "dataset", "family", "form", "prompt", "tone", "language", "subtype", "strict_mt_eligible")


def plan_gaps(plan: DataFrame, sources: DataFrame, families: Sequence[str] = FAMILIES) -> DataFrame:
    """Tasks without any form in a chosen family, and forms planned twice or without a prompt."""
    present = plan.groupBy("task_id", "family", "form").agg(
        F.count("*").alias("_n"), F.count("prompt").alias("_prompts")
    )
    reasons = F.array_compact(
        F.array(F.when(F.col("_n") > 1, "planned twice"), F.when(F.col("_prompts") < F.col("_n"), "no prompt"))
    )
    bad = present.select("task_id", "family", "form", F.explode(reasons).alias("reason"))
    expected = sources.select("task_id").distinct().select("task_id", F.explode(F.lit(list(families))).alias("family"))
    absent = expected.join(present, ["task_id", "family"], "left_anti").select(
        "task_id", "family", F.lit(None).cast("string").alias("form"), F.lit("no form").alias("reason")
    )
    return bad.unionByName(absent)


def with_overrides(plan: DataFrame, overrides: DataFrame) -> DataFrame:
    """The plan with the prompts that replace its own, and why a row can't take one.

    ``overrides`` are the lines ``line_no, task_id, form, prompt, extracted, system_sha256`` of a file
    whose last line for a form holds. ``reason`` is NULL where the line was made from the very prompt
    of the plan (two missing prompts are equal); such rows have ``original_prompt`` beside the new
    one. Otherwise the row keeps its prompt and is to be kept out, see ``accepted`` and ``conflicts``.
    """
    rest = ("prompt", "extracted", "system_sha256")
    last = overrides.groupBy("task_id", "form").agg(F.max_by(F.struct(*rest), "line_no").alias("_o"))
    found = plan.join(last, ["task_id", "form"], "left")
    reason = F.when(F.col("_o").isNull(), "no override").when(
        ~F.col("_o.prompt").eqNullSafe(F.col("prompt")), "made from a different prompt"
    )
    taken = F.col("reason").isNull()
    return (
        found.withColumn("reason", reason)
        .withColumn("original_prompt", F.when(taken, F.col("prompt")))
        .withColumn("prompt_override_sha256", F.when(taken, F.col("_o.system_sha256")))
        .withColumn("override_prompt", F.col("_o.prompt"))
        .withColumn("prompt", F.when(taken, F.col("_o.extracted")).otherwise(F.col("prompt")))
        .drop("_o")
    )


def accepted(overridden: DataFrame) -> DataFrame:
    return overridden.filter(F.col("reason").isNull()).drop("reason", "override_prompt")


def conflicts(overridden: DataFrame) -> DataFrame:
    """The rows in quarantine: what the plan asks, what the override was made from, and why."""
    return overridden.filter(F.col("reason").isNotNull()).select(
        "task_id", "family", "form", "prompt", "override_prompt", "reason"
    )


def task_dimension(tasks: DataFrame, listed: str = "line_no") -> DataFrame:
    """Category and domain of every task; the last listed record of a task holds."""
    record = F.struct(F.col("task_type").alias("task_category"), "domain")
    return tasks.groupBy("task_id").agg(F.max_by(record, listed).alias("_r")).select("task_id", "_r.*")


def with_task_attributes(scores: DataFrame, dimension: DataFrame) -> DataFrame:
    """Scores with the category and domain of their task, NULL for tasks that aren't listed."""
    return scores.join(dimension.select("task_id", *TASK_COLUMNS), "task_id", "left")
