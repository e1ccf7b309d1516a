"""Data side of judging final outputs: jobs, packing, validation, merging, score roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentrace.operators.kernel import REPEATS, repeat_column

WITHIN = ((0, 1), (0, 2), (1, 2))
ACROSS = tuple((i, j) for i in range(REPEATS) for j in range(REPEATS))
MAX_SCORE = 4

# Characters of the fixed text around task, outputs and variants in a judge prompt.
HEADER_CHARS = 84 + 16 + 19
OUTPUT_CHARS = 11
VARIANT_CHARS = 19 + 11
FOOTER_CHARS = 277
BASELINE_FOOTER_CHARS = 134
MAX_PROMPT_CHARS = 60000
CHARS_PER_TOKEN = 4


def three_outputs(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Final responses of the three repeats of a form, in order, and whether all are there."""
    out = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_runs"),
        *[
            F.max(F.when(repeat_column() == r, F.coalesce("final_response", F.lit("")))).alias(f"o{r}")
            for r in range(REPEATS)
        ],
    )
    every = F.lit(True)
    for r in range(REPEATS):
        every = every & F.col(f"o{r}").isNotNull()
    return out.select(
        *keys, "n_runs", every.alias("complete"), F.array(*[F.col(f"o{r}") for r in range(REPEATS)]).alias("outputs")
    )


def _outputs_chars(outputs: Column) -> Column:
    text = F.aggregate(outputs, F.lit(0), lambda acc, o: acc + F.length(o))
    return text + OUTPUT_CHARS * F.size(outputs) + F.size(outputs) - 1


def job_variants(outputs: DataFrame, prompts: DataFrame) -> DataFrame:
    """Complete variants with their complete source outputs, prompt and text sizes."""
    done = outputs.filter("complete")
    source = done.filter(F.col("family") == "source").select(
        "model", "task_id", F.col("outputs").alias("source_outputs")
    )
    return (
        done.filter(F.col("family") != "source")
        .join(source, ["model", "task_id"])
        .join(prompts, "task_id")
        .select(
            "model",
            "task_id",
            "family",
            "form",
            "outputs",
            "source_outputs",
            (HEADER_CHARS + F.length("prompt") + _outputs_chars(F.col("source_outputs"))).alias("header_chars"),
            (VARIANT_CHARS + F.length("form") + _outputs_chars(F.col("outputs"))).alias("variant_chars"),
        )
    )


def pack_jobs(variants: DataFrame, budget: int = MAX_PROMPT_CHARS) -> DataFrame:
    """Greedy packing, in form order, of the variants of a (model, task, family) into chunks
    whose prompts fit the budget; a variant alone may exceed it.

    The forms of a family are a short fixed list, so the fold runs over a bounded array.
    """
    keys = ["model", "task_id", "family"]
    jobs = variants.groupBy(*keys).agg(
        F.max("header_chars").alias("header_chars"),
        F.array_sort(F.collect_list(F.struct("form", "variant_chars"))).alias("v"),
    )
    fixed = F.col("header_chars") + FOOTER_CHARS
    start = F.struct(
        F.lit(0).alias("chunk"),
        F.lit(0).cast("long").alias("used"),
        F.array().cast("array<struct<form:string,chunk:int>>").alias("placed"),
    )

    def place(acc: Column, v: Column) -> Column:
        grown = acc["used"] + v["variant_chars"] + 1
        opens = (acc["used"] > 0) & (fixed + grown > budget)
        chunk = F.when(opens, acc["chunk"] + 1).otherwise(acc["chunk"])
        return F.struct(
            chunk.alias("chunk"),
            F.when(opens, v["variant_chars"].cast("long") + 1).otherwise(grown).cast("long").alias("used"),
            F.concat(acc["placed"], F.array(F.struct(v["form"].alias("form"), chunk.alias("chunk")))).alias("placed"),
        )

    packed = jobs.withColumn("placed", F.aggregate("v", start, place)["placed"]).select(
        *keys, (F.element_at("placed", -1)["chunk"] + 1).alias("chunk_count"), F.inline("placed")
    )
    parent = F.concat_ws("|", *keys)
    job_id = F.when(F.col("chunk_count") == 1, parent).otherwise(
        F.concat(parent, F.lit("|chunk"), F.lpad(F.col("chunk").cast("string"), 2, "0"))
    )
    return packed.withColumn("job_id", job_id)


def prompt_cost(variants: DataFrame, price_per_million: float) -> DataFrame:
    """Characters, estimated tokens and input cost per model and family."""
    per_job = variants.groupBy("model", "task_id", "family").agg(
        (F.max("header_chars") + F.sum(F.col("variant_chars") + 1) + FOOTER_CHARS).alias("chars")
    )
    return per_job.groupBy("model", "family").agg(
        F.count(F.lit(1)).alias("jobs"),
        F.sum("chars").alias("chars"),
        (F.sum("chars") / CHARS_PER_TOKEN).alias("tokens"),
        (F.sum("chars") / CHARS_PER_TOKEN * price_per_million / 1e6).alias("cost"),
    )


def expected_pairs(n_source: Column, n_variant: Column) -> tuple[Column, Column]:
    return n_source * n_variant, n_variant * (n_variant - 1) / 2


def validate_results(results: DataFrame) -> DataFrame:
    """Problems of judge results: wrong score counts, or forms other than those asked for.

    Needs ``expected_forms``, ``forms``, ``sv_sizes``, ``vv_sizes`` per job.
    """
    problems = F.array_compact(
        F.array(
            F.when(F.col("forms") != F.col("expected_forms"), "forms_mismatch"),
            F.when(F.exists("sv_sizes", lambda n: n != len(ACROSS)), "source_variant_count"),
            F.when(F.exists("vv_sizes", lambda n: n != len(WITHIN)), "variant_internal_count"),
        )
    )
    return results.withColumn("problem", F.explode(problems))


def merge_supplemental(first: DataFrame, supplemental: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Returned forms, completed by supplemental results for forms the first answer missed."""
    rest = [c for c in first.columns if c not in keys]
    both = first.withColumn("_p", F.lit(0)).unionByName(supplemental.withColumn("_p", F.lit(1)))
    return (
        both.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest, F.col("_p")), "_p").alias("_r"))
        .select(*keys, *[F.col(f"_r.{c}") for c in rest], (F.col("_r._p") == 1).alias("supplemental"))
    )


def _fix(scores: Column, left: Column, right: Column, pairs) -> Column:
    """Two empty outputs are the same completion state and score 4."""
    empty = lambda x: F.btrim(x) == ""
    return F.array(
        *[
            F.when(empty(left[i]) & empty(right[j]), MAX_SCORE).otherwise(scores[at])
            for at, (i, j) in enumerate(pairs)
        ]
    )


def _mean(scores: Column) -> Column:
    total = F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + s)
    return total / F.size(scores) / MAX_SCORE


def _changed(old: Column, new: Column) -> Column:
    return F.size(F.filter(F.zip_with(old, new, lambda a, b: a != b), lambda x: x))


def fixed_variant_scores(judged: DataFrame) -> DataFrame:
    """Normalised means per variant after the empty-output rule; row-local."""
    sv = _fix(F.col("sv"), F.col("source_outputs"), F.col("outputs"), ACROSS)
    vv = _fix(F.col("vv"), F.col("outputs"), F.col("outputs"), WITHIN)
    return judged.withColumns({"_sv": sv, "_vv": vv}).select(
        "model",
        "task_id",
        "family",
        "form",
        _mean(F.col("_sv")).alias("output_sv"),
        _mean(F.col("_vv")).alias("output_vv"),
        (_changed(F.col("sv"), F.col("_sv")) + _changed(F.col("vv"), F.col("_vv"))).alias("n_fixed"),
    )


def fixed_baseline_scores(judged: DataFrame) -> DataFrame:
    fixed = _fix(F.col("scores"), F.col("source_outputs"), F.col("source_outputs"), WITHIN)
    return judged.withColumn("_s", fixed).select(
        "model", "task_id", _mean(F.col("_s")).alias("output_baseline")
    )


def output_means(variants: DataFrame, baseline: DataFrame, group: Sequence[str]) -> DataFrame:
    """Variant → family in task → task means, with baseline minus source-variant."""
    per_task = (
        variants.join(baseline, ["model", "task_id"])
        .groupBy(*group, "task_id", "family")
        .agg(
            F.avg("output_sv").alias("sv"),
            F.avg("output_vv").alias("vv"),
            F.first("output_baseline").alias("b"),
        )
    )
    return per_task.groupBy(*group, "family").agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.avg("b").alias("baseline"),
        F.avg("sv").alias("source_variant"),
        F.avg("vv").alias("variant_internal"),
        F.avg(F.col("b") - F.col("sv")).alias("delta_baseline_minus_variant"),
    )


def task_deltas(variants: DataFrame, baseline: DataFrame, group: Sequence[str]) -> DataFrame:
    """Source-variant mean of each task and group minus the task's baseline."""
    per_task = variants.groupBy(*group, "task_id").agg(F.avg("output_sv").alias("_sv"))
    return per_task.join(baseline, ["model", "task_id"]).select(
        *group, "task_id", (F.col("_sv") - F.col("output_baseline")).alias("delta")
    )


def quadrants(joined: DataFrame, keys: Sequence[str], slack: float = 0.1) -> DataFrame:
    """Shares of variants that are consistent in structure and in output."""
    s = F.col("graph_sv") >= F.col("graph_baseline") - slack
    o = F.col("output_sv") >= F.col("output_vv") - slack
    n = F.count(F.lit(1))
    return joined.groupBy(*keys).agg(
        n.alias("n"),
        (F.count_if(s & o) / n).alias("both_consistent"),
        (F.count_if(s & ~o) / n).alias("structure_only"),
        (F.count_if(~s & o) / n).alias("output_only"),
        (F.count_if(~s & ~o) / n).alias("none_consistent"),
    )


def sanitize_verdicts(verdicts: DataFrame, annotations: DataFrame) -> DataFrame:
    """Only annotated items count; must-share items that were not named as shared are missing."""
    shared = F.array_intersect("must_share_disclosed", "must_share")
    return verdicts.join(annotations.select("task_id", "must_share", "must_not_share"), "task_id").select(
        *[c for c in verdicts.columns if c not in ("must_share_disclosed", "must_not_share_disclosed")],
        F.array_intersect("must_not_share_disclosed", "must_not_share").alias("leaked_items"),
        F.array_except("must_share", shared).alias("missing_items"),
    )


def verify_evidence(evidence: DataFrame, actions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether every quote of a verdict occurs in a text of the action it points to."""
    texts = F.array("operation", "destination", "content")
    joined = evidence.join(actions, [*keys, "action_index"], "left")
    ok = (F.coalesce("quote", F.lit("")) != "") & F.exists(
        texts, lambda t: F.coalesce(F.contains(t, F.col("quote")), F.lit(False))
    )
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_quotes"), F.bool_and(F.coalesce(ok, F.lit(False))).alias("evidence_valid")
    )


def pending_jobs(planned: DataFrame, done: DataFrame) -> DataFrame:
    """Planned jobs whose own or parent id has no result yet."""
    return planned.join(done.select("job_id"), "job_id", "left_anti").join(
        done.select(F.col("job_id").alias("parent_job_id")), "parent_job_id", "left_anti"
    )
