"""Campaign bookkeeping: task pools, cost, budgets, counters, comparisons of conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentrace.operators.ordered import running

# US dollars per million tokens.
PRICE_INPUT, PRICE_CACHED, PRICE_OUTPUT = 0.40, 0.10, 1.60


def eligible_tasks(
    pool: DataFrame, excluded: DataFrame, max_minutes: float = 60, max_timeout: float = 900
) -> DataFrame:
    """Tasks that are not hard, short enough, and not on the exclusion list."""
    return pool.filter(
        (F.col("difficulty") != "hard")
        & (F.coalesce("expert_minutes", F.lit(0)) <= max_minutes)
        & (F.coalesce("timeout_seconds", F.lit(0)) <= max_timeout)
    ).join(excluded, "task", "left_anti")


def token_cost(runs: DataFrame, group: Sequence[str]) -> DataFrame:
    """Tokens and estimated cost per group from the usage records of each call."""
    run_keys = ["task_id", "form", "repeat"]
    per_run = (
        runs.select(*group, *[k for k in run_keys if k not in group], F.inline("usage"))
        .groupBy(*group, *run_keys)
        .agg(*[F.sum(f"{t}_tokens").alias(f"{t}_tokens") for t in ("input", "cached", "output")])
    )
    i, c, o = (F.sum(f"{t}_tokens") for t in ("input", "cached", "output"))
    return per_run.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_runs"),
        i.alias("input_tokens"),
        c.alias("cached_tokens"),
        o.alias("output_tokens"),
        (((i - c) * PRICE_INPUT + c * PRICE_CACHED + o * PRICE_OUTPUT) / 1e6).alias("cost"),
    )


def within_budget(
    costs: DataFrame, keys: Sequence[str], order: str, cost: str, budget: float, parts: int | None = None
) -> DataFrame:
    """Rows started before the running cost reached the budget."""
    placed = running(costs, keys, order, sums={"running_cost": F.col(cost)}, parts=parts)
    return placed.filter(F.col("running_cost") - F.col(cost) < budget)


def extraction_convergence(extracted: DataFrame) -> DataFrame:
    """Share of variants whose extracted request equals the source's, per dataset and family."""
    source = extracted.filter(F.col("form") == "source").select(
        "task_id", F.btrim("extracted").alias("_source")
    )
    same = (F.btrim("extracted") == F.col("_source")).cast("int")
    return (
        extracted.filter(F.col("form") != "source")
        .join(source, "task_id")
        .groupBy("dataset", "family")
        .agg(F.avg(same).alias("identical_to_source"), F.count(F.lit(1)).alias("n"))
    )


def compare_conditions(
    runs: DataFrame, group: Sequence[str], value: str, conditions: tuple[str, str]
) -> DataFrame:
    """Task means of a value under two conditions side by side, and their difference."""
    per_task = runs.groupBy(*group, "condition", "task_id").agg(F.avg(value).alias("v"))
    cell = lambda agg, c: agg(F.when(F.col("condition") == c, F.col("v")))
    a, b = conditions
    return per_task.groupBy(*group).agg(
        cell(F.avg, a).alias(f"value_{a}"),
        cell(F.avg, b).alias(f"value_{b}"),
        (cell(F.avg, b) - cell(F.avg, a)).alias("change"),
        F.nullif(cell(F.count, a), F.lit(0)).alias(f"tasks_{a}"),
        F.nullif(cell(F.count, b), F.lit(0)).alias(f"tasks_{b}"),
    )


def episode_counters(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Invocations, responses and gaps of an episode; a gap censors it."""
    gaps = F.count_if(F.col("type") == "coverage_gap")
    return log.groupBy(*keys).agg(
        F.count_if(F.col("type") == "tool_invocation").alias("invocations"),
        F.count_if(F.col("type") == "fixed_tool_response").alias("responses"),
        gaps.alias("coverage_gaps"),
        (gaps > 0).alias("censored"),
    )


def short_form_jobs(counts: DataFrame) -> DataFrame:
    """Job of each task form: forms with fewer than three trials are judged on their own."""
    parts = F.split("task_form", "__")
    parent = F.concat_ws("|", F.col("agent"), parts[0])
    n = F.col("n")
    return counts.select(
        "agent",
        "task_form",
        "n",
        F.when(n < 3, F.concat(parent, F.lit("|short_"), parts[2])).otherwise(parent).alias("job_id"),
        F.expr("n * (n - 1) div 2").alias("internal_pairs"),
    )
