"""Ordered event logs: segments, active operation, outcomes, permission decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentrace.functions.text import slug
from agentrace.operators.ordered import running, with_compact_key

# Tools that only discover what is available and are not operations themselves.
AUXILIARY_TOOLS = (
    "list_apps",
    "list_private_fields",
    "list_tools",
    "describe_tool",
    "list_recorded_calls",
    "search_recorded_calls",
    "invoke_recorded_call",
    "invoke_tool",
)

# Task-id prefixes and the benchmark kind behind each.
DATASET_BY_PREFIX = {"AIP-": "permission", "ACB-": "sandbox"}
DEFAULT_DATASET = "trajectory"

CALLS = ("tool_call", "agent_tool_call")
FAILURES = ("tool_error", "invalid_tool_request")
RESULTS = ("tool_result", "agent_tool_result")
INVALID_STATUS = ("invalid_request", "invalid_tool_request")
GRANT_KEYS = ("operation", "app", "pointer", "destination")


def dataset_name(task_id: Column) -> Column:
    out = None
    for prefix, name in DATASET_BY_PREFIX.items():
        hit = task_id.startswith(prefix)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(DEFAULT_DATASET)


def result_status(has_error: Column, error: Column, status: Column) -> Column:
    """Outcome label of a result object given its ``error`` and ``status`` members."""
    return (
        F.when(has_error, F.concat(F.lit("error:"), slug(F.coalesce(error, F.lit("None")))))
        .when(status.isin(*INVALID_STATUS), F.concat(F.lit("error:"), slug(status)))
        .when(status == "environment_coverage_gap", "coverage_gap")
        .otherwise("success")
    )


def json_result_status(result: Column) -> Column:
    has_error = F.coalesce(
        F.array_contains(F.json_object_keys(result), "error"), F.lit(False)
    )
    return result_status(
        has_error, F.get_json_object(result, "$.error"), F.get_json_object(result, "$.status")
    )


def event_result_status() -> Column:
    """Status of a failure event: its result if it has one, else the event itself."""
    own = result_status(F.col("error").isNotNull(), F.col("error"), F.col("status"))
    return F.when(
        F.col("type").isin(*FAILURES) & F.col("result").isNull(), own
    ).otherwise(json_result_status(F.col("result")))


def annotate_calls(log: DataFrame, keys: Sequence[str], parts: int | None = None) -> DataFrame:
    """Add ``segment`` (calls so far), ``op_count`` and the tool of the latest tool call.

    ``active_op`` is the ordinal of the operation an event belongs to; it is NULL before the
    first call and after an auxiliary call, until the next real call.
    """
    is_call = F.col("type") == "tool_call"
    aux = F.coalesce(F.col("tool").isin(*AUXILIARY_TOOLS), F.lit(False))
    tagged = running(
        log,
        keys,
        "event_id",
        sums={
            "segment": F.when(F.col("type").isin(*CALLS), 1).otherwise(0),
            "op_count": F.when(is_call & ~aux, 1).otherwise(0),
        },
        lasts={"call": F.when(is_call, F.struct(F.col("tool").alias("tool"), aux.alias("aux")))},
        parts=parts,
    )
    return tagged.withColumn(
        "active_op", F.when(~F.col("call.aux"), F.col("op_count") - 1).cast("long")
    )


def operations(tagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per operation: ordinal, tool, outcome of the first matching result.

    The result is searched only up to the next call, i.e. inside the call's segment, so a
    grouped minimum replaces the forward scan and combines map-side.
    """
    keyed = with_compact_key(tagged, keys)
    real = ~F.col("call.aux")
    is_head = (F.col("type") == "tool_call") & real
    answers = real & (
        F.col("type").isin(*FAILURES)
        | (F.col("type").isin(*RESULTS) & (F.col("tool") == F.col("call.tool")))
    )
    head = F.struct(*keys, "segment", (F.col("op_count") - 1).cast("long").alias("op_ord"), "tool")
    grouped = (
        keyed.filter(is_head | answers)
        .groupBy("_k1", "_k2", "segment")
        .agg(
            F.max(F.when(is_head, head)).alias("_head"),
            F.min_by(
                F.when(answers, event_result_status()), F.when(answers, F.col("event_id"))
            ).alias("_status"),
        )
    )
    return grouped.filter(F.col("_head").isNotNull()).select(
        "_head.*", F.coalesce("_status", F.lit("unknown")).alias("outcome")
    )


def grant_decisions(tagged: DataFrame, keys: Sequence[str], parts: int | None = None) -> DataFrame:
    """Decision of each permission request: the first matching grant or any deny after it
    within the same segment, whichever comes first. Two backward scans, no self-join."""
    perms = tagged.filter(
        F.col("type").isin("permission_request", "permission_grant", "permission_deny")
    )
    deny = running(
        perms,
        [*keys, "segment"],
        "event_id",
        lasts={"next_deny": F.when(F.col("type") == "permission_deny", F.col("event_id"))},
        backward=True,
        parts=parts,
    )
    granted = running(
        deny,
        [*keys, "segment", *GRANT_KEYS],
        "event_id",
        lasts={
            "next_grant": F.when(
                F.col("type") == "permission_grant",
                F.struct(F.col("event_id").alias("at"), F.col("authority").alias("authority")),
            )
        },
        backward=True,
        parts=parts,
    )
    denied_first = F.col("next_deny").isNotNull() & (
        F.col("next_grant").isNull() | (F.col("next_deny") < F.col("next_grant.at"))
    )
    decision = (
        F.when(denied_first, "denied")
        .when(F.col("next_grant").isNull(), "not_granted")
        .when(F.col("next_grant.authority") == "sandbox_auto_grant", "auto_granted")
        .otherwise("granted")
    )
    return (
        granted.filter(F.col("type") == "permission_request")
        .withColumn("decision", decision)
        .drop("next_deny", "next_grant")
    )


def invocations(log: DataFrame, keys: Sequence[str], parts: int | None = None) -> DataFrame:
    """Tool invocations with the outcome of the first response of the same tool before the
    next invocation."""
    is_inv = F.col("type") == "tool_invocation"
    wanted = log.filter(F.col("type").isin("tool_invocation", "fixed_tool_response", "coverage_gap"))
    tagged = running(
        wanted,
        keys,
        "event_id",
        sums={"op_count": F.when(is_inv, 1).otherwise(0)},
        lasts={"head_id": F.when(is_inv, F.coalesce("tool_id", F.lit("\u0000")))},
        parts=parts,
        keep_key=True,
    )
    same = F.coalesce("tool_id", F.lit("\u0000")) == F.col("head_id")
    gap = F.when(F.col("type") == "coverage_gap", 1).otherwise(0)
    # Position and kind of a response fit one long, so the first response is a plain minimum that
    # is kept by hash; heads, which hold texts, are not aggregated: each begins a group of its own.
    group = ["_k1", "_k2", "op_count"]
    answers = tagged.filter(~is_inv & same).groupBy(*group).agg(F.min(F.col("event_id") * 2 + gap).alias("_first"))
    outcome = (
        F.when(F.col("_first").isNull(), "unknown")
        .when(F.col("_first") % 2 == 1, "coverage_gap")
        .otherwise("success")
    )
    return tagged.filter(is_inv).join(answers, group, "left").select(
        *keys,
        (F.col("op_count") - 1).cast("long").alias("op_ord"),
        F.coalesce("tool_name", "tool_id", F.lit("tool")).alias("tool"),
        "tool_id",
        "arguments",
        outcome.alias("outcome"),
    )


def route_builder(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Which graph builder applies to each log, from the event types present."""
    traject = F.bool_or(F.col("type").isin("tool_invocation", "fixed_tool_response", "coverage_gap"))
    plan = F.bool_or((F.col("type") == "permission_request") & F.col("field").isNotNull())
    return log.groupBy(*keys).agg(
        F.when(traject, "trajectory").when(plan, "permission").otherwise("sandbox").alias("builder")
    )
