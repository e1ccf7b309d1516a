"""Readers for the analytical tables and the execution logs derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentrace.session import materialize

RUN_KEYS = ("model", "task_id", "family", "form", "repeat")

# The ten forms of a task, in day order (three days, one per repeat, each).
FORMS = ("source", "p01", "n01", "i01", "p02", "n02", "lang_zh", "lang_fr", "lang_de", "formulation")
PREFIXES = ("AIP-", "ACB-", "TJB-")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def runs_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_events(table(spark, sf_dir, "events"))


def stored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, written once for plans that read the log many times."""
    return materialize(runs_base(spark, sf_dir), "runs")


def keyed_events(events: DataFrame) -> DataFrame:
    """``events`` keyed as executions: one log per user and day, three days per form."""
    ev = events.select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (F.dayofmonth("ts") - 1).alias("d"),
    )
    form_idx = F.floor(F.col("d") / 3).cast("int")
    prefix = pick(PREFIXES, (F.floor(F.col("user_id") / 3) % 3).cast("int"))
    return ev.select(
        F.concat(F.lit("model_"), (F.col("user_id") % 3).cast("string")).alias("model"),
        F.concat(prefix, F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("task_id"),
        F.when(form_idx == 0, "source")
        .when(form_idx <= 5, "tone")
        .when(form_idx <= 8, "multilingual")
        .otherwise("formulation")
        .alias("family"),
        pick(FORMS, form_idx).alias("form"),
        (F.col("d") % 3).alias("repeat"),
        "user_id",
        "event_id",
        "event_type",
        "value",
        "k",
    )


def tool_log(base: DataFrame) -> DataFrame:
    """Tool-trajectory log: every event is an invocation, mostly followed by its response."""
    k = F.col("k")
    args = F.concat(F.lit('{"k": '), (k % 5).cast("string"), F.lit("}"))
    response = F.when(F.col("value") > 150, "coverage_gap").when(
        k % 10 != 9, "fixed_tool_response"
    )
    rows = F.array(
        F.struct(F.lit(0).alias("i"), F.lit("tool_invocation").alias("type"), args.alias("args")),
        F.struct(
            F.lit(1).alias("i"), response.alias("type"), F.lit(None).cast("string").alias("args")
        ),
    )
    return (
        base.withColumn("row", F.explode(rows))
        .filter(F.col("row.type").isNotNull())
        .select(
            *RUN_KEYS,
            (F.col("event_id") * 2 + F.col("row.i")).alias("event_id"),
            F.col("row.type").alias("type"),
            F.col("event_type").alias("tool_id"),
            F.col("event_type").alias("tool_name"),
            F.col("row.args").alias("arguments"),
        )
    )


def sandbox_log(base: DataFrame) -> DataFrame:
    """App-sandbox log: calls, results, permissions, reads and disclosures."""
    k, et = F.col("k"), F.col("event_type")
    text = lambda c: c.cast("string")
    kind = (
        F.when((et == "click") & (k % 6 == 5), "agent_tool_call")
        .when(et == "click", "tool_call")
        .when((et == "error") & (k % 3 == 0), "tool_error")
        .when(et == "error", "tool_result")
        .when((et == "signup") & (k % 4 <= 1), "permission_request")
        .when((et == "signup") & (k % 4 == 2), "permission_grant")
        .when((et == "signup") & (k % 8 == 7), "permission_deny")
        .when(et == "signup", "state_change")
        .when(et == "view", "access")
        .otherwise("disclosure")
    )
    permission = (et == "signup") & (k % 4 <= 2)
    call_tool = F.when(k % 4 == 3, "list_apps").otherwise(F.concat(F.lit("Tool "), text(k % 4)))
    tool = F.when(et == "click", call_tool).when(
        (et == "error") & (k % 3 != 0), F.concat(F.lit("Tool "), text(k % 3))
    )
    result = F.when(
        (et == "error") & (k % 3 == 1),
        F.when(k % 2 == 0, F.lit('{"ok": 1}')).otherwise(
            F.concat(F.lit('{"error": "Bad code '), text(k % 5), F.lit('"}'))
        ),
    ).when((et == "error") & (k % 3 == 2), F.lit('{"status": "environment_coverage_gap"}'))
    return base.select(
        *RUN_KEYS,
        "user_id",
        "event_id",
        "k",
        kind.alias("type"),
        tool.alias("tool"),
        F.when(et.isin("signup", "view"), F.concat(F.lit("app_"), text(F.floor(k / 4) % 2))).alias("app"),
        F.lit(None).cast("string").alias("field"),
        F.when((et == "signup") & (k % 4 <= 1), pick(("once", "session", "persistent"), k % 3)).alias("scope"),
        F.when(permission, F.lit("read"))
        .when(et == "purchase", pick(("send_message", "add_todo"), k % 2))
        .alias("operation"),
        F.when(permission & (k % 5 != 0), F.lit("/inbox")).alias("pointer"),
        F.when((et == "purchase") & (k % 7 != 0), F.concat(F.lit("r"), text(k % 5)))
        .when((et == "signup") & (k % 4 == 3), F.concat(F.lit("d"), text(k % 3)))
        .alias("destination"),
        F.when((et == "purchase") & (k % 7 == 0), F.concat(F.lit("R "), text(k % 3))).alias("recipient"),
        F.when(
            et == "view",
            F.when(
                k % 3 == 0,
                F.array(F.concat(F.lit("f"), text(k % 4)), F.concat(F.lit("f"), text(k % 5))),
            ).otherwise(F.array(F.concat(F.lit("f"), text(k % 4)))),
        ).alias("fields"),
        F.when(et == "purchase", F.concat(F.lit("Item "), text(k % 7))).alias("payload"),
        F.when((et == "signup") & (k % 4 == 2) & (k % 3 == 0), F.lit("sandbox_auto_grant")).alias("authority"),
        F.when((et == "error") & (k % 6 == 0), F.concat(F.lit("Oops "), text(k % 5))).alias("error"),
        F.lit(None).cast("string").alias("status"),
        result.alias("result"),
        "value",
    )


def permission_log(base: DataFrame) -> DataFrame:
    """Permission-plan log: calls and field requests only."""
    k, et = F.col("k"), F.col("event_type")
    return base.filter(et.isin("signup", "click")).select(
        *RUN_KEYS,
        "event_id",
        F.when(et == "click", "tool_call").otherwise("permission_request").alias("type"),
        F.when(
            et == "click",
            F.when(k % 4 == 3, "list_private_fields").otherwise(
                F.concat(F.lit("plan_"), (k % 4).cast("string"))
            ),
        ).alias("tool"),
        F.when(et == "signup", F.concat(F.lit("f"), (k % 6).cast("string"))).alias("field"),
        F.when(et == "signup", pick(("once", "persistent"), k % 2)).alias("scope"),
        F.lit(None).cast("string").alias("result"),
        F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("string").alias("status"),
    )


def results(base: DataFrame) -> DataFrame:
    """One result record per execution."""
    sum_k = F.sum("k")
    n = F.count(F.lit(1))
    return (
        base.groupBy(*RUN_KEYS)
        .agg(n.alias("tool_calls"), sum_k.alias("sum_k"), F.min("value").alias("min_value"))
        .select(
            *RUN_KEYS,
            F.when(F.col("min_value") < 0.5, "infrastructure_error")
            .when(F.col("tool_calls") >= 6, "turn_budget")
            .otherwise("finished_response")
            .alias("status"),
            F.when((F.col("tool_calls") % 2 == 1) & (F.col("sum_k") % 7 == 0), "")
            .otherwise(F.concat(F.lit("answer "), (F.col("sum_k") % 4).cast("string")))
            .alias("final_response"),
            "tool_calls",
            (F.col("sum_k") % 3).cast("int").alias("clarification_rounds"),
            "sum_k",
        )
    )


__all__ = [
    "FORMS",
    "RUN_KEYS",
    "keyed_events",
    "permission_log",
    "results",
    "runs_base",
    "sandbox_log",
    "stored_runs",
    "table",
    "tool_log",
]
