"""Queries that run as streams over the tables and stop when everything is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentrace.plans import corpus as CP
from agentrace.plans import fixture_sql as S
from agentrace.plans.registry import query
from agentrace.session import new_folder
from agentrace.sources.tables import RUN_KEYS, runs_base, tool_log
from agentrace.streaming import logs, phrases


def table_stream(spark, sf_dir: str, name: str):
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # The pattern matches a table of one file as well as the part files of a folder.
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(
        f"{sf_dir}/{name}.parque[t]"
    )


ARRIVALS = 3


def in_arrivals(spark, sf_dir: str, name: str, key: list[str], run) -> None:
    """Let a table arrive in three parts, each of them followed by ``run(stream of the table)``.

    Parts are drawn by a hash of ``key``, so rows come in another order than the table's.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    folder = new_folder(spark, name)
    for part in range(ARRIVALS):
        arrived = rows.filter(F.pmod(F.xxhash64(*key), F.lit(ARRIVALS)) == part)
        arrived.write.mode("append").parquet(folder)
        run(spark.readStream.schema(rows.schema).parquet(folder))


UNFILTERED = CP.PHRASES.replace(f" HAVING count(*) >= {CP.MIN_COUNT}", "")


@query("streaming_phrase_counts", f"WITH {UNFILTERED} SELECT * FROM pc")
def streaming_phrase_counts(spark, sf_dir):
    folder = new_folder(spark, "phrases")
    count = lambda t: phrases.run_phrase_counts(CP.decorate(t), f"{folder}/checkpoint", f"{folder}/counts")
    in_arrivals(spark, sf_dir, "conversations", ["conv_id", "turn"], count)
    return phrases.latest_version(spark, f"{folder}/counts")


@query("streaming_partial_counts", f"WITH {UNFILTERED} SELECT * FROM pc")
def streaming_partial_counts(spark, sf_dir):
    folder = new_folder(spark, "partials")
    count = lambda t: phrases.run_partial_counts(CP.decorate(t), f"{folder}/checkpoint", f"{folder}/counts")
    in_arrivals(spark, sf_dir, "conversations", ["conv_id", "turn"], count)
    return phrases.merged_versions(spark, f"{folder}/counts", phrases.PHRASE, "turn_count")


@query(
    "streaming_operations",
    f"WITH {S.TOOL_OPS} SELECT model, task_id, family, form, repeat, op_ord, tool, outcome FROM ops",
)
def streaming_operations(spark, sf_dir):
    """Logs that grow in three parts, whose events therefore aren't stored in log order."""
    folder = new_folder(spark, "logs")
    from agentrace.sources.tables import keyed_events

    def follow(events):
        log = tool_log(keyed_events(events))
        logs.follow_logs(log, f"{folder}/checkpoint", f"{folder}/log", f"{folder}/ops", RUN_KEYS)

    in_arrivals(spark, sf_dir, "events", ["event_id"], follow)
    ops = logs.current_operations(spark.read.parquet(f"{folder}/ops"), RUN_KEYS)
    return ops.select(*RUN_KEYS, "op_ord", "tool", "outcome")


@query(
    "streaming_resume",
    f"""WITH {S.BASE} SELECT task_id, form, repeat, count(*) AS n FROM base WHERE NOT (repeat = 0) GROUP BY ALL""",
)
def streaming_resume(spark, sf_dir):
    """Events of executions that a static table of finished ones does not list."""
    from agentrace.sources.tables import keyed_events

    folder = new_folder(spark, "resume")
    done = runs_base(spark, sf_dir).filter(F.col("repeat") == 0).select("task_id", "form", "repeat").distinct()
    planned = keyed_events(table_stream(spark, sf_dir, "events")).select("task_id", "form", "repeat")
    (
        logs.unfinished(planned, done, ["task_id", "form", "repeat"])
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .option("path", f"{folder}/rows")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    rows = spark.read.schema(planned.schema).parquet(f"{folder}/rows")
    return rows.groupBy("task_id", "form", "repeat").agg(F.count(F.lit(1)).alias("n"))
