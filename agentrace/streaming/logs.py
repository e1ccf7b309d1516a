"""Growing execution logs: operations of the executions that changed, and resumable plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentrace.operators.logs import invocations

BUCKETS = 64


def with_bucket(events: DataFrame, keys: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """The bucket of an execution, by a hash of its key."""
    return events.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def stored_events(batch: DataFrame, log_path: str, batch_id: int, keys: Sequence[str]) -> DataFrame:
    """All stored events of the executions that ``batch``, which is stored already, has events of.

    Only the buckets that the batch touches are read, of the batches up to this one: both are
    folders, so others aren't opened. Their numbers, at most the number of buckets, are listed here.
    """
    stored = batch.sparkSession.read.parquet(log_path)
    own = stored.filter(F.col("batch") == batch_id)
    touched = sorted(r.bucket for r in own.select("bucket").distinct().collect())
    read = stored.filter(F.col("bucket").isin(touched) & (F.col("batch") <= batch_id))
    return read.join(own.select(*keys).distinct(), list(keys), "left_semi").drop("batch", "bucket")


def operations_writer(log_path: str, ops_path: str, keys: Sequence[str], buckets: int = BUCKETS):
    """Batch function that stores new events by bucket and recomputes the operations of the
    executions they belong to. Events and operations are written per batch id, so a replay
    overwrites its own files; readers take the newest operations of an execution."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # The stream's batch is read once; what follows starts from the files it left.
        dealt = with_bucket(batch, keys, buckets).hint("rebalance", "bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{log_path}/batch={batch_id}")
        changed = stored_events(batch, log_path, batch_id, keys)
        invocations(changed, keys).write.mode("overwrite").parquet(f"{ops_path}/batch={batch_id}")

    return write


def current_operations(ops: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Operations from the last batch that touched each execution."""
    last = ops.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return ops.join(last, [*keys, "batch"], "left_semi").drop("batch")


def follow_logs(
    events: DataFrame, checkpoint: str, log_path: str, ops_path: str, keys: Sequence[str], buckets: int = BUCKETS
) -> None:
    """Process what is available now. ``buckets`` stays the same for the life of a store; take as many
    as keep the files of one of them readable in a batch."""
    (
        events.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(operations_writer(log_path, ops_path, keys, buckets))
        .start()
        .awaitTermination()
    )


def unfinished(planned_stream: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned executions that have no result yet: a stream-static anti-join."""
    return planned_stream.join(done.select(*keys), list(keys), "left_anti")
