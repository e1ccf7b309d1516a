"""Incremental corpus mining: the batch transformations on a stream.

Of turns with equal text the one that stands first by (conversation, turn) counts, in whatever order
they arrive. The state of a text is that turn; when an earlier one arrives, its language takes the
place of the other, which leaves as a row of sign -1. Counts are sums of signs.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from agentrace.operators import corpus

PHRASE = ["language", "position", "n_tokens", "phrase"]
PLACE = ["conv_id", "turn", "language"]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_disk_state(spark: SparkSession) -> None:
    """Keep streaming state (the first turn of every text) on local disk with changelogs in
    the checkpoint, instead of in executor memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first turn of every text of a batch, so that a text with very many copies is cheap to send."""
    for batch in batches:
        if not batch.num_rows:
            continue
        order = [(c, "ascending") for c in ("digest", *PLACE)]
        rows = batch.take(pc.sort_indices(batch, sort_keys=order, null_placement="at_start"))
        codes = rows.column("digest").dictionary_encode().indices.to_numpy()
        yield rows.filter(pa.array(np.diff(codes, prepend=-1) != 0))


def _place(row) -> tuple:
    """Order of turns, null first."""
    return tuple((row[c] is not None, row[c] if row[c] is not None else 0) for c in PLACE)


class FirstTurn(StatefulProcessor):
    """Holds the first turn of a text and tells when its language changes."""

    def __init__(self, state: str):
        self.schema = state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", self.schema)

    def handleInputRows(self, key, rows, timerValues):
        best = min(rows, key=_place)
        known = dict(zip(PLACE, self.first.get())) if self.first.exists() else None
        if known and _place(known) <= _place(best):
            return
        self.first.update(tuple(best[c] for c in PLACE))
        if not known or known["language"] != best["language"]:
            if known:
                yield Row(normalized=best["normalized"], language=known["language"], sign=-1)
            yield Row(normalized=best["normalized"], language=best["language"], sign=1)

    def close(self) -> None:
        pass


def unique_turns(turns: DataFrame) -> DataFrame:
    """Distinct non-empty user texts as ``normalized, language, sign``; a sign of -1 takes one back.

    Phrases depend on the lower-cased text only, so texts of one digest may stand for each other.
    """
    users = corpus.with_digest(turns.filter(F.col("role") == "user")).filter(F.col("normalized") != "")
    rows = users.select("digest", *PLACE, "normalized")
    state = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in PLACE)
    return (
        rows.mapInArrow(first_of_each, rows.schema)
        .groupBy("digest")
        .transformWithState(FirstTurn(state), "normalized string, language string, sign int", "update", "none")
    )


def signed_counts(unique: DataFrame) -> DataFrame:
    """What the rows of ``unique_turns`` add to the number of distinct turns of each boundary phrase."""
    signed = unique.select(F.struct("language", "sign").alias("language"), "normalized")
    found = corpus.turn_phrases(signed).withColumns({"sign": F.col("language.sign"), "language": F.col("language.language")})
    return found.groupBy(*PHRASE).agg(F.sum("sign").alias("turn_count")).filter("turn_count <> 0")


def snapshot_writer(path: str):
    """Batch function that writes each complete result as its own version; a batch that is
    replayed after a failure overwrites its own version only."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={batch_id:010d}")

    return write


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the versions under ``path``, which sort in the order of their batches."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(jvm_path)] if fs.exists(jvm_path) else []
    return sorted(n for n in names if n.startswith("version="))


def merged_versions(spark: SparkSession, path: str, keys: list[str], count: str) -> DataFrame:
    """Sums over the versions under ``path``, each of which holds what one batch adds.

    A batch writes its own counts and nothing else; the versions meet when they are read.
    """
    added = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return added.groupBy(*keys).agg(F.sum(count).alias(count)).filter(F.col(count) != 0)


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    """Newest version under ``path``."""
    return spark.read.parquet(os.path.join(path, _versions(spark, path)[-1]))


def _follow(turns: DataFrame, checkpoint: str, write) -> None:
    use_disk_state(turns.sparkSession)
    (
        unique_turns(turns)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
        .awaitTermination()
    )


def run_phrase_counts(turns: DataFrame, checkpoint: str, output: str) -> None:
    """Process everything that is available now and stop; a later call resumes from there.

    Every batch writes the whole counts: those of the newest version before it and its own.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        counts = signed_counts(batch)
        earlier = [v for v in _versions(spark, output) if v < f"version={batch_id:010d}"]
        if earlier:
            known = spark.read.schema(counts.schema).parquet(os.path.join(output, earlier[-1]))
            both = counts.unionByName(known)
            counts = both.groupBy(*PHRASE).agg(F.sum("turn_count").alias("turn_count")).filter("turn_count <> 0")
        snapshot_writer(output)(counts, batch_id)

    _follow(turns, checkpoint, write)


def run_partial_counts(turns: DataFrame, checkpoint: str, output: str) -> None:
    """What each batch adds as a version of its own, see ``merged_versions``."""
    _follow(turns, checkpoint, lambda batch, batch_id: snapshot_writer(output)(signed_counts(batch), batch_id))
