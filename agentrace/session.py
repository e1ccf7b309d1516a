"""Session defaults shared by the benchmark, the tests and interactive use."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}
CHECKPOINTS = "spark.checkpoint.dir"
#: Whether Spark deletes the shuffles of a query when it ends, rather than when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "agentrace", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for lineage cuts: the cluster's setting, or else one beside the session's warehouse.

    The warehouse is shared by driver and executors wherever tables can be written at all, so no
    file is ever left in a folder of one machine. A folder of our own choice goes with the session.
    """
    path = spark.conf.get(CHECKPOINTS, None)
    if not path:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        path = f"{warehouse}/_checkpoints-{spark.sparkContext.applicationId}"
        spark.conf.set(CHECKPOINTS, path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
    return path


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{os.urandom(6).hex()}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate to the shared checkpoint folder and read it back.

    Used where one expensive intermediate feeds several branches: the files survive the
    loss of executors, and every branch then prunes columns on a plain Parquet scan. What was
    shuffled for it is needed no more and is deleted at once.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)
