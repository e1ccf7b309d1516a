"""Writers of results, reports and resumable logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from agentrace.operators.ordered import global_rank


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_with_report(df: DataFrame, path: str, parameters: dict[str, str], name: str = "report") -> DataFrame:
    """Write Parquet and return a one-row report; rows are counted during the write."""
    seen = Observation(name)
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    rows = seen.get["rows"]
    return df.sparkSession.createDataFrame([(path, rows, parameters)], "path string, rows long, parameters map<string,string>")


def write_frequencies(counts: DataFrame, order, path: str, top_n: int) -> None:
    """Complete ranked table, compressed, and a preview of its first rows."""
    ranked = global_rank(counts, order, "frequency_rank")
    ranked.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(f"{path}/full")
    counts.orderBy(*order).limit(top_n).write.mode("overwrite").option("header", True).csv(f"{path}/top")


def append_results(results: DataFrame, log_path: str, key: str) -> None:
    """Append results whose key the log does not hold yet, so that a rerun resumes."""
    spark = results.sparkSession
    try:
        known = spark.read.parquet(log_path).select(key)
    except Exception as exc:  # the log does not exist before the first run
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        known = None
    fresh = results.dropDuplicates([key])
    if known is not None:
        fresh = fresh.join(known, key, "left_anti")
    fresh.write.mode("append").parquet(log_path)


def write_review_queue(audited: DataFrame, path: str) -> None:
    audited.filter(~F.col("passed")).write.mode("overwrite").json(path)
