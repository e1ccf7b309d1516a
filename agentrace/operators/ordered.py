"""Running values over ordered logs that stay balanced when one log is huge.

A plain window partitioned by the log key sends a whole log to one task. Here rows are dealt into even
ranges of (log, position) instead, whatever the sizes of logs and the distances of their ids, and
scanned within each range. A log lies in several ranges only if it ends one and begins the next, so
the values carried on are a table of two rows a range at most, which is added to the scanned rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of one part of `following`.
STRIDE = 1 << 18


def compact_key(keys: Sequence[str]) -> list[Column]:
    """Key columns as a 128-bit hash in two longs.

    Sorting and joining on two longs is several times cheaper than on a handful of strings, and
    a collision among 10^12 keys has a probability below 10^-14. NULL keys equal each other.
    """
    parts = [c for k in keys for c in (F.col(k), F.isnull(k))]
    return [F.xxhash64(F.lit(1), *parts).alias("_k1"), F.xxhash64(F.lit(2), *reversed(parts)).alias("_k2")]


def with_compact_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    k1, k2 = compact_key(keys)
    return df.withColumns({"_k1": k1, "_k2": k2})


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    before: Mapping[str, Column] | None = None,
    backward: bool = False,
    parts: int | None = None,
    keep_key: bool = False,
) -> DataFrame:
    """Add inclusive running sums and last-non-null values of each log in ``order``.

    ``before`` are last-non-null values of the rows before a row. ``backward`` scans from the end of
    the log, which turns "last" into "next". ``order`` must be an integer column, unique within a
    log. ``parts`` is the number of ranges, by default that of the session's shuffles. ``keep_key``
    leaves the compact key of the log (``_k1``, ``_k2``) in the result.

    The scanned rows are written once, so the input is read for this, and by Spark for the
    borders of the ranges, but not again by what follows.
    """
    from agentrace.session import materialize

    sums, lasts, before = dict(sums or {}), dict(lasts or {}), dict(before or {})
    log, at = ["_k1", "_k2"], F.col(order)
    direction = at.desc() if backward else at.asc()
    place = [*log, order]
    whole = with_compact_key(df, keys)
    ranged = whole.repartitionByRange(parts, *place) if parts else whole.repartitionByRange(*place)
    inside = Window.partitionBy("_part", *log).orderBy(direction)
    scan = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = inside.rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda c: F.last(c, ignorenulls=True)
    carried = {name: f"_at_{name}" for name in before}
    scanned = ranged.withColumn("_part", F.spark_partition_id()).withColumns(
        {name: F.coalesce(F.sum(c).over(scan), F.lit(0)) for name, c in sums.items()}
        | {name: seen(c).over(scan) for name, c in lasts.items()}
        | {name: seen(c).over(ahead) for name, c in before.items()}
        | {carried[name]: seen(c).over(scan) for name, c in before.items()}
        | {"_ends": F.lead(F.lit(1)).over(inside).isNull()}
    )
    stored = materialize(scanned, "running")
    ends = ("_part", *log)
    key = F.struct(*log)
    borders = stored.groupBy("_part").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    several = (
        borders.select(F.inline(F.array_distinct(F.array("low", "high"))))
        .groupBy(*log)
        .count()
        .where("count > 1")
        .select(*log)
    )
    tails = stored.where("_ends").select(*ends, *sums, *lasts, *carried.values()).join(several, log)
    earlier = Window.partitionBy(*log).orderBy(F.desc("_part") if backward else F.asc("_part"))
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select(
        *ends,
        *[F.sum(name).over(earlier).alias(f"_c_{name}") for name in sums],
        *[seen(F.col(name)).over(earlier).alias(f"_c_{name}") for name in lasts],
        *[seen(F.col(at_end)).over(earlier).alias(f"_c_{name}") for name, at_end in carried.items()],
    )
    # At most two rows for each range, and the number of ranges is a setting.
    joined = stored.join(F.broadcast(materialize(carry, "carry")), list(ends), "left")
    merged = {name: F.col(name) + F.coalesce(F.col(f"_c_{name}"), F.lit(0)) for name in sums} | {
        name: F.coalesce(F.col(name), F.col(f"_c_{name}")) for name in (*lasts, *before)
    }
    helper = ["_part", "_ends", *carried.values(), *[f"_c_{name}" for name in merged]]
    result = joined.withColumns(merged).drop(*helper)
    return result if keep_key else result.drop(*log)


def global_rank(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """1-based rank in a total order without a single-partition window.

    The rows are range-partitioned by the order, counted per partition, and numbered from the
    offset of their partition. The sorted rows are written once so that counting and numbering
    see the same partitions even when executors are lost in between.
    """
    from agentrace.session import materialize

    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    stored = materialize(ranged, "rank")
    per_part = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    within = Window.partitionBy("_part").orderBy(*order)
    return (
        stored.join(offsets, "_part")
        .withColumn(name, F.row_number().over(within) + F.col("_offset"))
        .drop("_part", "_offset")
    )


def dense_index(df: DataFrame, keys: Sequence[str], id_col: str, name: str) -> DataFrame:
    """Zero-based index of each row in its group, in the order (hash prefix of id, id).

    The hash prefix cuts every group into 256 even parts, so that a group holding a third of
    all rows is numbered by many tasks.
    """
    parted = df.withColumn("_b", F.substring(F.md5(F.col(id_col).cast("string")), 1, 2))
    counts = parted.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    within = Window.partitionBy(*keys, "_b").orderBy(id_col)
    return (
        parted.withColumn(name, F.row_number().over(within) - 1)
        .join(offsets, [*keys, "_b"])
        .withColumn(name, F.col(name) + F.col("_offset"))
        .drop("_b", "_offset")
    )


def following(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    name: str,
    n: int,
    chunk: int = STRIDE,
) -> DataFrame:
    """Add the array of the next ``n`` values of the log after each row (fewer at its end)."""
    chunked = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk)))
    ahead = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(1, n)
    place = Window.partitionBy(*keys, "_chunk").orderBy(order)
    local = chunked.withColumn(name, F.collect_list(value).over(ahead))

    heads = (
        chunked.select(*keys, "_chunk", order, value, F.row_number().over(place).alias("_rn"))
        .filter(F.col("_rn") <= n)
        .groupBy(*keys, "_chunk")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct(F.col("_rn"), F.col(value).alias("v")))),
                lambda s: s["v"],
            ).alias("_head")
        )
    )
    next_chunks = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(1, n)
    tails = (
        heads.withColumn("_tail", F.slice(F.flatten(F.collect_list("_head").over(next_chunks)), 1, n))
        .filter(F.size("_tail") > 0)
        .drop("_head")
    )
    joined = local.join(tails, [*keys, "_chunk"], "left")
    tail = F.coalesce("_tail", F.array().cast(df.select(F.array(value)).schema[0].dataType))
    return joined.withColumn(name, F.slice(F.concat(F.col(name), tail), 1, n)).drop("_chunk", "_tail")
