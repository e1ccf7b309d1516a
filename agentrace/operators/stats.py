"""Task bootstrap, ranks and rank correlation, quantiles, hash-ranked samples and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentrace.operators import resampling
from agentrace.operators.ordered import dense_index, with_compact_key
from agentrace.operators.resampling import INNER, OUTER, PRIME  # noqa: F401
from agentrace.session import materialize

#: Units of a group that one slice holds.
SLICE = 4096
#: Replicates that one copy of a chunk's units serves, and whose draws of slices one row stands for.
REPLICATES_A_BLOCK = 512
REPLICATES_A_ROW = 64


def group_start(keys: Sequence[str]) -> Column:
    """A number below 2^28 from a group's keys, so that groups of equal size draw differently."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *keys)), 1, 7), 16, 10).cast("long")


def bootstrap_means(
    values: DataFrame,
    keys: Sequence[str],
    unit: str,
    value: str,
    replicates: int,
    seed: int = 0,
    slice_size: int = SLICE,
) -> DataFrame:
    """Means of ``replicates`` resamples of the units of each group.

    A group's units lie in slices of ``slice_size``. For each replicate every draw first picks a
    slice, which only counts, and the draws of a slice then pick units inside it: together each unit
    is equally likely, as in one step. Tasks make draws as arrays. What is shuffled are a replicate's
    counts, packed by chunk of slices, and each chunk's units once a block of replicates, not the
    draws and no row for each slice. NULL values are drawn, but don't count in the mean.
    """
    group = ["_k1", "_k2"]
    # Rows are few and small but each stands for many draws, so tasks aren't merged by their bytes.
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = materialize(values.select(*keys, unit, value), "units")
    sizes = with_compact_key(values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys)
    first = F.explode(F.array(*[F.lit(b).cast("long") for b in range(0, replicates, REPLICATES_A_ROW)]))
    slots = (
        sizes.select(*group, "_n", group_start(keys).alias("_start"), first.alias("_first"))
        .withColumn("_last", F.least(F.col("_first") + REPLICATES_A_ROW, F.lit(replicates)) - 1)
        .repartition(tasks, *group, "_first")
    )
    cogroup = [*group, "_chunk", "_block"]
    dealt = (
        slots.mapInArrow(resampling.count_draws(slice_size, seed), resampling.COUNTS)
        .withColumn("_block", F.floor(F.col("_b") / REPLICATES_A_BLOCK))
        .repartition(tasks, *cogroup)
    )
    indexed = with_compact_key(dense_index(values, keys, unit, "_j"), keys)
    blocks = F.sequence(F.lit(0).cast("long"), F.lit((replicates - 1) // REPLICATES_A_BLOCK).cast("long"))
    a_chunk = max(1, resampling.UNITS_A_CHUNK // slice_size) * slice_size
    units = indexed.select(
        *group,
        F.floor(F.col("_j") / a_chunk).alias("_chunk"),
        F.explode(blocks).alias("_block"),
        F.col("_j").cast("long").alias("_j"),
        F.col(value).cast("double").alias("_v"),
    ).repartition(tasks, *cogroup)
    total, present = F.sum("_total"), F.sum("_present")
    return (
        dealt.groupBy(*cogroup)
        .cogroup(units.groupBy(*cogroup))
        .applyInArrow(resampling.sum_draws(slice_size, seed), resampling.SUMS)
        .groupBy(*group, "_b")
        .agg(F.when(present > 0, total / present).alias("estimate"))
        .join(sizes.select(*keys, *group), group)
        .select(*keys, F.col("_b").alias("replicate"), "estimate")
    )


def bootstrap_ci_percentile(
    values: DataFrame,
    keys: Sequence[str],
    unit: str,
    value: str,
    replicates: int = 10000,
    seed: int = 0,
    slice_size: int = SLICE,
) -> DataFrame:
    """95% interval by linear interpolation; a single unit gives its own value."""
    est = bootstrap_means(values, keys, unit, value, replicates, seed, slice_size)
    return est.groupBy(*keys).agg(
        F.percentile("estimate", F.lit(0.025)).alias("ci_low"),
        F.percentile("estimate", F.lit(0.975)).alias("ci_high"),
    )


def bootstrap_ci_order_stat(
    values: DataFrame,
    keys: Sequence[str],
    unit: str,
    value: str,
    replicates: int = 2000,
    seed: int = 0,
    slice_size: int = SLICE,
) -> DataFrame:
    """95% interval by picking the sorted estimates at int(.025 B) and int(.975 B) - 1; NULL
    with fewer than two units."""
    est = bootstrap_means(values, keys, unit, value, replicates, seed, slice_size)
    lo, hi = int(0.025 * replicates), int(0.975 * replicates) - 1
    picked = est.groupBy(*keys).agg(F.array_sort(F.collect_list("estimate")).alias("_e"))
    sizes = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_units"))
    several = F.col("n_units") >= 2
    return sizes.join(picked, list(keys)).select(
        *keys,
        "n_units",
        F.when(several, F.col("_e")[lo]).alias("ci_low"),
        F.when(several, F.col("_e")[hi]).alias("ci_high"),
    )


def excludes_zero(low: Column, high: Column) -> Column:
    return (low > 0) | (high < 0)


def cumulative_counts(
    counts: DataFrame, keys: Sequence[str], value: str, n: str, scale: float = 4096.0
) -> DataFrame:
    """Add ``below``: how many items of the group have a smaller value.

    ``counts`` has one row per distinct value. Values are cut into ordered buckets, so the
    running count of a large group is spread over many tasks.
    """
    parted = counts.withColumn("_bucket", F.floor(F.col(value) * scale))
    totals = parted.groupBy(*keys, "_bucket").agg(F.sum(n).alias("_total"))
    over_buckets = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = totals.select(
        *keys, "_bucket", F.coalesce(F.sum("_total").over(over_buckets), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        parted.withColumn("below", F.coalesce(F.sum(n).over(inside), F.lit(0)))
        .join(offsets, [*keys, "_bucket"])
        .withColumn("below", F.col("below") + F.col("_offset"))
        .drop("_bucket", "_offset")
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], scale: float = 4096.0
) -> DataFrame:
    """Exact interpolated quantiles per group from counts of distinct values."""
    present = df.filter(F.col(value).isNotNull())
    counts = present.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    totals = present.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    placed = cumulative_counts(counts, keys, "_v", "_n", scale).join(totals, list(keys))
    aggs = []
    for name, p in probs.items():
        target = (F.col("_total") - 1) * p
        for tag, at in (("lo", F.floor(target)), ("hi", F.ceil(target))):
            inside = (F.col("below") <= at) & (at < F.col("below") + F.col("_n"))
            aggs.append(F.max(F.when(inside, F.col("_v"))).alias(f"_{name}_{tag}"))
    picked = placed.groupBy(*keys).agg(F.first("_total").alias("_total"), *aggs)
    out = []
    for name, p in probs.items():
        target = (F.col("_total") - 1) * p
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((lo + (hi - lo) * (target - F.floor(target))).alias(name))
    return picked.select(*keys, F.col("_total").alias("n"), *out)


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str, scale: float = 4096.0) -> DataFrame:
    """Average rank of each distinct value within its group, with the number of its peers."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("peers"))
    return cumulative_counts(counts, keys, value, "peers", scale).select(
        *keys, value, (F.col("below") + (F.col("peers") + 1) / 2).alias(name), "peers"
    )


def spearman(
    df: DataFrame, keys: Sequence[str], x: str, y: str, strata: Sequence[str] = ()
) -> DataFrame:
    """Spearman correlation per group with average ranks.

    With ``strata`` ranks are taken inside each stratum, centred and divided by the stratum
    size, and pooled. Equal (x, y) points are counted once with their weight before ranking.
    """
    groups = [*keys, *strata]
    if not groups:
        df, groups = df.withColumn("_all", F.lit(1)), ["_all"]
    points = df.groupBy(*groups, x, y).agg(F.count(F.lit(1)).alias("_w"))
    weigh = lambda c: points.groupBy(*groups, c).agg(F.sum("_w").alias("_n"))
    rank = lambda c: cumulative_counts(weigh(c), groups, c, "_n").select(
        *groups, c, (F.col("below") + (F.col("_n") + 1) / 2).alias(f"_r_{c}")
    )
    sizes = points.groupBy(*groups).agg(F.sum("_w").alias("_size"))
    ranked = points.join(rank(x), [*groups, x]).join(rank(y), [*groups, y]).join(sizes, groups)
    scale_by = F.col("_size") if strata else F.lit(1.0)
    rx = (F.col(f"_r_{x}") - (F.col("_size") + 1) / 2) / scale_by
    ry = (F.col(f"_r_{y}") - (F.col("_size") + 1) / 2) / scale_by
    w = F.col("_w")
    out_keys = list(keys) or []
    moments = ranked.groupBy(*out_keys).agg(
        F.sum(w).alias("n"),
        F.sum(w * rx * ry).alias("_xy"),
        F.sum(w * rx * rx).alias("_xx"),
        F.sum(w * ry * ry).alias("_yy"),
    )
    den = F.sqrt(F.col("_xx") * F.col("_yy"))
    return moments.select(*out_keys, "n", F.when(den > 0, F.col("_xy") / den).alias("rho"))


def hash_key(salt: str, identity: Column) -> Column:
    return F.sha2(F.concat(F.lit(salt), identity), 256)


def hash_sample(df: DataFrame, id_col: str, salt: str, n: int) -> DataFrame:
    """First n rows by salted hash of the id: a top-k that never sorts the whole table."""
    return df.withColumn("hash_key", hash_key(salt, F.col(id_col))).orderBy("hash_key").limit(n)


def hash_sample_per_stratum(
    df: DataFrame, stratum: str, id_col: str, salt: str, n: int
) -> DataFrame:
    """First n rows of each stratum by salted hash.

    Two rounds: the best n of every (stratum, hash slice), then the best n of those, so a
    stratum with most of the rows is ranked in parallel.
    """
    keyed = df.withColumn("hash_key", hash_key(salt, F.col(id_col)))
    part = F.substring("hash_key", 63, 2)
    first = Window.partitionBy(stratum, part).orderBy("hash_key")
    second = Window.partitionBy(stratum).orderBy("hash_key")
    return (
        keyed.withColumn("_r", F.row_number().over(first))
        .filter(F.col("_r") <= n)
        .withColumn("hash_rank", F.row_number().over(second))
        .filter(F.col("hash_rank") <= n)
        .drop("_r")
    )


def stratified_split(
    df: DataFrame, stratum: str, id_col: str, salt: str, train_share: float = 0.8
) -> DataFrame:
    """Add ``split``: the first ``int(share * n)`` rows of each stratum in hash order train."""
    keyed = df.withColumn("_h", F.md5(F.concat(F.lit(salt), F.col(id_col).cast("string"))))
    indexed = dense_index_by_hash(keyed, [stratum], "_h", "_i")
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    return (
        indexed.join(sizes, stratum)
        .withColumn(
            "split",
            F.when(F.col("_i") < F.floor(F.col("_n") * train_share), "train").otherwise("test"),
        )
        .drop("_h", "_i", "_n")
    )


def dense_index_by_hash(df: DataFrame, keys: Sequence[str], hash_col: str, name: str) -> DataFrame:
    """Zero-based index in the order of a hex hash column, numbered per hash prefix."""
    parted = df.withColumn("_b", F.substring(hash_col, 1, 2))
    counts = parted.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    within = Window.partitionBy(*keys, "_b").orderBy(hash_col)
    return (
        parted.withColumn(name, F.row_number().over(within) - 1)
        .join(offsets, [*keys, "_b"])
        .withColumn(name, F.col(name) + F.col("_offset"))
        .drop("_b", "_offset")
    )
