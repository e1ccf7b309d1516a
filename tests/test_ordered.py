"""Scans over ranges must equal plain ones, whatever their number and however hot a log is."""

import random

import pytest
from pyspark.sql import functions as F

from agentrace.operators.ordered import dense_index, following, global_rank, running


def skewed_rows(seed=1):
    rng = random.Random(seed)
    rows, pos = [], {}
    for _ in range(300):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(20)}"
        pos[key] = pos.get(key, 0) + rng.randrange(1, 4)
        rows.append((key, pos[key], rng.randrange(5), rng.choice(["a", "b", None])))
    rng.shuffle(rows)
    return rows


def expected(rows, backward):
    out = {}
    for key in {r[0] for r in rows}:
        total, last = 0, None
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: r[1], reverse=backward):
            total += r[2]
            last = r[3] if r[3] is not None else last
            out[(key, r[1])] = (total, last)
    return out


@pytest.mark.parametrize("parts", [1, 3, 50, None])
@pytest.mark.parametrize("backward", [False, True])
def test_running_equals_sequential_scan(spark, parts, backward):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "k string, pos long, n int, v string")
    got = running(
        df,
        ["k"],
        "pos",
        sums={"total": F.col("n")},
        lasts={"last": F.col("v")},
        before={"prior": F.col("v")},
        backward=backward,
        parts=parts,
    ).collect()
    assert {(r.k, r.pos): (r.total, r.last) for r in got} == expected(rows, backward)
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in got if r.k == key), key=lambda r: r.pos, reverse=backward)
        assert [r.prior for r in mine] == [None, *[r.last for r in mine[:-1]]]


def test_running_treats_null_keys_as_equal(spark):
    df = spark.createDataFrame(
        [(None, "x", 0), (None, "x", 5), ("x", None, 1), ("x", None, 9)], "a string, b string, pos long"
    )
    got = running(df, ["a", "b"], "pos", sums={"n": F.lit(1)}, parts=2).collect()
    assert sorted((r.pos, r.n) for r in got) == [(0, 1), (1, 1), (5, 2), (9, 2)]


@pytest.mark.parametrize("chunk", [1, 4, 1000])
def test_following_crosses_chunks(spark, chunk):
    df = spark.createDataFrame([("k", i * 2, f"v{i}") for i in range(20)], "k string, pos long, v string")
    got = following(df, ["k"], "pos", "v", "nxt", 3, chunk).collect()
    for r in got:
        i = r.pos // 2
        assert r.nxt == [f"v{j}" for j in range(i + 1, min(i + 4, 20))]


def test_dense_index_is_a_bijection_per_group(spark):
    df = spark.createDataFrame([("g" if i % 3 else "h", f"id{i}") for i in range(90)], "g string, id string")
    got = dense_index(df, ["g"], "id", "i").collect()
    for g, n in (("g", 60), ("h", 30)):
        assert sorted(r.i for r in got if r.g == g) == list(range(n))


def test_global_rank_matches_sort(spark):
    rows = [(i % 7, f"p{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "n int, p string").repartition(5)
    got = global_rank(df, [F.desc("n"), F.asc("p")], "rank").collect()
    want = {p: i + 1 for i, (_, p) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))}
    assert {r.p: r["rank"] for r in got} == want
