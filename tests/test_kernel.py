"""The hash kernel against a text kernel, and its invariants."""

import hashlib
import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from agentrace.operators import graphs, kernel

KEYS = ["model", "task_id", "family", "form", "repeat"]


def bag(nodes, edges, h=2):
    labels = dict(nodes)
    out = Counter((0, v) for v in labels.values())
    for i in range(1, h + 1):
        fresh = {}
        for n in labels:
            around = sorted(
                [f"OUT|{r}|{labels[d]}" for s, d, r in edges if s == n]
                + [f"IN|{r}|{labels[s]}" for s, d, r in edges if d == n]
            )
            fresh[n] = hashlib.sha256((labels[n] + "||" + "||".join(around)).encode()).hexdigest()
        labels = fresh
        out.update((i, v) for v in labels.values())
    return out


def cosine(a, b):
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    return sum(v * b[k] for k, v in a.items()) / math.sqrt(
        sum(v * v for v in a.values()) * sum(v * v for v in b.values())
    )


def random_graph(rng):
    n = rng.randrange(0, 6)
    nodes = {f"n{i}": rng.choice("abc") for i in range(n)}
    edges = [
        (rng.choice(list(nodes)), rng.choice(list(nodes)), rng.choice(["r", "s", graphs.PRECEDES]))
        for _ in range(rng.randrange(0, 8))
        if n
    ]
    return nodes, edges


@pytest.fixture(scope="module")
def sample(spark):
    rng = random.Random(3)
    runs = {}
    for family, form in (("source", "source"), ("tone", "p01"), ("tone", "n01")):
        for repeat in range(3):
            if (form, repeat) != ("n01", 1):
                runs[("m", "t", family, form, repeat)] = random_graph(rng)
    runs[("m", "t", "tone", "p01", 0)] = ({}, [])
    runs[("m", "t", "source", "source", 2)] = ({}, [])
    key = "model string, task_id string, family string, form string, repeat int"
    nodes = spark.createDataFrame(
        [(*k, n, lab) for k, (ns, _) in runs.items() for n, lab in ns.items()], f"{key}, node_id string, label string"
    )
    edges = spark.createDataFrame(
        [(*k, *e) for k, (_, es) in runs.items() for e in es], f"{key}, src string, dst string, relation string"
    )
    table = spark.createDataFrame([k for k in runs], key)
    return runs, nodes, edges, table


def test_pair_scores_equal_text_kernel(sample):
    runs, nodes, edges, table = sample
    vectors = kernel.form_vectors(kernel.wl_features(nodes, edges, KEYS), KEYS[:-1])
    got = {
        (r.form, r.comparison, r.left_repeat, r.right_repeat): r.similarity
        for r in kernel.pair_scores(vectors, table, ["model", "task_id"]).collect()
    }
    bags = {(k[3], k[4]): bag(*g) for k, g in runs.items()}
    want = {}
    for form in ("source", "p01", "n01"):
        mine = sorted(r for f, r in bags if f == form)
        kind = "source_internal" if form == "source" else "variant_internal"
        for i, j in itertools.combinations(mine, 2):
            want[(form, kind, i, j)] = cosine(bags[(form, i)], bags[(form, j)])
        if form != "source":
            for i, j in itertools.product(sorted(r for f, r in bags if f == "source"), mine):
                want[(form, "source_variant", i, j)] = cosine(bags[("source", i)], bags[(form, j)])
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert all(0 <= v <= 1 + 1e-12 for v in got.values())


def test_renaming_nodes_changes_nothing(sample):
    _, nodes, edges, _ = sample
    rename = lambda c: F.concat(F.lit("x"), F.reverse(c))
    a = kernel.wl_features(nodes, edges, KEYS)
    b = kernel.wl_features(
        nodes.withColumn("node_id", rename(F.col("node_id"))),
        edges.withColumn("src", rename(F.col("src"))).withColumn("dst", rename(F.col("dst"))),
        KEYS,
    )
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_order_edges_can_be_left_out(sample):
    _, nodes, edges, _ = sample
    without = kernel.wl_features(nodes, edges, KEYS, include_order=False)
    manual = kernel.wl_features(nodes, edges.filter(F.col("relation") != graphs.PRECEDES), KEYS)
    assert without.exceptAll(manual).count() == 0


def test_signatures_see_labels_and_parallel_edges(spark):
    nodes = spark.createDataFrame([("a", "x", "1"), ("b", "x", "1"), ("c", "x", "2")], "g string, node_id string, label string")
    edges = spark.createDataFrame([("a", "x", "x", "r"), ("b", "x", "x", "r"), ("b", "x", "x", "r")], "g string, src string, dst string, relation string")
    sig = {r.g: r.signature for r in graphs.signatures(nodes, edges, ["g"]).collect()}
    assert len(set(sig.values())) == 3


def test_equal_graphs_share_their_features(spark):
    keys = ["task_id", "repeat"]
    rows = [("t", 0), ("t", 1), ("u", 0), ("u", 1)]
    label = {("u", 1): "op:other"}
    nodes = [(*k, f"op:{i}", label.get(k, f"op:{i % 2}")) for k in rows for i in range(3)]
    edges = [(*k, f"op:{i}", f"op:{i + 1}", "USES") for k in rows for i in range(2)]
    edges.append(("t", 1, "op:0", "op:1", "USES"))  # a parallel edge makes another graph
    n = spark.createDataFrame(nodes, "task_id string, repeat int, node_id string, label string")
    e = spark.createDataFrame(edges, "task_id string, repeat int, src string, dst string, relation string")
    shared, features = kernel.shared_features(n, e, keys)
    content = {(r.task_id, r.repeat): (r.g1, r.g2) for r in shared.collect()}
    assert content["t", 0] == content["u", 0] and len(set(content.values())) == 3
    assert shared.where("stands").count() == 3 and features.select("g1", "g2").distinct().count() == 3
    whole = shared.join(features, ["g1", "g2"]).select(*keys, "iteration", "feature", "n")
    each = kernel.wl_features(n, e, keys).groupBy(*keys, "iteration", "feature").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, each.collect()))


def masked(df, views, name):
    bits = F.array(*[F.struct(F.lit(v).alias(name), F.lit(1 << i).alias("_b")) for i, v in enumerate(views)])
    rows = df.select("*", F.inline(bits)).filter(F.col("views").bitwiseAND(F.col("_b")) != 0)
    return rows.drop("views", "_b")


def sorted_rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()))


def test_views_have_the_labels_they_have_alone(sample):
    """Members of a view are drawn by hash, so edges also lead to nodes outside of their view."""
    _, nodes, edges, _ = sample
    views = ("a", "b", "c")
    n = nodes.withColumn("views", F.pmod(F.xxhash64(*nodes.columns), F.lit(8)))
    e = edges.withColumn("views", F.pmod(F.xxhash64(*edges.columns), F.lit(8)))
    graphs_, features = kernel.view_features(n, e, KEYS, views)
    got = graphs_.join(features, ["g1", "g2"]).select(*KEYS, "view", "iteration", "feature", "n")
    alone = kernel.wl_features(masked(n, views, "view"), masked(e, views, "view"), [*KEYS, "view"])
    want = alone.groupBy(*KEYS, "view", "iteration", "feature").agg(F.count("*").alias("n"))
    assert want.count() > 0 and sorted_rows(got) == sorted_rows(want)


@pytest.mark.parametrize("each", [1, 1 << 9])
def test_lists_of_features_score_as_rows(spark, sample, monkeypatch, each):
    """Lists and tasks in one part or in many; keys that are NULL, and two sources of a task."""
    monkeypatch.setattr(kernel, "LIST_NODES", each)
    monkeypatch.setattr(kernel, "PART_NODES", each)
    _, nodes, edges, table = sample
    lacking = lambda df: df.unionByName(df.withColumn("task_id", F.lit(None).cast("string"))).unionByName(
        df.filter("form = 'p01'").withColumns({"family": F.lit(None).cast("string"), "form": F.lit("x")})
    ).unionByName(df.filter("form = 'n01'").withColumns({"family": F.lit("source"), "form": F.lit("y")}))
    names, task = ("a", "b"), ["model", "task_id"]
    n = lacking(nodes).withColumn("views", F.pmod(F.xxhash64("node_id"), F.lit(4)))
    e = lacking(edges).withColumn("views", F.pmod(F.xxhash64("src", "dst"), F.lit(4)))
    runs = lacking(table)
    found, lists = kernel.packed_features(n, e, KEYS, names)
    got = kernel.packed_pair_scores(found, lists, runs, task, names)
    vectors = kernel.shared_vectors(*kernel.view_features(n, e, KEYS, names), [*task, "view", "family", "form"])
    whole = kernel.pair_scores(vectors, runs.withColumn("view", F.explode(F.array(*map(F.lit, names)))), [*task, "view"])
    want = Counter(tuple(r)[:2] + tuple(r)[3:] + (r.view,) for r in whole.collect())
    rows = got.collect()
    assert got.columns == [*task, "family", "form", "comparison", "left_repeat", "right_repeat", *names]
    assert len(rows) > 50 and Counter(tuple(r)[:7] + (r[v], v) for r in rows for v in names) == want
    assert (lists.agg(F.max("lots")).first()[0] > 1) == (each == 1) and (each == 1 or lists.count() == lists.select("g1", "g2").distinct().count())


def test_projection_views_equal_projections(spark):
    keys = ["g"]
    nodes = [("x", f"op:{i}", f"op:t{i}|outcome:ok") for i in range(5)]
    nodes += [("x", n, n) for n in ("tool:t", "info:f", "perm:p", "alone:z")] + [("y", "op:0", "op:t|outcome:ok")]
    edges = [("x", f"op:{i}", f"op:{i + 1}", graphs.PRECEDES) for i in range(4)]
    edges += [("x", f"op:{i}", "tool:t", "USES") for i in range(5)]
    edges += [("x", "op:0", "perm:p", "REQUESTS:once"), ("x", "op:1", "info:f", "READS"), ("x", "op:1", "info:f", "READS")]
    edges += [("x", "op:2", "info:f", "DISCLOSES_TO"), ("x", "info:f", "perm:p", "ACCESSES"), ("x", "op:3", "alone:z", "OTHER")]
    n = spark.createDataFrame(nodes, "g string, node_id string, label string")
    e = spark.createDataFrame(edges, "g string, src string, dst string, relation string")
    for dims in (graphs.DIMENSIONS, ("information",)):
        vn, ve = graphs.project_views(n, e, keys, dims)
        pn, pe = graphs.project(n, e, keys, dims)
        assert sorted_rows(masked(ve, dims, "dimension")) == sorted_rows(pe)
        assert sorted_rows(masked(vn, dims, "dimension")) == sorted_rows(pn)
    empty = graphs.project_views(n.limit(0), e.limit(0), keys)
    assert empty[0].count() == 0 and empty[1].count() == 0
