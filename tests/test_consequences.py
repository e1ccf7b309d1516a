"""Closed forms against pair enumeration, phrases across payloads, statistics."""

import hashlib
import itertools
import random
import re
import statistics

import pyarrow as pa
from pyspark.sql import functions as F

from agentrace.operators import consequences as C
from agentrace.operators import resampling, stats


def test_disagreement_equals_enumeration(spark):
    rng = random.Random(5)
    rows = []
    for task in ("t0", "t1", "t2"):
        for family, form in (("source", "source"), ("tone", "p01"), ("tone", "n01")):
            n = 1 if (task, form) == ("t2", "source") else rng.randrange(2, 7)
            rows += [("m", task, family, form, r, rng.choice("xyz")) for r in range(n)]
    df = spark.createDataFrame(rows, "model string, task_id string, family string, form string, repeat int, o string")
    got = {(r.task_id, r.form): r for r in C.disagreement(df, ["model", "task_id"], "o").collect()}
    assert not any(t == "t2" for t, _ in got)
    for (task, form), r in got.items():
        s = [x[5] for x in rows if x[1] == task and x[2] == "source"]
        v = [x[5] for x in rows if x[1] == task and x[3] == form]
        ss = statistics.fmean(int(a != b) for a, b in itertools.combinations(s, 2))
        sv = statistics.fmean(int(a != b) for a in s for b in v)
        assert abs(r.within_source - ss) < 1e-12 and abs(r.source_variant - sv) < 1e-12


def test_metric_changes_equal_enumeration(spark):
    rng = random.Random(6)
    rows = []
    for task in range(6):
        for family, form in (("source", "source"), ("tone", "p01")):
            rows += [("permission", "m", f"t{task}", "over", family, form, r, int(rng.random() < task / 5)) for r in range(3)]
    df = spark.createDataFrame(rows, "dataset string, model string, task_id string, metric string, family string, form string, repeat int, flag int")
    for r in C.metric_changes(df).collect():
        s = [x[7] for x in rows if x[2] == r.task_id and x[4] == "source"]
        v = [x[7] for x in rows if x[2] == r.task_id and x[4] != "source"]
        flip = statistics.fmean(int(a != b) for a in s for b in v) - statistics.fmean(
            int(a != b) for a, b in itertools.combinations(s, 2)
        )
        assert abs(r.flip_delta - flip) < 1e-12
        assert r.induced == (None if any(s) else statistics.fmean(v))
        assert (r.resolved is None) == (not all(s))
        assert r.any_induced == int(not any(s) and any(v))


def test_phrases_may_span_payloads(spark):
    texts = spark.createDataFrame(
        [("t", 0, "Send  to"), ("t", 1, " "), ("t", 2, "Ann"), ("t", 3, "Lee now"), ("t", 9, "item 55")],
        "task_id string, event_id long, payload string",
    )
    items = ["to ann lee", "Ann Lee", "item 5", "lee now item 55", "nn", "send to"]
    ann = spark.createDataFrame([("t", items)], "task_id string, items array<string>")
    for parts in (1, 3, 100):
        got = {r.item for r in C.phrase_hits(texts, ann, "items", ["task_id"], "payload", parts=parts).collect()}
        assert got == {"to ann lee", "Ann Lee", "lee now item 55", "send to"}


def test_phrases_end_where_long_payloads_are_cut(spark):
    payloads = ["hi", "call up annexe now and then some more words", "or lee will do", "x", "İİİİİİ to ann", "lee"]
    texts = spark.createDataFrame(
        [("t", i, p) for i, p in enumerate(payloads)], "task_id string, event_id long, payload string"
    )
    # 'to ann lee' is the longest: heads end after 'call up ann', before 'exe'.
    found = ["to ann lee", "hi call up", "or lee will", "more words"]
    missing = ["ann or", "up ann", "call up ann", "ann o", "up ann or"]
    for parts in (1, 3, 100):
        for items in (["ann call", "to ann lee", *missing[:2]], found + missing):
            ann = spark.createDataFrame([("t", items)], "task_id string, items array<string>")
            got = {r.item for r in C.phrase_hits(texts, ann, "items", ["task_id"], "payload", parts=parts).collect()}
            assert got == set(items) & set(found)
    # Lower case is longer than the item as given.
    ann = spark.createDataFrame([("t", ["x İİİİİİ"])], "task_id string, items array<string>")
    assert C.phrase_hits(texts, ann, "items", ["task_id"], "payload").count() == 1


def test_phrase_index_equals_patterns(spark):
    """Random texts and items of words and marks, against a pattern over the joined texts of a run."""
    rng = random.Random(11)
    words = ["a", "b", "ab", "A", "5", "é", "_x"]
    marks = [" ", "  ", ".", "-", "+", ". ", " .", "\t", "\u0301"]
    piece = lambda n: "".join(rng.choice(words) + rng.choice(marks) if rng.random() < 0.8 else rng.choice(marks) for _ in range(n))
    rows, notes = [], []
    for task in range(4):
        notes.append((f"t{task}", [piece(rng.randrange(1, 5)) for _ in range(60)] + ["", " ", ".", "a", "absent word"]))
        for run in range(3):
            rows += [(f"t{task}", run, at * 7, piece(rng.randrange(0, 9))) for at in range(rng.randrange(1, 8))]
    rows.append(("t0", 0, 10**6, None))
    texts = spark.createDataFrame(rows, "task_id string, repeat int, event_id long, payload string")
    notes.append(("no texts", ["a"]))
    ann = spark.createDataFrame([*notes, ("no items", []), ("null items", None)], "task_id string, items array<string>")
    squash = lambda t: re.sub(r"\s+", " ", t).strip().lower()
    want = set()
    for task, items in notes:
        for run in range(3):
            mine = sorted((e, p) for t, r, e, p in rows if t == task and r == run and p)
            whole = " ".join(t for t in (squash(p) for _, p in mine) if t)
            for item in items:
                plain = re.escape(squash(item))
                if plain and re.search(rf"(?<!\w){plain}(?!\w)", whole):
                    want.add((task, run, item))
    assert len(want) > 100
    for parts in (1, 7):
        got = C.phrase_hits(texts, ann, "items", ["task_id", "repeat"], "payload", parts=parts).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == want
    assert C.phrase_hits(texts.filter("false"), ann, "items", ["task_id", "repeat"], "payload").count() == 0
    assert C.phrase_hits(texts, ann.filter("false"), "items", ["task_id", "repeat"], "payload").count() == 0


def test_permission_indicators_without_requests(spark):
    keys = ["task_id", "repeat"]
    runs = spark.createDataFrame([("t", 0, "ok"), ("t", 1, "ok")], "task_id string, repeat int, status string")
    log = spark.createDataFrame(
        [("t", 1, "permission_request", " F0 ", "persistent"), ("t", 1, "permission_request", "f9", None)],
        "task_id string, repeat int, type string, field string, scope string",
    )
    ann = spark.createDataFrame([("t", ["f0"], ["f4"])], "task_id string, needed array<string>, unneeded array<string>")
    got = {r.repeat: r for r in C.permission_indicators(log, runs, ann, keys).collect()}
    assert (got[0].under_permission, got[0].inexact_permission_set, got[0].n_requests) == (1, 1, 0)
    assert (got[1].under_permission, got[1].over_permission) == (0, 0)
    assert (got[1].persistent_scope, got[1].inexact_permission_set) == (1, 1)


def test_set_difference_of_empty_sets(spark):
    df = spark.createDataFrame([([], []), (["a"], ["a", "b"])], "l array<string>, r array<string>")
    rows = df.select(C.set_difference(F.col("l"), F.col("r")).alias("d")).collect()
    assert rows[0].d.jaccard == 1.0 and rows[0].d.equal
    assert rows[1].d.added == ["b"] and rows[1].d.jaccard == 0.5


def test_bootstrap_uses_every_unit_and_is_repeatable(spark):
    rows = [("g", f"u{i}", float(i)) for i in range(40)] + [("one", "u", 7.0)]
    df = spark.createDataFrame(rows, "g string, u string, v double")
    a = {r.g: r for r in stats.bootstrap_ci_percentile(df, ["g"], "u", "v", 500).collect()}
    b = {r.g: r for r in stats.bootstrap_ci_percentile(df.repartition(7), ["g"], "u", "v", 500).collect()}
    assert a["one"].ci_low == a["one"].ci_high == 7.0
    assert abs(a["g"].ci_low - b["g"].ci_low) < 1e-9
    spread = a["g"].ci_high - a["g"].ci_low
    theory = 2 * 1.96 * statistics.pstdev(range(40)) / 40**0.5
    assert 0.75 * theory < spread < 1.25 * theory
    order = {r.g: r for r in stats.bootstrap_ci_order_stat(df, ["g"], "u", "v", 200).collect()}
    assert order["one"].ci_low is None and order["g"].n_units == 40


def test_quantiles_and_ranks(spark):
    rng = random.Random(8)
    values = [rng.choice([0.0, 0.25, 0.5, 1.0, rng.random()]) for _ in range(101)]
    df = spark.createDataFrame([("g", v, 1 - v if i % 3 else v) for i, v in enumerate(values)], "g string, x double, y double")
    q = stats.exact_quantiles(df, ["g"], "x", {"a": 0.25, "b": 0.5, "c": 0.9}).first()
    want = df.selectExpr("percentile(x, array(0.25, 0.5, 0.9)) AS p").first().p
    assert all(abs(p - w) < 1e-12 for p, w in zip((q.a, q.b, q.c), want, strict=True))
    rho = stats.spearman(df, ["g"], "x", "y").first().rho
    rank = lambda xs: [sum(o < x for o in xs) + (sum(o == x for o in xs) + 1) / 2 for x in xs]
    ys = [1 - v if i % 3 else v for i, v in enumerate(values)]
    assert abs(rho - statistics.correlation(rank(values), rank(ys))) < 1e-9


def drawn(start, replicate, draw, n):
    p = stats.PRIME
    y0 = (replicate * 2654435 + start) % p
    y1 = (y0 * y0 + 12345) % p
    y2 = (y1 * 48271 + replicate) % p
    x0 = (y2 + draw * 40503) % p
    x1 = (x0 * x0 + y1) % p
    x2 = (x1 * 48271 + x0) % p
    return ((x2 * x2 + y0) % p) % n


def test_bootstrap_over_several_slices(spark):
    units = {"g": [float(i * i) for i in range(23)], "h": [1.0, None, 5.0], "none": [None]}
    rows = [(g, f"u{i}", v) for g, vs in units.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "g string, u string, v double")
    size, replicates = 5, 600
    got = {
        (r.g, r.replicate): r.estimate
        for r in stats.bootstrap_means(df.repartition(3), ["g"], "u", "v", replicates, slice_size=size).collect()
    }
    assert len(got) == len(units) * replicates
    md5 = lambda text: hashlib.md5(text.encode()).hexdigest()
    for g, vs in units.items():
        order = sorted(range(len(vs)), key=lambda i: (md5(f"u{i}")[:2], f"u{i}"))
        placed, start, n = [vs[i] for i in order], int(md5(g)[:7], 16), len(vs)
        for b in range(replicates):
            parts = [drawn(start + stats.OUTER, b, i, n) // size if n > size else 0 for i in range(n)]
            sample = []
            for s in set(parts):
                values = placed[s * size : (s + 1) * size]
                sample += [values[drawn(start + s * stats.INNER, b, t, len(values))] for t in range(parts.count(s))]
            present = [v for v in sample if v is not None]
            want = statistics.fmean(present) if present else None
            assert got[g, b] == want or abs(got[g, b] - want) < 1e-9
    empty = df.filter("false")
    assert stats.bootstrap_means(empty, ["g"], "u", "v", 10).count() == 0


def test_draws_of_many_slices_travel_as_one_row_a_replicate_and_chunk(spark, monkeypatch):
    monkeypatch.setattr(resampling, "UNITS_A_CHUNK", 12)
    values = [float(i) if i % 7 else None for i in range(100)]
    rows = [("g", f"u{i}", v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, u string, v double")
    size, replicates = 2, 70
    slot = {"_k1": 1, "_k2": 2, "_start": 5, "_n": 100, "_first": 0, "_last": 69}
    batches = list(resampling.count_draws(size, 0)([pa.RecordBatch.from_pylist([slot])]))
    assert sum(b.num_rows for b in batches) == replicates * 9  # 50 slices, six a chunk
    for b in (0, 69):
        counts = [0] * 50
        for i in range(100):
            counts[drawn(5 + stats.OUTER, b, i, 100) // size] += 1
        assert counts == [c for batch in batches for c in batch.column("_counts")[b].as_py()]
    got = {r.replicate: r.estimate for r in stats.bootstrap_means(df, ["g"], "u", "v", replicates, slice_size=size).collect()}
    monkeypatch.setattr(resampling, "UNITS_A_CHUNK", 1 << 16)
    whole = {r.replicate: r.estimate for r in stats.bootstrap_means(df, ["g"], "u", "v", replicates, slice_size=size).collect()}
    assert len(got) == replicates and all(abs(got[b] - whole[b]) < 1e-9 for b in got)
