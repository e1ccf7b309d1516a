"""The prefix trie against a plain dictionary of beginnings."""

import random
import zlib
from collections import defaultdict
from hashlib import md5, sha256

import pytest
from helpers import words

from agentrace.llm import trie

SCHEMA = "conv_id long, turn int, role string, text string, seq string, depth int, side string"


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [t[3:] for t in sorted(found)] for c, found in own.items()}
    nodes = defaultdict(list)
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (c % 20 if c >= 0 else -(-c % 20))
        path = tuple(turns.get(first, [])[:h] + mine[h:])
        for d in range(len(path) + 1):
            nodes[path[:d]].append((c, len(path) == d))
    out = {}
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        ends = ",".join(str(c) for c, last in sorted(members) if last)
        name = min(c for c, _ in members)
        parent = min(c for c, _ in nodes[path[:-1]]) if path else None
        saved = sum((len(nodes[p]) - 1) * len(words(p[-1][1])) for p in below if p)
        out[(name, len(path))] = (parent, len(members), len(children), len(leaves), saved, sha256(ends.encode()).hexdigest())
    return out


def got(nodes):
    rows = nodes.collect()
    found = {
        (r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
        for r in rows
    }
    assert len(found) == len(rows)
    return found


def conversations(seed, n, choices, longest):
    """Few different turns, so that beginnings are shared; ties, nulls and repeated rows among them."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-50, 5 * n), n):
        for t in range(rng.randrange(1, longest)):
            text = " ".join(["a b"] * rng.randrange(choices))
            rows.append((c, t // 2 if c % 7 == 0 else t, rng.choice(["user", "user", "assistant"]), text))
    rows += [(3, None, None, None), (3, None, "user", ""), (None, 1, "user", "nobody"), (4, 1, None, "x"), rows[0], rows[-1]]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, "x") for r in rows], SCHEMA)


@pytest.mark.parametrize("cells", [1, 30, 1 << 19])
@pytest.mark.parametrize("shards", [1, 9])
def test_trie_is_that_of_a_dictionary(spark, cells, shards):
    rows = conversations(cells + shards, 120, 2, 7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(trie.trie(trie.rebuilt(frame(spark, rows)), cells)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_group_of_copies_over_many_blocks(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 300, 20) for t in range(3)]
    rows += [(c, 0, "user", "other") for c in range(1, 40)] + [(1000, t, "user", "w " * t) for t in range(400)]
    assert got(trie.trie(trie.rebuilt(frame(spark, rows)), 8)) == plain(rows)


def test_empty_conversations(spark):
    assert trie.prefix_trie(frame(spark, [(1, 1, "u", "t")]).limit(0)).count() == 0
    # Own turns end before the shared ones begin, and the first conversation isn't there.
    alone = [c for c in range(21, 60) if zlib.crc32(str(c).encode()) % 4 == 3][:2]
    rows = [(c, 0, "user", "hi there") for c in alone]
    assert got(trie.prefix_trie(frame(spark, rows))) == plain(rows)
    assert trie.prefix_trie(frame(spark, rows)).count() == 1
