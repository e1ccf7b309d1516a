"""Conversation prefix trie from padded matrices of turn ids.

Conversations, in the order of their sequences of turns, are dealt into ranges. In a block of a
range they are the rows of a matrix of turn ids, padded to the longest: sorted by its columns
(lexsort), a row begins a new node at every depth from the first column on which it differs from the
row before it, which is the logical-or of column changes accumulated from the left. Every number
of a node, those of its subtree included, is a sum over its rows of what each adds to the row before
it, so reduceat over those marks gives all nodes of a depth at once. Only nodes that go on beyond
a block, known from the rows on either side of it, are summed again over all blocks.
"""

from __future__ import annotations

from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from agentrace.llm.registry import query, table
from agentrace.session import materialize

#: Conversations whose ids differ only in the rest by this share the beginning of the first of them.
SHARING = 20
#: The number of shared turns is a checksum of the id, modulo this.
HEADS = 4
#: Bytes of a turn's digest, and entries of one padded matrix.
DIGEST, CELLS = 16, 1 << 19
WORD = r"[^\x20\x09-\x0D]+"
NODE = (
    "key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends string, first_end long"
)
NOTHING = sha256(b"").hexdigest()


def turn_rows(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, id, words``: the digest of a turn's role and text and its number of words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("id"),
        F.regexp_count(text, F.lit(WORD)).alias("words"),
    )


def rebuilt(conversations: DataFrame, sharing: int = SHARING, heads: int = HEADS) -> DataFrame:
    """``conv_id, seq, words``: the digests of every rebuilt conversation, joined, and words by turn.

    A conversation begins with the first h turns of the one whose id is its own less the rest by
    ``sharing``, and goes on with its own turns after the first h; h is crc32 of its id modulo
    ``heads``. Turns are in order of their numbers, null first, and of their digests where equal.
    """
    turn = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", "id", "words")
    own = turn_rows(conversations).groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    first = own.where(F.col("conv_id") % sharing == 0).select(
        F.col("conv_id").alias("first"), F.slice("turns", 1, heads - 1).alias("head")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    begin = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h")))
    none = F.filter("turns", lambda t: F.lit(False))
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    joined = (
        own.withColumns({"first": F.col("conv_id") - F.col("conv_id") % sharing, "h": h})
        .join(first, "first", "left")
        .select("conv_id", F.concat(F.coalesce(begin, none), rest).alias("turns"))
    )
    digests = F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), "")
    return joined.select("conv_id", F.unhex(digests).alias("seq"), F.transform("turns", lambda t: t["words"]).alias("words"))


def shards(sequences: DataFrame) -> DataFrame:
    """Rows dealt into ranges of (seq, conv_id), each with its neighbours' rows at its ends.

    Column ``side`` is -1 for the last row of the range before, 1 for the first of the next. Equal
    sequences are dealt by their ids, so no group of copies is a hot range. The ranges are written
    once, so that all later reads see the same ones.
    """
    ranged = sequences.repartitionByRange("seq", "conv_id").withColumn("shard", F.spark_partition_id())
    stored = materialize(ranged, "trie-shards")
    by_shard = Window.orderBy("shard")
    ends = (
        stored.groupBy("shard")
        .agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
        .select("shard", F.lag("high").over(by_shard).alias("before"), F.lead("low").over(by_shard).alias("after"))
    )
    sides = ends.select("shard", F.posexplode(F.array("before", "after")).alias("side", "seq")).where("seq IS NOT NULL")
    context = sides.select(
        "shard",
        (F.col("side") * 2 - 1).alias("side"),
        "seq",
        F.lit(None).cast("long").alias("conv_id"),
        F.array().cast("array<int>").alias("words"),
    )
    return (
        stored.select("shard", F.lit(0).alias("side"), "seq", "conv_id", "words")
        .unionByName(context)
        .repartition("shard")
        .sortWithinPartitions("shard", "side", "seq", "conv_id")
    )


def blocks(batches, cells: int = CELLS):
    """Runs of rows (seq, conv_id, words) of a shard, with the sequences before and after them."""
    shard, before, held, longest = None, None, [], 0
    for batch in batches:
        words = batch.column("words")
        flat, at = words.flatten().to_numpy(), words.offsets.to_numpy() - words.offsets[0].as_py()
        columns = [batch.column(c).to_pylist() for c in ("shard", "side", "seq", "conv_id")]
        for i, (own, side, seq, conv) in enumerate(zip(*columns)):
            if own != shard:
                if held:
                    yield before, held, None
                shard, before, held, longest = own, None, [], 0
            if side < 0:
                before = seq
            elif side > 0:
                if held:
                    yield before, held, seq
                held = []
            else:
                depth = len(seq) // DIGEST + 1
                if held and (len(held) + 3) * max(longest, depth) > cells:
                    yield before, held, seq
                    before, held, longest = held[-1][0], [], 0
                longest = max(longest, depth)
                held.append((seq, conv, flat[at[i] : at[i + 1]]))
    if held:
        yield before, held, None


def prefix_keys(seq: bytes, depth: int) -> list[bytes]:
    """Digests of the first 0, 1, … ``depth`` turns."""
    state, out = blake2b(digest_size=16), []
    for d in range(depth + 1):
        out.append(state.digest())
        state.update(seq[DIGEST * d : DIGEST * (d + 1)])
    return out


def padded(parts: list[np.ndarray], size: np.ndarray, kind) -> np.ndarray:
    """A matrix with a row for each part, filled up with zeros."""
    out = np.zeros((len(parts), max(int(size.max()), 1)), kind)
    out[np.arange(out.shape[1]) < size[:, None]] = np.concatenate(parts) if size.any() else 0
    return out


def block_nodes(before: bytes | None, rows: list, after: bytes | None) -> dict[str, list]:
    """All nodes of a block as columns; those that go on in another block have a key."""
    sides = [before] * (before is not None), [after] * (after is not None)
    seqs = [*sides[0], *[r[0] for r in rows], *sides[1]]
    side = np.repeat([-1, 0, 1], [len(sides[0]), len(rows), len(sides[1])])
    conv = np.array([0] * len(sides[0]) + [r[1] for r in rows] + [0] * len(sides[1]), np.int64)
    size = np.array(list(map(len, seqs))) // DIGEST
    _, ids = np.unique(np.frombuffer(b"".join(seqs), f"S{DIGEST}"), return_inverse=True)
    matrix = padded(np.split(ids + 1, np.cumsum(size)[:-1]), size, np.int32)
    none = np.zeros(0, np.int32)
    words = [none] * len(sides[0]) + [r[2] for r in rows] + [none] * len(sides[1])
    weight = padded(words, np.array(list(map(len, words))), np.int64)
    order = np.lexsort((conv, side, *matrix.T[::-1]))
    matrix, conv, side, size = matrix[order], conv[order], side[order], size[order]
    deep = matrix.shape[1]
    weight = np.pad(weight, ((0, 0), (1, deep - weight.shape[1])))[order].cumsum(axis=1)

    changed = np.ones(matrix.shape, bool)
    changed[1:] = matrix[1:] != matrix[:-1]
    begins = np.logical_or.accumulate(changed, axis=1)
    common = (~begins & (np.arange(deep) < size[:, None])).sum(axis=1)
    leaf = np.append(common[1:] < size[:-1], True)
    low = int(side[0] < 0)
    high = len(side) - int(side[-1] > 0)
    # Nodes of the first row down to reach[0], and of the last down to reach[1], go on elsewhere.
    reach = (int(common[low]) if low else -1, int(common[high]) if high < len(side) else -1)
    keys = [prefix_keys(seqs[order[at]], max(r, 0)) for at, r in zip((low, high - 1), reach)]

    out: dict[str, list] = {name.split()[0]: [] for name in NODE.split(", ")}
    mine = np.arange(low, high)
    above = None  # names, keys and, by row, numbers of the nodes one turn up
    for d in range(deep + 1):
        mine = mine[size[mine] >= d]
        if not len(mine):
            break
        marks = begins[mine, d - 1].copy() if d else np.zeros(len(mine), bool)
        marks[0] = True
        start = np.flatnonzero(marks)
        number = np.cumsum(marks) - 1
        names = np.minimum.reduceat(conv[mine], start)
        child = (size[mine] > d) & begins[mine, min(d, deep - 1)]
        # The first row of a part is no child's first row if the row before the block has it too.
        saved = np.where(common[mine] >= d, weight[mine, common[mine]] - weight[mine, max(d - 1, 0)], 0)
        key: list = [None] * len(start)
        if d <= reach[0]:
            key[0] = keys[0][d]
        if d <= reach[1]:
            key[-1] = keys[1][d]
        own = size[mine] == d
        ended = np.add.reduceat(own.astype(np.int64), start)
        texts = [""] * len(start)
        firsts: list = [None] * len(start)
        for node in np.flatnonzero(ended):
            # Shorter rows come first, so the rows that end at a node are the first of its rows.
            at = mine[start[node] : start[node] + ended[node]]
            texts[node] = ",".join(map(str, conv[at].tolist()))
            firsts[node] = int(conv[at[0]])
        if above is None:
            out["parent_key"] += [None] * len(start)
            out["parent_conv_id"] += [None] * len(start)
        else:
            up = above[2][mine[start]].tolist()
            out["parent_key"] += [above[1][i] for i in up]
            out["parent_conv_id"] += [None if above[1][i] else above[0][i] for i in up]
        out["key"] += key
        out["conv_id"] += names.tolist()
        out["depth"] += [d] * len(start)
        out["n_convs"] += np.diff(start, append=len(mine)).tolist()
        out["n_children"] += np.add.reduceat(child.astype(np.int64), start).tolist()
        out["n_leaves"] += np.add.reduceat(leaf[mine].astype(np.int64), start).tolist()
        out["saved_tokens"] += np.add.reduceat(saved, start).tolist()
        out["ends_sha256"] += [None if k else sha256(t.encode()).hexdigest() for k, t in zip(key, texts)]
        out["ends"] += [t if k else None for k, t in zip(key, texts)]
        out["first_end"] += firsts
        rank = np.zeros(len(side), np.int64)
        rank[mine] = number
        above = (names.tolist(), key, rank)
    return out


def ends_digests(spanning: DataFrame) -> DataFrame:
    """``key, ends_sha256`` of the ids that end at a node, which come in pieces of many blocks.

    A digest is computed in order, so the pieces of a node stream through one task, one at a time.
    """
    arrow = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])

    def digest(batches):
        key, state = None, None
        for batch in batches:
            for own, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
                if own != key:
                    if state:
                        yield pa.RecordBatch.from_pylist([{"key": key, "ends_sha256": state.hexdigest()}], arrow)
                    key, state = own, sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
        if state:
            yield pa.RecordBatch.from_pylist([{"key": key, "ends_sha256": state.hexdigest()}], arrow)

    pieces = spanning.where("first_end IS NOT NULL").select("key", "first_end", "ends")
    ordered = pieces.repartition("key").sortWithinPartitions("key", "first_end")
    return ordered.mapInArrow(digest, "key binary, ends_sha256 string")


def trie(sequences: DataFrame, cells: int = CELLS) -> DataFrame:
    """The nodes of the trie of ``conv_id, seq, words`` (one row a conversation); see prefix_trie."""
    schema = _parse_datatype_string(NODE)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for before, rows, after in blocks(batches, cells):
            columns = block_nodes(before, rows, after)
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    nodes = materialize(shards(sequences).mapInArrow(run, schema), "trie-nodes")
    spanning = nodes.where("key IS NOT NULL")
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    whole = (
        spanning.groupBy("key")
        .agg(
            F.first("parent_key").alias("parent_key"),
            F.min("conv_id").alias("conv_id"),
            F.first("depth").alias("depth"),
            *[F.sum(c).alias(c) for c in sums],
        )
        .join(ends_digests(spanning), "key", "left")
        .fillna({"ends_sha256": NOTHING})
    )
    whole = materialize(whole, "trie-spanning")
    names = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    columns = ("conv_id", "depth", "parent_conv_id", *sums, "ends_sha256")
    inside = nodes.where("key IS NULL")
    below = inside.where("parent_key IS NOT NULL").drop("parent_conv_id").join(names, "parent_key")
    rest = whole.join(names, "parent_key", "left")
    return (
        inside.where("parent_key IS NULL")
        .select(*columns)
        .unionByName(below.withColumnRenamed("_parent", "parent_conv_id").select(*columns))
        .unionByName(rest.withColumnRenamed("_parent", "parent_conv_id").select(*columns))
    )


def prefix_trie(conversations: DataFrame, sharing: int = SHARING, heads: int = HEADS) -> DataFrame:
    """One row per distinct beginning of rebuilt conversations, from the textless root on.

    ``conv_id`` is the smallest conversation that begins so, ``depth`` the number of turns;
    ``n_convs`` counts conversations, ``n_children`` and ``n_leaves`` nodes below, ``saved_tokens``
    the words of turns that the conversations of the subtree need not hold again, ``ends_sha256``
    digests the ids that end here. Rows without conv_id belong to no conversation; null roles and
    texts are empty; turns of equal number come in the order of their digests, repeated rows are
    turns of their own; an empty table gives no rows.

    Texts are digested where they are read, so only digests and counts are shuffled. A conversation
    is one row of 24 bytes a turn; everything else is bounded by blocks.
    """
    return trie(rebuilt(conversations, sharing, heads))


TRIE_SQL = rf"""
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, coalesce(text, '') AS text,
    md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS id
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (
  SELECT conv_id, id, len(regexp_extract_all(text, '{WORD}')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS pos FROM turns),
checksum AS (
  SELECT DISTINCT conv_id, conv_id::VARCHAR AS s, 0 AS k, 4294967295::BIGINT AS c FROM placed
  UNION ALL
  SELECT conv_id, s, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END
  FROM (SELECT *, CASE WHEN k % 8 = 0 THEN xor(c, ord(substr(s, k // 8 + 1, 1))::BIGINT) ELSE c END AS x
        FROM checksum WHERE k < 8 * length(s))),
heads AS (SELECT conv_id, xor(c, 4294967295) % {HEADS} AS h FROM checksum WHERE k = 8 * length(s)),
parts AS (
  SELECT c.conv_id, 0 AS part, pos, id, words
  FROM heads c JOIN placed p ON p.conv_id = c.conv_id - c.conv_id % {SHARING} AND pos <= h
  UNION ALL SELECT conv_id, 1, pos, id, words FROM placed JOIN heads USING (conv_id) WHERE pos > h),
path AS (
  SELECT conv_id, row_number() OVER w AS d, string_agg(id, '') OVER w AS path, words
  FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
member AS (SELECT conv_id, 0 AS d, '' AS path, 0 AS words FROM heads UNION ALL SELECT * FROM path),
longest AS (SELECT conv_id, max(d) AS size FROM member GROUP BY conv_id),
node AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    string_agg(CASE WHEN size = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS ends
  FROM member JOIN longest USING (conv_id) GROUP BY path, d),
child AS (SELECT left(path, 32 * (d - 1)) AS path, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
below AS (
  SELECT left(path, 32 * k) AS path, sum((n_convs - 1) * words) AS saved, count(*) FILTER (leaf) AS leaves
  FROM (SELECT node.*, n IS NULL AS leaf, unnest(range(0, d + 1)) AS k FROM node LEFT JOIN child USING (path))
  GROUP BY 1)
SELECT a.conv_id, a.d::BIGINT AS depth, p.conv_id AS parent_conv_id, a.n_convs, coalesce(n, 0) AS n_children,
  leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(a.ends, '')) AS ends_sha256
FROM node a JOIN below USING (path) LEFT JOIN child USING (path)
LEFT JOIN node p ON a.d > 0 AND p.path = left(a.path, 32 * (a.d - 1))
"""


@query("op12_prefix_trie", TRIE_SQL)
def op12_prefix_trie(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))
