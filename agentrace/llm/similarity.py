"""N-gram Jaccard join by an R-tree over count vectors.

A document's distinct shingles are hashed into groups; the counts by group are a point. No two sets
can share more shingles than the sum of the smaller count of each group, so a node of a tree, or a
pair of nodes, whose summed minima (or largest counts) fall short of the needed overlap is skipped.
Points are first put in slabs: a set that shares nine tenths with another one has a shingle in
common with it among its first few in any fixed order, here the one of how common a shingle's words
are. Every slab has a tree of its own, and what survives there is verified on the whole sets.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentrace.llm.batches import fields, map_slices, slices
from agentrace.llm.components import components
from agentrace.llm.packing import ROW, packed_texts, row_keys, rows_of, unpacked
from agentrace.llm.registry import query, table
from agentrace.llm.wordhash import U64, Words, mixed, spaces_between
from agentrace.session import materialize

WIDTH, PERCENT = 3, 90
#: Least and most groups of a point, and groups in which words are counted (bits).
LEAST_CELLS, MOST_CELLS, ORDER_BITS = 32, 256, 16
LEAF = 16
#: Points of one tree; sets, and shingles of them, that one task verifies against as many others.
TREE_ROWS, BLOCK, BLOCK_SHINGLES = 1 << 15, 1024, 1 << 19
COLUMNS = 4096
#: Shingles, of sets in large components, that one task looks for twins of.
BUCKET_SHINGLES = 1 << 21


def shingle_sets(
    texts: pa.Array, width: int, weight: np.ndarray | None = None
) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sorted distinct shingle hashes of every text; a shorter text's words are one shingle.

    With ``weight`` by word group, also the summed weights of the words of every shingle.
    """
    words = Words(texts, spaces_between())
    h = words.hashes()
    count = max(len(h) - width + 1, 0)
    rolled, load = np.zeros(count, U64), np.zeros(count, np.int64)
    for i in range(width if count else 0):
        rolled = mixed(rolled * U64(0x9FB21C651E98DF25) + h[i : i + count] + U64(i + 1))
        if weight is not None:
            load += weight[word_group(h[i : i + count])]
    out, loads = [], []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= width:
            stop = b - width + 1
            if weight is None:
                out.append(np.unique(rolled[a:stop]))
            else:
                found, at = np.unique(rolled[a:stop], return_index=True)
                out.append(found)
                loads.append(load[a:stop][at])
            continue
        few = np.array([b - a] if b > a else [], U64)
        for i in range(a, b):
            few = mixed(few * U64(3) + h[i : i + 1])
        out.append(few)
        loads.append(np.zeros(len(few), np.int64))
    return out, loads


def word_group(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - ORDER_BITS)).astype(np.int64)


def least_overlap(total, percent: int):
    """Shingles that two sets of ``total`` members together must share."""
    return -(-percent * total // (100 + percent))


def digest(shingles: np.ndarray) -> bytes:
    return blake2b(shingles.tobytes(), digest_size=16).digest()


def word_weights(source: DataFrame) -> np.ndarray:
    """How common the words of each group are, as a logarithm, over all documents.

    A shingle of common words is likely to stand in many texts, one with a rare word in few. One
    small row per group reaches the driver.
    """

    def count(batches):
        total = np.zeros(1 << ORDER_BITS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                h = Words(part.column("text"), spaces_between()).hashes()
                total += np.bincount(word_group(h), minlength=len(total))
        name = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(total[name])], ["name", "n"])

    counted = source.select("text").mapInArrow(count, "name long, n long")
    rows = counted.groupBy("name").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << ORDER_BITS, np.int64)
    n = rows.column("n").to_numpy()
    out[rows.column("name").to_numpy()] = np.round(1000 * np.log(n)) if len(n) else 0
    return out


def cells_of(size: np.ndarray) -> np.ndarray:
    """Groups of a set's point: a power of two, about one for every sixteen shingles."""
    wanted = np.exp2(np.ceil(np.log2(np.maximum(size, 1) / 16))).astype(np.int64)
    return np.clip(wanted, LEAST_CELLS, MOST_CELLS)


def points(source: DataFrame, width: int, percent: int) -> DataFrame:
    """Per document its set's size, digest, point and first shingles: what candidates need."""
    weight = word_weights(source).astype(np.int32)
    schema = fields(source, *ROW, "doc_id", n="bigint", set="binary", point="binary", first="array<bigint>")

    def describe(batch):
        sets, loads = shingle_sets(batch.column("text"), width, weight)
        size = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        cells = cells_of(size)
        ends = np.cumsum(cells)
        cell = np.repeat(ends - cells, size)
        cell += (mixed(flat) & np.repeat(cells - 1, size).astype(U64)).astype(np.int64)
        point = np.split(np.bincount(cell, minlength=ends[-1]).astype("<u4"), ends[:-1])
        first = []
        for s, load in zip(sets, loads):
            # A linked set shares percent of this one at least, so one of these few is common.
            few = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
            order = np.argsort(load, kind="stable")[:few]
            first.append(s[order].view(np.int64))
        ends = np.concatenate(([0], np.cumsum([len(f) for f in first]))).astype(np.int32)
        return {
            **{name: batch.column(name) for name in (*ROW, "doc_id")},
            "n": size,
            "set": [digest(s) for s in sets],
            "point": [p.astype(np.min_scalar_type(p.max())).tobytes() for p in point],
            "first": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(first))),
        }

    return map_slices(source, describe, schema, "text")


def read_points(raw: list[tuple[bytes, int]], cells: int) -> np.ndarray:
    """Points, given with the number of their groups, all folded to ``cells`` groups."""
    out = np.empty((len(raw), cells), np.int64)
    for i, (p, own) in enumerate(raw):
        out[i] = np.frombuffer(p, f"<u{len(p) // own}").reshape(-1, cells).sum(axis=0)
    return out


class Union:
    """Disjoint sets over 0..n-1."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        """Every member that isn't the first of its set, with the first."""
        return [(i, r) for i in range(len(self.parent)) if (r := self.find(i)) != i]


class Box:
    """A node: the rows below it and the bounds of their points and sizes."""

    def __init__(self, rows: np.ndarray, tree: Tree):
        here = tree.points[rows]
        self.low, self.high = here.min(axis=0), here.max(axis=0)
        self.least, self.most = int(tree.size[rows].min()), int(tree.size[rows].max())
        self.one = False
        self.rows, self.parts = rows, ()
        if len(rows) > LEAF:
            wide = int((self.high - self.low).argmax())
            order = rows[np.argsort(here[:, wide], kind="stable")]
            half = len(order) // 2
            self.parts = (Box(order[:half], tree), Box(order[half:], tree))

    def joined(self, union: Union) -> bool:
        """Whether all rows are in one set already; once true, it stays so."""
        if not self.one:
            if self.parts:
                a, b = self.parts
                self.one = (
                    a.joined(union)
                    and b.joined(union)
                    and union.find(int(a.rows[0])) == union.find(int(b.rows[0]))
                )
            else:
                self.one = len({union.find(int(r)) for r in self.rows}) == 1
        return self.one


class Tree:
    """An R-tree over count vectors, joined with itself; survivors are put together in a Union."""

    def __init__(self, points: np.ndarray, size: np.ndarray, percent: int):
        self.points, self.size, self.percent = points, size, percent
        self.union = Union(len(points))

    def pairs(self) -> Union:
        root = Box(np.arange(len(self.points)), self)
        self.within(root)
        return self.union

    def within(self, box: Box) -> None:
        if box.joined(self.union):
            return
        if box.parts:
            self.within(box.parts[0])
            self.within(box.parts[1])
            self.across(*box.parts)
        else:
            self.compare(box.rows, box.rows)

    def across(self, a: Box, b: Box) -> None:
        if min(a.most, b.most) * 100 < self.percent * max(a.least, b.least):
            return
        if np.minimum(a.high, b.high).sum() < least_overlap(a.least + b.least, self.percent):
            return
        if a.joined(self.union) and b.joined(self.union):
            if self.union.find(int(a.rows[0])) == self.union.find(int(b.rows[0])):
                return
        if not a.parts and not b.parts:
            self.compare(a.rows, b.rows)
            return
        if a.parts and (not b.parts or len(a.rows) >= len(b.rows)):
            for part in a.parts:
                self.across(part, b)
        else:
            for part in b.parts:
                self.across(a, part)

    def compare(self, a: np.ndarray, b: np.ndarray) -> None:
        shared = np.minimum(self.points[a][:, None], self.points[b][None]).sum(axis=2)
        need = least_overlap(self.size[a][:, None] + self.size[b][None], self.percent)
        for i, j in zip(*np.nonzero(shared >= need)):
            if a[i] != b[j]:
                self.union.join(int(a[i]), int(b[j]))


def shared_slabs(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (slab, n, head) that have a neighbour of similar size in their slab.

    In a slab sorted by size, sets whose sizes differ too much to link stand apart, and so do all
    between them and others; most rows are alone and leave here.
    """

    def keep(batches):
        held, close = None, False  # the last row, and whether it is close to the one before it
        for batch in batches:
            held = pa.concat_tables([held, pa.table(batch)]) if held else pa.table(batch)
            slab, n = held.column("slab").to_numpy(), held.column("n").to_numpy()
            if len(slab) < 2:
                continue
            near = (slab[1:] == slab[:-1]) & (100 * n[:-1] >= percent * n[1:])
            kept = np.concatenate(([close], near))[:-1] | near
            yield from held.slice(0, len(slab) - 1).filter(pa.array(kept)).to_batches()
            held, close = held.slice(len(slab) - 1), bool(near[-1])
        if held and close:
            yield from held.to_batches()

    ordered = rows.repartition("slab").sortWithinPartitions("slab", "n")
    return ordered.mapInArrow(keep, rows.schema).select("slab", "head")


def candidates(described: DataFrame, percent: int) -> DataFrame:
    """Edges ``a, b`` between sets: any two that may be linked are connected by a path of them.

    First only slabs, sizes and hashes of the sets' digests are shuffled, and what is alone of its size
    in its slab leaves; the others then meet their points. Rows of a slab come sorted; a tree takes up to
    TREE_ROWS of them. The rows of a longer slab are all connected without a bound, which only
    leaves more to verify, in blocks.
    """
    sets = (
        described.where("n > 0")
        .groupBy("set")
        .agg(F.first(F.struct("n", "point", "first")).alias("s"))
        .select(F.xxhash64("set").alias("head"), "set", "s.n", "s.point", "s.first")
    )
    small = sets.select(F.explode("first").alias("slab"), "n", "head")
    rows = (
        shared_slabs(small, percent)
        .join(sets.select("head", "set", "n", "point"), "head")
        .select("slab", "n", "set", "point")
        .repartition("slab")
        .sortWithinPartitions("slab", "n", "set")
    )
    schema = fields(rows, a="binary", b="binary")
    arrow = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def runs(batches):
        """Whole slabs, and whether the last one goes on in the next part (only if it is long)."""
        held = None
        for batch in batches:
            held = pa.concat_tables([held, pa.table(batch)]) if held else pa.table(batch)
            slab = held.column("slab").to_numpy()
            if not len(slab):
                continue
            whole = int((slab == slab[-1]).argmax())
            if long := len(slab) - whole > TREE_ROWS:
                whole = len(slab) - 1
            if whole:
                yield held.slice(0, whole), long
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield held, False

    def join(batches):
        before, last = False, None
        for part, goes_on in runs(batches):
            slab = part.column("slab").to_numpy()
            size = part.column("n").to_numpy()
            names = part.column("set").to_pylist()
            cells = cells_of(size)
            raw = list(zip(part.column("point").to_pylist(), cells.tolist()))
            start = np.concatenate(([0], np.flatnonzero(slab[1:] != slab[:-1]) + 1, [len(slab)]))
            length = np.diff(start)
            found: set = set()
            if before:  # the first slab began in the part before
                found.add((last, names[0]))
            long = (length > TREE_ROWS) | np.append(np.zeros(len(length) - 1, bool), goes_on)
            long[0] |= before
            before, last = goes_on, names[-1]
            # Slabs of two, by far the most, are compared all at once.
            two = start[:-1][(length == 2) & ~long]
            two = two[size[two] * 100 >= percent * size[two + 1]]
            for n in np.unique(cells[two]):
                at = two[cells[two] == n]
                for at in np.array_split(at, -(-len(at) // 4096)):
                    a, b = (read_points([raw[i] for i in at + k], n) for k in (0, 1))
                    need = least_overlap(size[at] + size[at + 1], percent)
                    for i in at[np.minimum(a, b).sum(axis=1) >= need]:
                        found.add((names[i], names[i + 1]))
            for at, n, whole in zip(start[:-1], length, long):
                if whole:
                    found |= {(names[at], names[i]) for i in range(at + 1, at + n)}
                elif n > 2:
                    for few in np.unique(cells[at : at + n]):
                        # Larger sets that may link with these are compared in as many groups.
                        own = at + np.flatnonzero(cells[at : at + n] == few)
                        rest = np.arange(own[-1] + 1, at + n)
                        own = np.append(own, rest[size[rest] * percent <= 100 * size[own[-1]]])
                        if len(own) > 1:
                            tree = Tree(read_points([raw[i] for i in own], few), size[own], percent)
                            edges = tree.pairs().edges()
                            found |= {(names[own[x]], names[own[y]]) for x, y in edges}
            if found:
                a, b = zip(*found)
                edges = [pa.array(a, pa.binary()), pa.array(b, pa.binary())]
                yield pa.RecordBatch.from_arrays(edges, schema=arrow)

    return rows.select("slab", "n", "point", "set").mapInArrow(join, schema)


def verified(sets: DataFrame, percent: int) -> DataFrame:
    """Edges ``a, b`` that connect the same sets as all true links do.

    ``sets`` has columns label (a candidate component), blocks, set and shingles. A component is
    dealt into blocks by a hash of the set, and every pair of its blocks is a task of bounded size
    that counts common shingles of all its pairs with matrix products; a component of up to BLOCK
    sets is one block.
    """
    block = F.pmod(F.xxhash64(F.lit(3), "set"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = (
        sets.withColumn("block", block)
        .withColumn("other", other)
        .select(
            "label",
            F.least("block", "other").alias("i"),
            F.greatest("block", "other").alias("j"),
            "set",
            "shingles",
        )
    )
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def verify(group: pa.Table) -> pa.Table:
        found = dict(zip(group.column("set").to_pylist(), group.column("shingles").to_pylist()))
        names = sorted(found)
        members = [np.frombuffer(found[name], "<u8") for name in names]
        union = linked(members, percent)
        edges = union.edges()
        return pa.table([[names[x] for x, _ in edges], [names[y] for _, y in edges]], schema=schema)

    return spread.groupBy("label", "i", "j").applyInArrow(verify, "a binary, b binary")


def blocks_of(sets: DataFrame) -> DataFrame:
    """Rows with columns label and n, and the number of ``blocks`` that their component is dealt into."""
    blocks = F.greatest(
        F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))
    )
    return sets.join(sets.groupBy("label").agg(blocks.cast("int").alias("blocks")), "label")


def twins(texts: DataFrame, width: int, buckets: int) -> DataFrame:
    """``set, shared``: how many shingles of every set stand in another set, too, or seem to.

    Every shingle is sent once, to the task of its bucket, as 32 bits and its set's place in the slice that
    it comes from. Shingles that agree in these bits count as shared, so a number may be too large, never
    too small.
    """
    schema = fields(texts, bucket="int", sets="binary", owner="binary", value="binary")

    def deal(batch):
        names = np.array(batch.column("set").to_pylist(), "S16").view("V16")
        found = shingle_sets(pa.array([t.decode() for t in unpacked(batch)], pa.string()), width)[0]
        owner = np.repeat(np.arange(len(found), dtype="<u4"), [len(s) for s in found])
        flat = mixed(np.concatenate(found))
        bucket = (flat >> U64(32)) % U64(buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        out = {"bucket": [], "sets": [], "owner": [], "value": []}
        for at in np.split(order, cuts) if len(order) else ():
            own, place = np.unique(owner[at], return_inverse=True)
            out["bucket"].append(int(bucket[at[0]]))
            out["sets"].append(names[own].tobytes())
            out["owner"].append(place.astype("<u2" if len(own) <= 1 << 16 else "<u4").tobytes())
            out["value"].append(flat[at].astype("<u4").tobytes())
        return out

    def count(group: pa.Table) -> pa.Table:
        sets, owner, value, before = [], [], [], 0
        for names, at, v in zip(*(group.column(c).to_pylist() for c in ("sets", "owner", "value"))):
            value.append(np.frombuffer(v, "<u4"))
            sets.append(np.frombuffer(names, "V16"))
            owner.append(np.frombuffer(at, f"<u{len(at) // len(value[-1])}").astype(np.int64) + before)
            before += len(sets[-1])
        _, kind, times = np.unique(np.concatenate(value), return_inverse=True, return_counts=True)
        shared = np.bincount(np.concatenate(owner)[times[kind] > 1], minlength=before)
        some = np.flatnonzero(shared)
        names = pa.array([n.tobytes() for n in np.concatenate(sets)[some]], pa.binary())
        return pa.table({"set": names, "shared": pa.array(shared[some], pa.int64())})

    dealt = map_slices(texts, deal, schema, "packed")
    found = dealt.groupBy("bucket").applyInArrow(count, "set binary, shared long")
    return found.groupBy("set").agg(F.sum("shared").alias("shared"))


def to_verify(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """What ``verified`` takes, from written rows label, set, n and packed, one per set.

    Two sets that link share percent of each at least. So a set of a component of several blocks leaves
    here if fewer of its shingles stand in any other set of such components, and is sent once instead
    of once a block; the others are dealt into as many blocks as they need.
    """
    sized = blocks_of(texts.select("label", "set", "n"))
    wide = materialize(sized.where("blocks > 1").select("set", "n"), "wide")
    total = wide.agg(F.sum("n").alias("n")).first()["n"]
    if total:
        long = texts.select("set", "packed").join(wide.hint("merge"), "set")
        shared = twins(long.select("set", "packed"), width, -(-total // BUCKET_SHINGLES))
        enough = F.coalesce("shared", F.lit(0)) * 100 >= F.col("n") * percent
        alone = materialize(wide.join(shared, "set", "left").where(~enough).select("set"), "alone")
        texts = texts.join(alone, "set", "left_anti")
    rows = blocks_of(texts.select("label", "set", "n")).select("set", "label", "blocks")
    rows = texts.select("set", "packed").join(rows.hint("merge"), "set")
    schema = fields(rows, "set", "label", "blocks", shingles="binary")

    def fetch(batch):
        columns = {name: batch.column(name) for name in ("set", "label", "blocks")}
        found = shingle_sets(pa.array([t.decode() for t in unpacked(batch)], pa.string()), width)[0]
        return columns | {"shingles": [s.astype("<u8").tobytes() for s in found]}

    return map_slices(rows, fetch, schema, "packed")


def linked(members: list[np.ndarray], percent: int) -> Union:
    """All links between sets: those shingles that occur more than once, as columns of a matrix."""
    union = Union(len(members))
    size = np.array([len(m) for m in members])
    if len(members) == 2:
        shared = np.array([len(np.intersect1d(*members, assume_unique=True))])
        if 100 * shared[0] >= percent * (size.sum() - shared[0]):
            union.join(0, 1)
        return union
    row = np.repeat(np.arange(len(members)), size)
    _, column, count = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
    wide = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[column]
    row, wide = row[wide >= 0], wide[wide >= 0]
    order = np.argsort(wide, kind="stable")
    row, wide = row[order], wide[order]
    shared = np.zeros((len(members), len(members)), np.float32)
    for low in range(0, int(wide[-1]) + 1 if len(wide) else 0, COLUMNS):
        a, b = np.searchsorted(wide, (low, low + COLUMNS))
        part = np.zeros((len(members), COLUMNS), np.float32)
        part[row[a:b], wide[a:b] - low] = 1
        shared += part @ part.T
    for i in range(len(members)):
        common = shared[i, i + 1 :].astype(np.int64)
        for j in np.flatnonzero(100 * common >= percent * (size[i] + size[i + 1 :] - common)):
            union.join(i, i + 1 + int(j))
    return union


def jaccard_components(
    docs: DataFrame,
    width: int = WIDTH,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: ``row1, row2, doc_id, n_shingles, component_id, stays``.

    Documents link when their sets of ``width``-word shingles overlap by ``percent`` of their union;
    A-Z are lower-cased, words stand between ASCII white space, and fewer words than a shingle's
    are one shingle. ``component_id`` is the smallest id that links reach, the document's own
    included, and the one that ``stays`` where a component is to be cut down to one document (of
    documents with equal ids, the one of the smallest row key). Null and empty texts have no shingles and are linked with nothing, not even each
    other; a null id is the smallest of a component only if no other is there. Repeated rows get
    equal rows; an empty table gives none.

    Equal sets are one point from the start, so groups of exact copies cost nothing further; no
    pairs are written, only edges that connect what is linked. No partner or candidate is dropped.
    """
    source = rows_of(docs, id_col, text_col)
    described = materialize(points(source, width, percent), "jaccard-points")
    maybe = materialize(components(candidates(described, percent)), "jaccard-maybe")
    chosen = (
        described.groupBy("set")
        .agg(F.min(F.struct(*ROW)).alias("row"), F.first("n").alias("n"))
        .join(maybe.withColumnRenamed("node", "set"), "set")
        .select("row.*", "set", "label", "n")
    )
    chosen = materialize(chosen, "jaccard-chosen")
    # A merge join at every size, so that small and large inputs move their texts alike. Rows may repeat.
    meeting = packed_texts(source).join(chosen.hint("merge"), [*ROW]).dropDuplicates(["set"])
    texts = materialize(meeting.select("label", "set", "n", "packed"), "jaccard-texts")
    whole = to_verify(texts, width, percent)
    labels = materialize(components(verified(whole, percent)), "jaccard-labels")
    salt = lambda c: F.xxhash64(c).alias("salt")
    member = (
        described.select(*ROW, "doc_id", "n", "set", salt("set"))
        .join(labels.select(F.col("node").alias("set"), "label", salt("node")), ["set", "salt"], "left")
        .select(*ROW, "doc_id", "n", F.coalesce("label", "set").alias("label"))
    )
    smallest = (
        member.where("n > 0")
        .groupBy("label")
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *ROW)).alias("smallest"))
    )
    return (
        member.withColumn("salt", salt("label"))
        .join(smallest.withColumn("salt", salt("label")), ["label", "salt"], "left")
        .withColumn("own", F.struct(F.col("doc_id").isNull(), "doc_id", *ROW))
        .withColumn("smallest", F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("own")))
        .select(
            *ROW,
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.col("smallest.doc_id").alias("component_id"),
            F.col("smallest").eqNullSafe(F.col("own")).alias("stays"),
        )
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns; rows that repeat id and text stay alike."""
    kept = jaccard_components(docs, **options).where("stays").select(*ROW)
    rows = docs.select(F.struct("*").alias("row"), *row_keys("doc_id", "text"))
    return rows.join(kept, [*ROW], "left_semi").select("row.*")


JACCARD_SQL = rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + {WIDTH - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WIDTH - 1}, 1) + 1)) AS i FROM split WHERE len(w) > 0)),
sized AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT x, y FROM shared JOIN sized p ON x = p.doc_id JOIN sized q ON y = q.doc_id
  WHERE 100 * c >= {PERCENT} * (p.n + q.n - c)),
side AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT x, y FROM side UNION SELECT r.x, s.y FROM reach r JOIN side s ON r.y = s.x),
least_reached AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(y, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sized USING (doc_id) LEFT JOIN least_reached ON d.doc_id = x
"""


@query("op4_jaccard_join", JACCARD_SQL)
def op4_jaccard_join(spark, sf_dir):
    found = jaccard_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")
