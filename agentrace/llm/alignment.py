"""Alignment of the tokens of two tokenizers by lockstep merging.

Both token streams of a text cut the same bytes. A pointer into each stream moves on where its token
ends first; where both end together, the bytes are cut into a new group. All texts of a batch move
their two pointers at once, as numpy vectors: each step gives one link per lane, and lanes that
have ended are taken out. A long text is several lanes, each of which begins after a cut, so that
a batch takes as many steps as its longest lane has links, not its longest text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from zstandard import ZstdCompressor, ZstdDecompressor

from agentrace.llm.batches import fields, map_slices
from agentrace.llm.registry import query, table
from agentrace.session import materialize

#: Tokens of the first tokenizer after which a lane looks for a cut to end at.
LANE = 256
#: Pairs whose counts travel with the tasks; the counts of all others are joined.
FREQUENT = 1 << 18
#: Distinct pairs that a counting task holds before it passes them on.
HELD = 1 << 20
#: Longer runs of white space overflow the stack of tiktoken's pattern.
LONG_SPACE = re.compile(r"\s{512}")
#: Every 128th character of such a run, which is far less to search.
SPARSE_SPACE = re.compile(r"\s{4}")
#: Tokens whose bytes are compared at a time.
COMPARED = 1 << 16


@lru_cache(1)
def byte_of_character() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def has_long_space(text: str) -> bool:
    return bool(SPARSE_SPACE.search(text[::128]) and LONG_SPACE.search(text))


class ByteLevel:
    """A byte-level BPE file of the tokenizers library.

    tiktoken encodes with the same vocabulary, which is several times faster. That gives the same
    ids only for the plain pattern and merges in the order of ids; other files, and texts with
    very long white space, go through the tokenizers library itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        self.exact.encode_special_tokens = True
        special = {t["id"] for t in spec["added_tokens"]}
        vocabulary = spec["model"]["vocab"]
        self.bytes = [b""] * self.exact.get_vocab_size()
        for token, i in vocabulary.items():
            if i not in special:
                self.bytes[i] = bytes(map(byte_of_character().__getitem__, token))
        self.fast = None
        if self.plain(spec, special):
            ranks = {self.bytes[i]: i for i in vocabulary.values() if i not in special}
            self.fast = tiktoken.Encoding(
                "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
            )

    @staticmethod
    def plain(spec: dict, special: set) -> bool:
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in pairs]
        return (
            spec["normalizer"] is None
            and before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space")
            and before.get("use_regex", True)
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
            and made == sorted(set(made))
            and len(made) + 256 == len(model["vocab"]) - len(special & set(model["vocab"].values()))
        )

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of a space and the text; special tokens in the text are plain text."""
        if self.fast is None:
            return self.slow([" " + t for t in texts])
        one = lambda t: self.fast.encode_to_numpy(" " + t, disallowed_special=())
        return [self.slow([" " + t])[0] if has_long_space(t) else one(t) for t in texts]

    def slow(self, texts: list[str]) -> list[np.ndarray]:
        coded = self.exact.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(c.ids, np.uint32) for c in coded]


class Pieces:
    """A sentencepiece model with byte fallback, which puts the space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            one = bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else None
            self.bytes.append(piece.replace("▁", " ").encode() if one is None else one)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.uint32) for ids in self.model.encode(texts, num_threads=1)]


class Side:
    """One tokenizer with its tables by id: bytes, their number, and the id in decimal digits."""

    def __init__(self, coder):
        self.encode, self.bytes = coder.encode, coder.bytes
        self.size = len(self.bytes)
        self.length = np.array(list(map(len, self.bytes)), np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.at = np.cumsum(self.length) - self.length
        names = [b"%d," % i for i in range(self.size)]
        self.signs = np.array(list(map(len, names)), np.int64)
        #: The id and a comma, padded to whole words of eight bytes.
        wide = -(-max(self.signs) // 8) * 8
        self.names = np.frombuffer(b"".join(n.ljust(wide) for n in names), np.dtype((np.void, wide)))

    def spells(self, ids: list[np.ndarray], whole: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the bytes of each text's tokens are its part of ``whole``, which has ``size`` bytes."""
        tokens = np.concatenate([np.zeros(0, np.int64), *ids])
        ends = np.cumsum(np.concatenate(([0], self.length[tokens])))
        made = np.diff(ends[np.cumsum([0, *map(len, ids)])])
        same = made == size
        if not same.all():
            some = [x for x, fits in zip(ids, same) if fits]
            same[same] = self.spells(some, whole[np.repeat(same, size)], size[same])
            return same
        for low in range(0, len(tokens), COMPARED):
            part = tokens[low : low + COMPARED]
            start, length = ends[low], self.length[part]
            shift = (self.at[part] - (ends[low : low + len(part)] - start)).astype(np.int32)
            source = np.repeat(shift, length)
            source += np.arange(len(source), dtype=np.int32)
            wrong = np.flatnonzero(self.flat[source] != whole[start : start + len(source)])
            same[np.searchsorted(np.cumsum(size), start + wrong, side="right")] = False
        return same


@lru_cache(2)
def sides(byte_level: str, pieces: str) -> tuple[Side, Side]:
    return Side(ByteLevel(byte_level)), Side(Pieces(pieces))


def encoded(texts: list[str], a: Side, b: Side) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids of both tokenizers; none where the texts are empty or the bytes of one differ."""
    none = np.zeros(0, np.uint32)
    ids_a, ids_b = [none] * len(texts), [none] * len(texts)
    full = [i for i, t in enumerate(texts) if t]
    own = [texts[i] for i in full]
    found_a, found_b = a.encode(own), b.encode(own)
    parts = [b" " + t.encode() for t in own]
    whole, size = np.frombuffer(b"".join(parts), np.uint8), np.array(list(map(len, parts)), np.int64)
    good = a.spells(found_a, whole, size) & b.spells(found_b, whole, size)
    for i, one, two, fits in zip(full, found_a, found_b, good):
        if fits:
            ids_a[i], ids_b[i] = one, two
    return ids_a, ids_b


def lane_starts(end_a: np.ndarray, end_b: np.ndarray, first: np.ndarray, stop: np.ndarray, lane: int):
    """Tokens of both sides that begin a lane: a text, or what follows a cut about every ``lane``."""
    count = (stop - first - 1) // lane
    at = np.repeat(first, count) + lane * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + 1)
    bound = np.minimum(at + lane, np.repeat(stop, count) - 1)
    found_a, found_b = [], []
    while len(at):
        at, bound = at[at < bound], bound[at < bound]
        place = np.searchsorted(end_b, end_a[at])
        hit = end_b[np.minimum(place, len(end_b) - 1)] == end_a[at]
        found_a.append(at[hit] + 1)
        found_b.append(place[hit] + 1)
        at, bound = at[~hit] + 1, bound[~hit]
    return found_a, found_b


def merged(end_a: np.ndarray, end_b: np.ndarray, first: np.ndarray, stop: np.ndarray, lane: int = LANE):
    """Links and cuts of both sides' tokens, by where tokens end.

    ``first`` and ``stop`` are tokens of the first side: where each text's begin and end. Both end
    columns run on over all texts, so texts end with a cut. Returns the linked tokens of both
    sides and those that end a group.
    """
    whole = first < stop
    first, stop = first[whole], stop[whole]
    more_a, more_b = lane_starts(end_a, end_b, first, stop, lane)
    begin_b = np.searchsorted(end_b, np.concatenate(([0], end_a))[first], side="right")
    i, j = np.concatenate([first, *more_a]), np.concatenate([begin_b, *more_b])
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    last = np.append(i[1:], stop[-1:])
    links_a, links_b, cuts_a, cuts_b = [], [], [], []
    while len(i):
        links_a.append(i)
        links_b.append(j)
        ends_a, ends_b = end_a[i], end_b[j]
        cut = ends_a == ends_b
        cuts_a.append(i[cut])
        cuts_b.append(j[cut])
        i, j = i + (ends_a <= ends_b), j + (ends_b <= ends_a)
        going = i < last
        if not going.all():
            i, j, last = i[going], j[going], last[going]
    return [np.concatenate([np.zeros(0, np.int64), *x]) for x in (links_a, links_b, cuts_a, cuts_b)]


@dataclass
class Aligned:
    """Tokens of several texts, their links (in order of both tokens if asked for) and the tokens that end groups."""

    a: np.ndarray
    b: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    links_a: np.ndarray
    links_b: np.ndarray
    cuts_a: np.ndarray
    cuts_b: np.ndarray


def align(texts: list[str], side_a: Side, side_b: Side, lane: int = LANE, ordered: bool = True) -> Aligned:
    ids_a, ids_b = encoded(texts, side_a, side_b)
    a, b = np.concatenate(ids_a).astype(np.int64), np.concatenate(ids_b).astype(np.int64)
    first_a = np.concatenate(([0], np.cumsum(list(map(len, ids_a)))))
    first_b = np.concatenate(([0], np.cumsum(list(map(len, ids_b)))))
    end_a, end_b = np.cumsum(side_a.length[a]), np.cumsum(side_b.length[b])
    links_a, links_b, cuts_a, cuts_b = merged(end_a, end_b, first_a[:-1], first_a[1:], lane)
    if ordered:
        order = np.argsort(links_a + links_b, kind="stable")
        links_a, links_b = links_a[order], links_b[order]
    return Aligned(a, b, first_a, first_b, links_a, links_b, np.sort(cuts_a), np.sort(cuts_b))


def group_texts(found: Aligned, side_a: Side, side_b: Side) -> Iterator[memoryview]:
    """Per text its groups, as ``a1,a2|b1;a3|b2,b3`` with decimal ids."""
    stop_a, stop_b = found.cuts_a + 1, found.cuts_b + 1
    size_a, size_b = (np.diff(stop, prepend=0) for stop in (stop_a, stop_b))
    # A group's tokens of the second side come after all of its own and earlier ones of the first.
    at_a = np.arange(len(found.a)) + np.repeat(stop_b - size_b, size_a)
    at_b = np.arange(len(found.b)) + np.repeat(stop_a, size_b)
    wide = max(side_a.names.itemsize, side_b.names.itemsize)
    size = np.zeros(len(at_a) + len(at_b), np.int64)
    sign = np.zeros(len(size), np.dtype((np.void, wide)))
    byte = sign.view(np.uint8).reshape(-1, wide)
    for side, ids, at, cuts, mark in (
        (side_a, found.a, at_a, found.cuts_a, b"|"),
        (side_b, found.b, at_b, found.cuts_b, b";"),
    ):
        size[at] = side.signs[ids]
        sign[at] = side.names.astype(sign.dtype, copy=False)[ids]
        byte[at[cuts], size[at[cuts]] - 1] = ord(mark)
    flat = memoryview(byte[np.arange(wide) < size[:, None]])
    ends = np.concatenate(([0], np.cumsum(size)))
    bounds = ends[found.first_a + found.first_b].tolist()
    for low, high in zip(bounds, bounds[1:]):
        yield flat[low : max(low, high - 1)]


def link_columns(texts: list[str], side_a: Side, side_b: Side) -> dict:
    """Per text the counts, the digest of its groups, and its links' pairs, sorted and packed."""
    found = align(texts, side_a, side_b, ordered=False)
    text = np.repeat(np.arange(len(texts)), np.diff(found.first_a))[found.links_a]
    n_links = np.bincount(text, minlength=len(texts))
    width = side_a.size * side_b.size
    pair = text * width + found.a[found.links_a] * side_b.size + found.b[found.links_b]
    pair.sort()
    pair -= np.repeat(np.arange(len(texts)) * width, n_links)
    starts, squeeze = np.concatenate(([0], np.cumsum(n_links))), ZstdCompressor(level=1).compress
    step = np.diff(pair, prepend=0)
    begins = starts[:-1][n_links > 0]
    step[begins] = pair[begins]
    step, starts = step.astype("<u8"), starts.tolist()
    packed = [squeeze(step[x:y].tobytes()) if y > x else b"" for x, y in zip(starts, starts[1:])]
    return {
        "n_a": np.diff(found.first_a),
        "n_b": np.diff(found.first_b),
        "n_groups": np.diff(np.searchsorted(found.cuts_a, found.first_a)),
        "n_links": n_links,
        "groups_sha256": [sha256(g).hexdigest() if len(g) else "" for g in group_texts(found, side_a, side_b)],
        "links": packed,
    }


def unpacked_pairs(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of several texts one after another, and where each text's begin."""
    expand = ZstdDecompressor().decompress
    parts = [np.cumsum(np.frombuffer(expand(p), "<u8").astype(np.int64)) if p else np.zeros(0, np.int64) for p in packed]
    return np.concatenate(parts), np.concatenate(([0], np.cumsum(list(map(len, parts)))))


def pair_counts(stored: DataFrame) -> DataFrame:
    """``pair, n``: how many links of the corpus hold each pair; counted in tasks, then summed."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def count(batches):
        names, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                pairs, _ = unpacked_pairs(batch.column(0)[at : at + 512].to_pylist())
                own, n = np.unique(pairs, return_counts=True)
                names, place = np.unique(np.concatenate((names, own)), return_inverse=True)
                sums = np.bincount(place, np.concatenate((sums, n)), len(names)).astype(np.int64)
                if len(names) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sums)], schema=schema)
                    names, sums = names[:0], sums[:0]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sums)], schema=schema)

    counted = stored.select("links").mapInArrow(count, "pair long, n long")
    return counted.groupBy("pair").agg(F.sum("n").alias("n"))


def aligned_tokens(
    docs: DataFrame,
    byte_level: str,
    pieces: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    frequent: int = FREQUENT,
) -> tuple[DataFrame, DataFrame]:
    """Per input row its alignment, and per id pair how many links of the corpus hold it.

    The first table has ``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum``,
    the second ``a, b, n, best`` (whether no other partner of ``b`` has more links). Every text is
    encoded whole by both tokenizers, special tokens in it as plain text. Null and empty texts, and
    texts whose bytes a tokenizer changes, have no tokens: zeros and an empty digest. Repeated rows
    get equal rows and count as often as they stand; null ids stay null; an empty table gives none.

    The ``frequent`` pairs with the most links, a fixed number, travel with the tasks and settle
    nearly all links; the pairs of a row that aren't among them meet their counts in a join.
    """
    source = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    counts = {"n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint"}
    schema = fields(source, "doc_id", **counts, groups_sha256="string", links="binary")

    def describe(batch):
        texts = batch.column("text").to_pylist()
        return {"doc_id": batch.column("doc_id"), **link_columns(texts, *sides(byte_level, pieces))}

    described = map_slices(source, describe, schema, "text")
    stored = materialize(described.withColumn("row", F.monotonically_increasing_id()), "alignment")
    width = len(Pieces(pieces).bytes)
    b = F.pmod("pair", F.lit(width))
    pairs = materialize(pair_counts(stored).withColumn("b", b), "alignment-pairs")
    most = pairs.groupBy("b").agg(F.max("n").alias("most"))
    pairs = pairs.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"), "b")
    pairs = materialize(pairs, "alignment-counts")
    top = pairs.orderBy(F.desc("n"), "pair").limit(frequent).select("pair", "n", "best").toArrow()
    order = np.argsort(top.column("pair").to_numpy())
    known = [top.column(c).to_numpy(zero_copy_only=False)[order] for c in ("pair", "n", "best")]
    sent = docs.sparkSession.sparkContext.broadcast(known)
    kept = ("row", "doc_id", *counts, "groups_sha256")
    more = {"n_best": "bigint", "count_sum": "bigint", "rest": "array<bigint>"}
    schema = fields(stored, *kept, **more)

    def settle(batch):
        names, sums, best = sent.value
        pair, start = unpacked_pairs(batch.column("links").to_pylist())
        place = np.minimum(np.searchsorted(names, pair), max(len(names) - 1, 0))
        hit = names[place] == pair if len(names) else np.zeros(len(pair), bool)
        row = np.repeat(np.arange(batch.num_rows), np.diff(start))
        total = np.zeros(len(pair) + 1, np.int64)
        np.cumsum(np.where(hit, sums[place], 0) if len(names) else total[1:], out=total[1:])
        good = row[hit & best[place]] if len(names) else row[:0]
        left = np.bincount(row[~hit], minlength=batch.num_rows)
        ends = pa.array(np.concatenate(([0], np.cumsum(left))).astype(np.int32))
        return {
            **{name: batch.column(name) for name in kept},
            "n_best": np.bincount(good, minlength=batch.num_rows),
            "count_sum": total[start[1:]] - total[start[:-1]],
            "rest": pa.ListArray.from_arrays(ends, pa.array(pair[~hit])),
        }

    settled = materialize(map_slices(stored, settle, schema, "links"), "alignment-settled")
    rare = (
        settled.select("row", F.explode("rest").alias("pair"))
        .groupBy("row", "pair")
        .agg(F.count("*").alias("times"))
        .join(pairs.select("pair", "n", "best"), "pair")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.col("n")).alias("sums"), F.sum(F.when(F.col("best"), F.col("times"))).alias("more"))
    )
    added = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c)
    result = settled.join(rare, "row", "left").select(
        "doc_id", *counts, added("n_best", "more"), added("count_sum", "sums"), "groups_sha256"
    )
    a = F.floor(F.col("pair") / width).alias("a")
    return result, pairs.select(a, "b", "n", "best")


def token_links(
    docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per link, in order: ``doc_id, link, group, a_at, b_at, a, b, start, stop``.

    ``a_at`` and ``b_at`` number a text's tokens from 0, ``group`` its groups; ``start`` and ``stop``
    are the bytes of a space and the text that both tokens cover.
    """
    source = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    new = {"link": "int", "group": "int", "a_at": "int", "b_at": "int", "a": "int", "b": "int", "start": "int", "stop": "int"}
    schema = fields(source, "doc_id", **new)

    def links(batch):
        one, two = sides(byte_level, pieces)
        found = align(batch.column("text").to_pylist(), one, two)
        x, y = found.links_a, found.links_b
        text = np.searchsorted(found.first_a, x, side="right") - 1
        end_a, end_b = np.cumsum(one.length[found.a]), np.cumsum(two.length[found.b])
        base = np.concatenate(([0], end_a))[found.first_a[text]]
        cut = np.searchsorted(found.cuts_a, x)
        return {
            "doc_id": batch.column("doc_id").take(pa.array(text)),
            "link": np.arange(len(x)) - np.searchsorted(x, found.first_a[text]),
            "group": cut - np.searchsorted(found.cuts_a, found.first_a[text]),
            "a_at": x - found.first_a[text],
            "b_at": y - found.first_b[text],
            "a": found.a[x],
            "b": found.b[y],
            "start": np.maximum(end_a[x] - one.length[found.a[x]], end_b[y] - two.length[found.b[y]]) - base,
            "stop": np.minimum(end_a[x], end_b[y]) - base,
        }

    return map_slices(source, links, schema, "text")


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@query("op13_token_alignment")
def op13_token_alignment(spark, sf_dir):
    return aligned_tokens(table(spark, sf_dir, "documents"), *default_tokenizers())[0]
