"""Words of many texts at once as 64-bit hashes, in numpy over the bytes of an Arrow column."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Powers of the multiplier are kept for words up to this length; beyond it they repeat in blocks.
POWERS = 1 << 16


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: every input bit moves every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(1)
def powers() -> np.ndarray:
    """Independent odd factors by place, so that the hash of a word is a sum over its bytes."""
    return mixed(np.arange(1, POWERS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


@lru_cache(1)
def values() -> np.ndarray:
    return mixed(np.arange(257, 513, dtype=U64))


@lru_cache(1)
def lower_ascii() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


def spaces_between() -> np.ndarray:
    """Bytes that stand between words [^\\x20\\x09-\\x0D]+."""
    return np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, nulls as empty texts, and the offset where each text starts."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Where words start and end in the bytes of several texts, and their hashes."""

    def __init__(self, column: pa.Array, between: np.ndarray):
        data, self.offsets = column_bytes(column)
        self.data = lower_ascii()[data]
        inside = np.concatenate(([False], ~between[self.data], [False]))
        begins = inside[1:-1] & ~inside[:-2]
        ends = inside[1:-1] & ~inside[2:]
        # A text's first and last bytes have no neighbour, though other texts lie beside them.
        edge = self.offsets[:-1][np.diff(self.offsets) > 0]
        begins[edge] = inside[1:-1][edge]
        last = self.offsets[1:][np.diff(self.offsets) > 0] - 1
        ends[last] = inside[1:-1][last]
        self.start, self.stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        #: First word of each text, and the number of all.
        self.first = np.searchsorted(self.start, self.offsets)

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """A hash of every word, or of its first ``prefix`` bytes and its being that long."""
        size = self.stop - self.start
        if not size.size:
            return np.zeros(0, U64)
        kept = size if prefix is None else np.minimum(size, prefix)
        total = np.concatenate(([0], np.cumsum(kept)))
        place = np.arange(total[-1]) - np.repeat(total[:-1], kept)
        at = np.repeat(self.start, kept) + place
        part = values()[self.data[at]] * powers()[place % POWERS]
        if size.max() > POWERS:
            part = mixed(part + (place // POWERS).astype(U64))
        sums = np.add.reduceat(part, total[:-1])
        return mixed(sums + kept.astype(U64) * U64(0xD6E8FEB86659FD93))
