"""Draws of the bootstrap on arrays: how often a replicate draws each slice, and the sums inside slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PRIME = 2147483647
# Offsets that set the draws of slices, and those of units in each slice, apart.
OUTER = 715827883
INNER = 104729
#: Units whose values one task holds at a time, and draws that it makes at a time.
UNITS_A_CHUNK = 1 << 16
DRAWS_A_STEP = 1 << 16

COUNTS = "_k1 long, _k2 long, _start long, _b long, _chunk long, _slices int, _counts binary"
SUMS = "_k1 long, _k2 long, _b long, _total double, _present long"
COUNT_FIELDS = ["_k1", "_k2", "_start", "_b", "_chunk", "_slices", "_counts"]


def _fold(x: np.ndarray) -> np.ndarray:
    """A number that is congruent to x modulo PRIME, at most a few above it."""
    for _ in range(2):
        high = x >> 31
        x &= PRIME
        x += high
    return x


def state(start, replicate) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group and replicate, mixed before a draw's number comes in: no replicate is another one's shifted copy."""
    y0 = (replicate * 2654435 + start) % PRIME
    y1 = (y0 * y0 + 12345) % PRIME
    return y0, y1, (y1 * 48271 + replicate) % PRIME


def indices(y0, y1, y2, draw: np.ndarray, n) -> np.ndarray:
    """Deterministic pseudo-random indices in [0, n): quadratic mixing modulo a prime below 2^31, so
    every product stays within 63 bits and any SQL engine can repeat it. The quotient of doubles is
    exact, as both numbers are far below 2^53."""
    x0 = _fold(draw * 40503 + y2)
    x1 = _fold(x0 * x0 + y1)
    x1 *= 48271
    x2 = _fold(x1 + x0)
    x2 *= x2
    last = _fold(x2 + y0)
    last[last >= PRIME] -= PRIME
    return last - np.floor(last / n).astype(np.int64) * n


def slice_counts(start: int, n: int, replicates: np.ndarray, size: int) -> np.ndarray:
    """How many of a replicate's n draws fall into each slice; all of them if there is one."""
    slices = -(-n // size)
    if slices == 1:
        return np.full((len(replicates), 1), n)
    counts = np.zeros((len(replicates), slices), np.int64)
    y = [a[:, None] for a in state(start + OUTER, replicates)]
    rows, draws = max(1, DRAWS_A_STEP // n), max(DRAWS_A_STEP, slices)
    for top in range(0, len(replicates), rows):
        at = slice(top, top + rows)
        part = counts[at]
        for first in range(0, n, draws):
            found = indices(*[a[at] for a in y], np.arange(first, min(first + draws, n))[None, :], n) // size
            found += np.arange(len(part))[:, None] * slices
            part += np.bincount(found.ravel(), minlength=part.size).reshape(part.shape)
    return counts


def count_draws(size: int, seed: int):
    """Rows (group, first and last replicate) to packed counts of each replicate and chunk of slices."""
    a_chunk = max(1, UNITS_A_CHUNK // size)

    def packed(row: dict) -> Iterator[pa.RecordBatch]:
        replicates = np.arange(row["_first"], row["_last"] + 1)
        counts = slice_counts(row["_start"] + seed, row["_n"], replicates, size)
        for chunk, first in enumerate(range(0, counts.shape[1], a_chunk)):
            part = counts[:, first : first + a_chunk]
            small = part.astype(np.min_scalar_type(int(part.max())))
            same = lambda v, kind: pa.array([v] * len(replicates), kind)
            yield pa.RecordBatch.from_arrays(
                [
                    *[same(row[c], pa.int64()) for c in ("_k1", "_k2", "_start")],
                    pa.array(replicates),
                    same(chunk, pa.int64()),
                    same(part.shape[1], pa.int32()),
                    pa.array([r.tobytes() for r in small], pa.binary()),
                ],
                COUNT_FIELDS,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from packed(row)

    return run


def _unpacked(counts: list[bytes], slices: int) -> np.ndarray:
    rows = [np.frombuffer(c, f"u{len(c) // slices}").astype(np.int64) for c in counts]
    return np.stack(rows)


def sum_draws(size: int, seed: int):
    """Counts of a chunk's slices and its units (position, value) to sums of what each replicate draws there.

    NULL values are drawn, but are not present in the sum.
    """
    a_chunk = max(1, UNITS_A_CHUNK // size)

    def run(key: tuple, dealt: pa.Table, units: pa.Table) -> pa.Table:
        k1, k2, chunk, _ = (k.as_py() for k in key)
        names = ["_k1", "_k2", "_b", "_total", "_present"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
        if not (dealt.num_rows and units.num_rows):
            return pa.table([pa.array([], t) for t in kinds], names)
        units = units.sort_by("_j")
        has = units["_v"].is_valid().to_numpy()
        value = units["_v"].fill_null(0.0).to_numpy()
        slices = dealt["_slices"][0].as_py()
        # A slice's units stand one after the other; units without a name take no place.
        held = np.bincount(units["_j"].to_numpy() // size - chunk * a_chunk, minlength=slices)
        begins = np.cumsum(held) - held
        replicates = dealt["_b"].to_numpy()
        start = dealt["_start"][0].as_py() + seed + INNER * (chunk * a_chunk + np.arange(slices))
        counts = _unpacked(dealt["_counts"].to_pylist(), slices)
        counts[:, held == 0] = 0
        drawn = counts.sum(axis=1)
        total, present = np.zeros(len(drawn)), np.zeros(len(drawn), np.int64)
        rows = max(1, DRAWS_A_STEP // max(1, int(drawn.max())))
        for top in range(0, len(drawn), rows):
            at = slice(top, top + rows)
            of = counts[at]
            n = of.ravel()
            place = np.repeat(np.arange(n.size), n)
            draw = np.arange(place.size) - np.repeat(np.cumsum(n) - n, n)
            y = [a.ravel()[place] for a in state(start[None, :], replicates[at][:, None])]
            which = place % slices
            found = begins[which] + indices(*y, draw, held[which])
            row = place // slices
            total[at] = np.bincount(row, value[found], minlength=len(of))
            present[at] = np.bincount(row, has[found], minlength=len(of))
        some = np.flatnonzero(drawn)
        columns = [np.full(len(some), k1), np.full(len(some), k2), replicates[some], total[some], present[some]]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return run
