"""Numpy helpers for the UTF-8 bytes of text columns: words, lines, hashes of both, runs.

Everything here works on one small piece of an Arrow batch inside a task. Hash values are
64-bit polynomials of randomly mapped bytes, mixed afterwards; callers that compare texts of
different documents use two independent lanes, 128 bits in all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20
KEPT_POWERS = 4 << 20
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True

_ROOTS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BYTES: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of an ordered pair of hashes."""
    return mix(a * np.uint64(0xC2B2AE3D27D4EB4F) + (b ^ (b >> np.uint64(32))) + np.uint64(1))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its values; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(batch: pa.RecordBatch | pa.Table, column: str, limit: int = PIECE_BYTES) -> Iterator:
    """Row ranges of a batch with at most ``limit`` bytes of text each, or one longer row."""
    if batch.num_rows == 0:
        return
    _, offsets = text_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
    """Maximal runs of bytes that ``inside`` (256 flags) allows, none across two values.

    Returns starts, ends and, for each value, the index of its first run (one more at the end).
    """
    flags = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = flags.copy()
    begin[1:] &= ~flags[:-1] | edge[1:-1]
    last = flags.copy()
    last[:-1] &= ~flags[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _powers(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    known = _POWERS.get(lane)
    if known is None or len(known[0]) < n:
        size = max(n, 2 * PIECE_BYTES)
        root = _ROOTS[lane]
        both = []
        for base in (root, pow(root, -1, 1 << 64)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            both.append(np.cumprod(row, dtype=np.uint64))
        if n > KEPT_POWERS:  # a very long text is no reason to keep tables of its length
            return both[0], both[1]
        known = _POWERS[lane] = (both[0], both[1])
    return known


class Substrings:
    """64-bit hashes of any substrings of some bytes."""

    def __init__(self, data: np.ndarray, lane: int = 0):
        if lane not in _BYTES:
            numbers = np.random.default_rng(1234 + lane).integers(1, 1 << 63, 256, np.uint64)
            _BYTES[lane] = numbers * np.uint64(2) + np.uint64(1)
        power, self.inverse = _powers(lane, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[lane][data] * power[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return pair(raw, (ends - starts).astype(np.uint64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    return Substrings(data, lane).of(starts, ends)


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values, built from windows of doubling length."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    level, size, done, out = hashes, 1, 0, None
    while True:
        if k & size:
            part = level[done : done + n]
            out = part.copy() if out is None else pair(out, part)
            done += size
        if done == k:
            return out
        level = pair(level[: len(level) - size], level[size:])
        size *= 2


def window_hashes_2d(rows: np.ndarray) -> np.ndarray:
    """The hash of each row of k values, equal to that of ``window_hashes`` with the same k."""
    k = rows.shape[1]
    level, size, done, out = rows, 1, 0, None
    while True:
        if k & size:
            out = level[:, done] if out is None else pair(out, level[:, done])
            done += size
        if done == k:
            return out
        level = pair(level[:, :-size], level[:, size:])
        size *= 2


def within(first: np.ndarray, k: int, total: int) -> np.ndarray:
    """Starts of the k-windows that stay inside one value; ``first`` as from ``spans``."""
    n = max(0, total - k + 1)
    ok = np.ones(n, bool)
    for back in range(1, k):
        border = first[1:-1] - back
        ok[border[(border >= 0) & (border < n)]] = False
    return np.flatnonzero(ok)


def covered(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Flags of the positions that an interval [start, start + length) covers."""
    change = np.zeros(total + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + length, -1)
    return np.cumsum(change[:-1]) > 0


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order; sorting beats hashing here."""
    ordered = np.sort(values)
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return ordered[new]


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each group; group i is first[i]:first[i + 1]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
