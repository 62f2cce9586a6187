"""A verified hash table of byte spans: open addressing, and bytes compared before spans count as equal."""

from __future__ import annotations

import numpy as np

from windowguard.llm import arrays

LONG = 64


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the spans that start at ``a`` and at ``b``, of the same lengths, hold the same bytes."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))
    same = np.ones(len(a), bool)
    rows, done = np.flatnonzero((lengths > 0) & (lengths <= LONG)), 0
    while len(rows):
        unlike = words[a[rows] + done] ^ words[b[rows] + done]
        rest = lengths[rows] - done
        unlike <<= (8 * np.maximum(0, 8 - rest)).astype(np.uint64)
        same[rows[unlike != 0]] = False
        done += 8
        rows = rows[(unlike == 0) & (rest > 8)]
    for i in np.flatnonzero(lengths > LONG).tolist():
        n = int(lengths[i])
        same[i] = np.array_equal(data[a[i] : a[i] + n], data[b[i] : b[i] + n])
    return same


def first_equal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """For each span the number of the first span with the same bytes, in the same group if groups are given.

    All spans probe the table in step. A span that finds its slot empty takes it; one that finds it
    taken is compared with the holder byte by byte, and goes on to the next slot if they differ.
    """
    lengths = ends - starts
    keys = arrays.span_hashes(data, starts, ends)
    if group is not None:
        keys = arrays.pair(keys, group.astype(np.uint64))
    bits = max(4, int(2 * len(starts)).bit_length())
    table = np.full(1 << bits, -1, np.int64)
    slot = (keys >> np.uint64(64 - bits)).astype(np.int64)
    holder = np.empty(len(starts), np.int64)
    left = np.arange(len(starts))
    while len(left):
        at = slot[left]
        empty = np.flatnonzero(table[at] < 0)[::-1]  # the first span of a slot is written last and stays
        table[at[empty]] = left[empty]
        held = table[at]
        equal = (lengths[held] == lengths[left]) & (keys[held] == keys[left])
        if group is not None:
            equal &= group[held] == group[left]
        to_see = np.flatnonzero(equal & (held != left))
        seen = same_bytes(data, starts[held[to_see]], starts[left[to_see]], lengths[left[to_see]])
        equal[to_see] = seen
        holder[left[equal]] = held[equal]
        left = left[~equal]
        slot[left] = (slot[left] + 1) & ((1 << bits) - 1)
    return holder
