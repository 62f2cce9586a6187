"""XXH64 (the public hash) of many byte spans at once, equal to the JVM's ``xxhash64``."""

from __future__ import annotations

import numpy as np

# Fixed values of the hash.
P1 = np.uint64(0x9E3779B185EBCA87)
P2 = np.uint64(0xC2B2AE3D27D4EB4F)
P3 = np.uint64(0x165667B19E3779F9)
P4 = np.uint64(0x85EBCA77C2B2AE63)
P5 = np.uint64(0x27D4EB2F165667C5)


def _rotate(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotate(acc + lane * P2, 31) * P1


def _same_length(read, at: np.ndarray, length: int, seed: np.uint64) -> np.ndarray:
    """Hashes of spans that all have one length; ``read`` gives words of 8, 4 or 1 bytes."""
    zero = np.zeros(len(at), np.uint64)
    done = 0
    if length >= 32:
        parts = [zero + seed + P1 + P2, zero + seed + P2, zero + seed, zero + seed - P1]
        while done + 32 <= length:
            parts = [_round(p, read(8, at + (done + 8 * i))) for i, p in enumerate(parts)]
            done += 32
        h = _rotate(parts[0], 1) + _rotate(parts[1], 7) + _rotate(parts[2], 12) + _rotate(parts[3], 18)
        for p in parts:
            h = (h ^ _round(zero, p)) * P1 + P4
    else:
        h = zero + seed + P5
    h = h + np.uint64(length)
    while done + 8 <= length:
        h = _rotate(h ^ _round(zero, read(8, at + done)), 27) * P1 + P4
        done += 8
    if done + 4 <= length:
        h = _rotate(h ^ (read(4, at + done) * P1), 23) * P2 + P3
        done += 4
    while done < length:
        h = _rotate(h ^ (read(1, at + done) * P5), 11) * P1
        done += 1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[start:end] for every span; spans are taken together by length."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    views = {
        8: np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,)),
        4: np.ndarray((len(data) + 1,), "<u4", padded.data, 0, (1,)),
        1: padded,
    }

    def read(width: int, at: np.ndarray) -> np.ndarray:
        return views[width][at].astype(np.uint64)

    out = np.zeros(len(starts), np.uint64)
    lengths = ends - starts
    short = len(lengths) and lengths.max() < 1 << 16
    order = np.argsort(lengths.astype(np.uint16) if short else lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            out[rows] = _same_length(read, starts[rows], int(lengths[rows[0]]), np.uint64(seed))
    return out
