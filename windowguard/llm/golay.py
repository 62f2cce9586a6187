"""Fuzzy keys from the binary Golay code of 23 bits with 12 message bits.

Every 23-bit word lies within three bits of exactly one codeword. Taking all codewords within
four bits gives a word one key, or six where the nearest codeword is three bits away, and any two
words that differ in two bits or fewer share a key: the word halfway between them is within three
bits of some codeword, which is then within four of both.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Fixed value: a generator polynomial of the code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
BITS, CHECKS = 23, 11


def _remainder(word: int) -> int:
    for bit in range(BITS - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECKS)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of each bit, and for each remainder the errors of weight four or less, -1 where none."""
    unit = np.array([_remainder(1 << i) for i in range(BITS)], np.int64)
    errors: list[list[int]] = [[] for _ in range(1 << CHECKS)]
    for weight in range(5):
        for places in combinations(range(BITS), weight):
            rest = 0
            for p in places:
                rest ^= int(unit[p])
            errors[rest].append(sum(1 << p for p in places))
    table = np.full((1 << CHECKS, max(map(len, errors))), -1, np.int64)
    for rest, row in enumerate(errors):
        table[rest, : len(row)] = row
    return unit, table


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for every key of every word: the message bits of the codewords near it."""
    unit, table = _tables()
    words = words.astype(np.int64)
    rest = np.zeros(len(words), np.int64)
    for bit in range(BITS):
        rest ^= np.where(words >> bit & 1, unit[bit], 0)
    errors = table[rest]
    row, column = np.nonzero(errors >= 0)
    return row, (words[row] ^ errors[row, column]) >> CHECKS
