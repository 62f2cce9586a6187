"""Hashes, codes and packed arrays against plain versions."""

import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from windowguard.llm import arrays, chat, golay, packing, suffix_dedup, xxh64

TEXTS = ["a b  c a b", None, "", "x\ny\t z", "é è", " lead trail "]


def test_words_and_their_hashes():
    data, offsets = arrays.text_bytes(pa.array(TEXTS))
    starts, ends, first = arrays.spans(data, offsets, ~arrays.WHITE)
    found = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in TEXTS]
    assert found == sum(want, [])
    assert np.diff(first).tolist() == [len(w) for w in want]
    hashes = arrays.span_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len(set(found))
    pairs = arrays.window_hashes(hashes, 2)
    assert pairs[0] == pairs[3] and pairs[0] != pairs[1]
    assert arrays.window_hashes_2d(hashes[:2][None, :])[0] == pairs[0]
    assert arrays.within(first, 3, len(starts)).tolist() == [0, 1, 2, 5]


@pytest.mark.parametrize("k", [1, 2, 3, 5, 10, 20])
def test_window_hashes_depend_on_the_whole_window(k):
    values = np.random.default_rng(0).integers(0, 3, 300).astype(np.uint64)
    hashes = arrays.window_hashes(values, k)
    seen = {}
    for i, h in enumerate(hashes.tolist()):
        assert seen.setdefault(h, tuple(values[i : i + k])) == tuple(values[i : i + k])
    assert len(seen) == len({tuple(values[i : i + k]) for i in range(len(hashes))})


@given(st.lists(st.binary(max_size=120), min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_xxh64(values):
    data = np.frombuffer(b"".join(values), np.uint8)
    ends = np.cumsum([len(v) for v in values])
    starts = ends - np.array([len(v) for v in values])
    assert xxh64.hashes(data, starts, ends).tolist() == [xxhash.xxh64_intdigest(v, 42) for v in values]


def test_golay_keys_meet_within_two_bits():
    dice = np.random.default_rng(1)
    words = dice.integers(0, 1 << 23, 3000)
    flips = (1 << dice.integers(0, 23, 3000)) | (1 << dice.integers(0, 23, 3000))

    def sets(values):
        out = [set() for _ in values]
        for row, key in zip(*golay.keys(values)):
            out[row].add(int(key))
        return out

    left = sets(words)
    assert {len(k) for k in left} == {1, 6}
    assert all(a & b for a, b in zip(left, sets(words ^ flips)))


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_packing(values):
    array = np.array(values, np.uint64)
    assert packing.unpack(packing.pack(array), np.uint64).tolist() == values
    assert packing.unpack_sorted(packing.pack_sorted(np.sort(array)), np.uint64).tolist() == sorted(values)
    flags = array % 2 == 1
    assert packing.unpack_bits(packing.pack_bits(flags), len(values)).tolist() == flags.tolist()


@given(st.lists(st.text(alphabet="ab", max_size=40), min_size=1, max_size=6), st.integers(2, 23))
@settings(max_examples=80, deadline=None)
def test_suffix_refinement_and_common_prefixes(values, depth):
    data, offsets = arrays.text_bytes(pa.array([*values, values[0] + values[-1]]))
    size = np.diff(offsets)
    left = np.repeat(offsets[1:], size) - np.arange(len(data))
    if not len(data):
        return
    order, new = suffix_dedup.refine(data, left, depth)
    raw = bytes(data)
    starts = [i for i in range(len(raw)) if left[i] >= depth]
    strings = [raw[i : i + depth] for i in starts]
    want = [i for i, s in zip(starts, strings) if strings.count(s) > 1]
    assert sorted(order.tolist()) == want
    assert [raw[i : i + depth] for i in order] == sorted(raw[i : i + depth] for i in want)
    at, length = suffix_dedup.common_prefixes(data, left, order, new, depth)
    assert at.tolist() == want and all(n >= depth for n in length)
    assert all(n <= left[i] and raw.count(raw[i : i + n]) for i, n in zip(at, length))


@given(st.text(alphabet="<>|s/[INST]\\end ", max_size=60))
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROLS)
