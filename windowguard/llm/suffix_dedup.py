"""Removal of byte strings that occur more than once, by suffix arrays of shards.

Documents are dealt to shards of about 256 KB, which sort within a core's cache, by a hash.

1. Within a shard, suffixes are sorted to the depth of the shortest string that counts by
   Larsson-Sadakane refinement: ranks by the first h bytes give ranks by 2h bytes, and only groups
   that are still tied are sorted again. Common prefixes of neighbours follow in text order as in
   Kasai's algorithm: where the neighbour moves along, the prefix is one byte shorter.
2. Suffix lists of all shards are too long to move, so shards are merged on anchors. The anchor of
   a string is the place of its least hashed 8-gram; equal strings have the same anchor wherever
   they occur. Starts with one anchor and nearly one offset form a block. A shard sends two hashes
   per block: of all bytes of its strings, and of the core that all of them share. The sorted lists
   of the shards are merged by binary search: a block found in two shards is repeated as a whole; a
   core found with different blocks may hide a part.
3. Only for those blocks, one shard of each kind sends the hash of every single string, merged in
   the same way.

All hashes that decide carry 128 bits. The steps share one shuffle of the texts, and a string in
very many documents sends a row per shard.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowguard.llm import arrays
from windowguard.llm.packing import pack, pack_bits, pack_sorted, unpack, unpack_bits, unpack_sorted

LENGTH = 400
GRAM = 8
GRAM_FACTOR = np.uint64(0x9E3779B97F4A7C15)
STEP = 64
SHARD_BYTES = 1 << 18
MIN_SHARDS = 64
MIN_RANGES = 16
SHARDS_PER_RANGE = 64
#: Three numbers of so many bits fit 64, so shards up to 2 MB are sorted without index arrays.
PACKED_BITS = 21

SENT = "kind int, part int, bucket int, first binary, second binary"
MESSAGE = "bucket int, part int, kind int, data binary"
BLOCKS, CORES, STRINGS = 0, 1, 2

_SENT = pa.schema(
    [("kind", pa.int32()), ("part", pa.int32()), ("bucket", pa.int32()), ("first", pa.binary()), ("second", pa.binary())]
)
_MESSAGE = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])


def refine(data: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that share their first ``depth`` bytes with another one.

    ``left`` is the number of bytes from each position to the end of its document. Returns the
    positions in suffix order and a flag at the first of each group.
    """
    n = len(data)
    bits = PACKED_BITS if n <= 1 << PACKED_BITS else 0
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.ndarray((n,), ">u8", padded.data, 0, (1,))
    h = min(5, depth)
    at = np.flatnonzero(left >= h)
    key = words[at].astype(np.uint64) >> np.uint64(64 - 8 * h)
    rank = np.zeros(n, np.int64)
    base = np.zeros(len(at), np.int64)
    while True:
        at, key, base = _sorted(at, key, base, bits)
        old = np.ones(len(at), bool)
        old[1:] = base[1:] != base[:-1]
        new = old.copy()
        new[1:] |= key[1:] != key[:-1]
        index = np.arange(len(at))
        old_start = np.maximum.accumulate(np.where(old, index, 0))
        new_start = np.maximum.accumulate(np.where(new, index, 0))
        rank[at] = base + new_start - old_start
        tied = ~new
        tied[:-1] |= ~new[1:]
        if h == depth:
            return at[tied], new[tied]
        at = at[tied]
        step = min(2 * h, depth)
        at = at[left[at] >= step]
        base, key = rank[at], rank[at + step - h].astype(np.uint64)
        h = step


def _sorted(at: np.ndarray, key: np.ndarray, base: np.ndarray, bits: int):
    """Positions, keys and bases in the order of (base, key, position)."""
    if not bits:
        order = np.lexsort((at, key, base))
        return at[order], key[order], base[order]
    low = np.uint64(bits)
    first = not base.any()
    if first:  # keys of five bytes and no base yet
        packed = np.sort((key << low) | at.astype(np.uint64))
        key = packed >> low
    else:
        packed = np.sort((base.astype(np.uint64) << np.uint64(2 * bits)) | (key << low) | at.astype(np.uint64))
        key = (packed >> low) & np.uint64((1 << bits) - 1)
        base = (packed >> np.uint64(2 * bits)).astype(np.int64)
    return (packed & np.uint64((1 << bits) - 1)).astype(np.int64), key, base


def common_prefixes(data: np.ndarray, left: np.ndarray, order: np.ndarray, new: np.ndarray, depth: int):
    """(position, common prefix with its neighbour in suffix order) of all tied suffixes."""
    if not len(order):
        return order, order
    before = np.empty_like(order)
    before[1:] = order[:-1]
    following = np.append(order[1:], order[-1])
    neighbour = np.where(new, following, before)
    by_text = np.argsort(order)
    at, other = order[by_text], neighbour[by_text]
    head = np.ones(len(at), bool)
    head[1:] = (at[1:] != at[:-1] + 1) | (other[1:] != other[:-1] + 1)
    first = np.flatnonzero(head)
    a, b = at[first], other[first]
    most = np.minimum(left[a], left[b])
    length = np.full(len(a), depth, np.int64)
    words = np.ndarray((len(data),), "<u8", np.concatenate((data, np.zeros(8, np.uint8))).data, 0, (1,))
    live = np.flatnonzero(length + 8 <= most)
    while len(live):
        x, y = words[a[live] + length[live]], words[b[live] + length[live]]
        live = live[x == y]
        length[live] += 8
        live = live[length[live] + 8 <= most[live]]
    for _ in range(8):
        live = np.flatnonzero(length < most)
        live = live[data[a[live] + length[live]] == data[b[live] + length[live]]]
        length[live] += 1
    group = np.cumsum(head) - 1
    return at, length[group] - (at - a[group])


class Shard:
    """The texts of one shard, their block structure and hashes."""

    def __init__(self, rows: pa.Table):
        self.rows = rows
        self.data, self.offsets = arrays.text_bytes(rows.column("text"))
        n = len(self.data)
        size = np.diff(self.offsets)
        self.left = np.repeat(self.offsets[1:], size) - np.arange(n)
        self.hashers = [arrays.Substrings(self.data, lane) for lane in range(2)]
        self._blocks()

    def _anchors(self, valid: np.ndarray) -> np.ndarray:
        """The anchor of the string at each valid start: the last of its least hashed grams."""
        n = len(self.data)
        width = LENGTH - GRAM + 1
        words = np.ndarray((n,), "<u8", np.concatenate((self.data, np.zeros(8, np.uint8))).data, 0, (1,))
        low = np.uint64(max(n, 2).bit_length())
        last = np.uint64((1 << int(low)) - 1)
        code = words * GRAM_FACTOR
        code >>= low
        code <<= low
        code |= np.arange(int(last), int(last) - n, -1).astype(np.uint64)
        rows = -(-n // width) + 1
        square = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
        square[:n] = code
        square = square.reshape(rows, width)
        ahead = np.minimum.accumulate(square, axis=1).ravel()
        behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[valid], ahead[valid + width - 1])
        return (last - (least & last)).astype(np.int64)

    def _blocks(self) -> None:
        valid = np.flatnonzero(self.left >= LENGTH)
        if not len(valid):
            self.first = self.last = self.anchor = self.step = valid
            return
        anchor = self._anchors(valid)
        step = (anchor - valid) // STEP
        cut = np.ones(len(valid), bool)
        cut[1:] = (valid[1:] != valid[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (step[1:] != step[:-1])
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(valid)) - 1
        self.first, self.last = valid[begin], valid[end]
        self.anchor, self.step = anchor[begin], step[begin]

    def hash(self, lane: int, starts: np.ndarray, ends: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return arrays.pair(self.hashers[lane].of(starts, ends), salt.astype(np.uint64))

    def block_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        place = self.anchor - self.first
        return tuple(self.hash(lane, self.first, self.last + LENGTH, place) for lane in range(2))

    def core_hashes(self) -> np.ndarray:
        start = self.anchor - STEP * self.step
        return self.hash(0, start, start + LENGTH - STEP + 1, self.step)

    def string_hashes(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        zero = np.zeros(len(starts), np.int64)
        return tuple(self.hash(lane, starts, starts + LENGTH, zero) for lane in range(2))


def distinct_pairs(a: np.ndarray, b: np.ndarray):
    """Distinct (a, b) in order, and the index of each input pair among them."""
    order = np.lexsort((b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return a[order][new], b[order][new], which


def core_kinds(core: np.ndarray, block: np.ndarray):
    """Distinct cores in order, a block hash of each (0 where it has several), index of each input."""
    cores = arrays.distinct(core)
    which = np.searchsorted(cores, core)
    low = np.full(len(cores), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(cores), np.uint64)
    np.minimum.at(low, which, block)
    np.maximum.at(high, which, block)
    return cores, np.where(low == high, low, np.uint64(0)), which


def ranges(hashes: np.ndarray, n: int):
    """(range, slice) for each non-empty range of sorted hashes."""
    part = ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    cut = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b > a:
            yield int(part[a]), slice(a, b)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _lists(kind: int, number: int, a: np.ndarray, b: np.ndarray, n: int) -> list[tuple]:
    return [(kind, part, number, pack_sorted(a[s]), pack(b[s])) for part, s in ranges(a, n)]


def _send_blocks(n: int):
    def send(rows: pa.Table) -> pa.Table:
        shard, number = Shard(rows), rows.column("bucket")[0].as_py()
        a, b = shard.block_hashes()
        cores, kinds, _ = core_kinds(shard.core_hashes(), a)
        a, b, _ = distinct_pairs(a, b)
        return _table(_lists(BLOCKS, number, a, b, n) + _lists(CORES, number, cores, kinds, n), _SENT)

    return send


def _merge(rows: pa.Table) -> pa.Table:
    """Merge the sorted lists of all shards for one hash range and answer each shard.

    Blocks and strings: one bit says that another shard has it, one that this shard is its first.
    Cores: one bit says that it stands in different blocks.
    """
    kind = rows.column("kind")[0].as_py()
    owners = rows.column("bucket").to_pylist()
    part = rows.column("part")[0].as_py()
    lists = [
        (unpack_sorted(x.as_py(), np.uint64), unpack(y.as_py(), np.uint64))
        for x, y in zip(rows.column("first"), rows.column("second"), strict=True)
    ]
    out = []
    if kind == CORES:
        merged = arrays.distinct(np.concatenate([a for a, _ in lists]))
        low = np.full(len(merged), np.iinfo(np.uint64).max, np.uint64)
        high, several = np.zeros(len(merged), np.uint64), np.zeros(len(merged), bool)
        places = [np.searchsorted(merged, a) for a, _ in lists]
        for (_, b), place in zip(lists, places, strict=True):
            several[place] |= b == 0
            low[place] = np.minimum(low[place], b)
            high[place] = np.maximum(high[place], b)
        several |= low != high
        for owner, place in zip(owners, places, strict=True):
            out.append((owner, part, kind, pack_bits(several[place])))
        return _table(out, _MESSAGE)
    all_a, all_b, which = distinct_pairs(np.concatenate([a for a, _ in lists]), np.concatenate([b for _, b in lists]))
    holders = np.bincount(which, minlength=len(all_a))
    owner_of = np.repeat(np.array(owners), [len(a) for a, _ in lists])
    least = np.full(len(all_a), np.iinfo(np.int64).max)
    np.minimum.at(least, which, owner_of)
    end = 0
    for owner, (a, _) in zip(owners, lists, strict=True):
        own = which[end : end + len(a)]
        end += len(a)
        flags = np.concatenate((holders[own] > 1, least[own] == owner))
        out.append((owner, part, kind, pack_bits(flags)))
    return _table(out, _MESSAGE)


class Answers:
    """What the merges told a shard, by kind and range."""

    def __init__(self, messages: pa.Table):
        columns = (messages.column(c).to_pylist() for c in ("kind", "part", "data"))
        self.data = {(k, p): d for k, p, d in zip(*columns, strict=True)}

    def flags(self, kind: int, hashes: np.ndarray, n: int, rows: int) -> np.ndarray:
        """``rows`` flags of each of the sorted hashes."""
        out = np.zeros((rows, len(hashes)), bool)
        for part, s in ranges(hashes, n):
            size = s.stop - s.start
            out[:, s] = unpack_bits(self.data[kind, part], rows * size).reshape(rows, size)
        return out


def judged_blocks(shard: Shard, answers: Answers, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each block: repeated as a whole; to be looked at string by string here."""
    a, b = shard.block_hashes()
    cores, _, core_of = core_kinds(shard.core_hashes(), a)
    a, b, block_of = distinct_pairs(a, b)
    shared, leads = answers.flags(BLOCKS, a, n, 2)
    several = answers.flags(CORES, cores, n, 1)[0]
    return shared[block_of], several[core_of] & leads[block_of]


def block_starts(shard: Shard, chosen: np.ndarray) -> np.ndarray:
    size = (shard.last - shard.first + 1)[chosen]
    nth = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(shard.first[chosen], size) + nth


def _send_strings(n: int):
    def send(rows: pa.Table, messages: pa.Table) -> pa.Table:
        if rows.num_rows == 0:
            return _table([], _SENT)
        shard, number = Shard(rows), rows.column("bucket")[0].as_py()
        _, open_blocks = judged_blocks(shard, Answers(messages), n)
        a, b, _ = distinct_pairs(*shard.string_hashes(block_starts(shard, open_blocks)))
        return _table(_lists(STRINGS, number, a, b, n), _SENT)

    return send


def removed_bytes(shard: Shard, answers: Answers, n: int) -> np.ndarray:
    """Flags of the bytes that a repeated string covers."""
    total = len(shard.data)
    change = np.zeros(total + 1, np.int64)

    def cover(starts: np.ndarray, ends: np.ndarray) -> None:
        np.add.at(change, starts, 1)
        np.add.at(change, ends, -1)

    order, new = refine(shard.data, shard.left, LENGTH)
    at, length = common_prefixes(shard.data, shard.left, order, new, LENGTH)
    cover(at, at + length)
    shared, open_blocks = judged_blocks(shard, answers, n)
    cover(shard.first[shared], shard.last[shared] + LENGTH)
    starts = block_starts(shard, open_blocks)
    a, b, which = distinct_pairs(*shard.string_hashes(starts))
    again = starts[answers.flags(STRINGS, a, n, 2)[0][which]]
    cover(again, again + LENGTH)
    return np.cumsum(change[:-1]) > 0


def _remove(n: int, schema: pa.Schema):
    def remove(rows: pa.Table, messages: pa.Table) -> pa.Table:
        if rows.num_rows == 0:
            return schema.empty_table()
        shard = Shard(rows)
        gone = removed_bytes(shard, Answers(messages), n)
        edge = np.zeros(len(gone) + 1, bool)
        edge[shard.offsets] = True
        begin = gone.copy()
        begin[1:] &= ~gone[:-1] | edge[1:-1]
        lost = arrays.sums(gone, shard.offsets)
        size = np.diff(shard.offsets)
        ends = np.concatenate(([0], np.cumsum(size - lost)))
        kept = shard.data[~gone].tobytes()
        columns = [
            rows.column("doc_id"),
            pa.array(size),
            pa.array(lost),
            pa.array(arrays.sums(begin, shard.offsets)),
            pa.array([kept[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary()),
        ]
        return pa.table(columns, schema=schema)

    return remove


@dataclass(frozen=True)
class Sizes:
    """What grows with the input: the number of shards and of hash ranges."""

    shards: int
    ranges: int

    @classmethod
    def of(cls, text_bytes: int) -> Sizes:
        shards = max(MIN_SHARDS, -(-text_bytes // SHARD_BYTES))
        return cls(shards, max(MIN_RANGES, shards // SHARDS_PER_RANGE))


def remove_repeated_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the bytes that stay (``kept``) of each row.

    A byte goes if a string of LENGTH bytes that covers it starts anywhere else too, in its own
    document or another; strings are judged on the input, so all copies go. Strings never cross
    documents. A null text is empty; texts shorter than LENGTH lose nothing; repeated rows are
    documents of their own and so repeats of each other. ``kept`` is binary, as a cut may fall
    inside a character. doc_id must be an integer; extra columns are left aside.
    """
    rows = docs.select("doc_id", "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sizes = Sizes.of(int(total))
    # The text decides too, so that rows with one id or none do not meet in one shard.
    spread = F.xxhash64("doc_id", F.substring("text", 1, 256))
    placed = rows.withColumn("bucket", F.pmod(spread, F.lit(sizes.shards)).cast("int"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = {"int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(kind, pa.int64())
    counts = [(c, pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")]
    schema = pa.schema([("doc_id", id_type), *counts, ("kept", pa.binary())])
    n = sizes.ranges
    blocks = placed.groupBy("bucket").applyInArrow(_send_blocks(n), SENT)
    verdicts = blocks.groupBy("kind", "part").applyInArrow(_merge, MESSAGE)
    strings = placed.groupBy("bucket").cogroup(verdicts.groupBy("bucket")).applyInArrow(_send_strings(n), SENT)
    answers = verdicts.unionByName(strings.groupBy("kind", "part").applyInArrow(_merge, MESSAGE))
    result = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
    return placed.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_remove(n, schema), result)
