"""Removal of word passages that occurred before, with a count-min prefilter.

A passage is a window of consecutive words. Documents are dealt to buckets by a hash of their id.

1. Each bucket puts its windows into a count-min sketch: two rows of cells, with counts up to two.
   The sketches are cut into blocks of cells, and equal blocks of all buckets are merged. The rows
   are about four cells per window wide at any input size, so a sketch is sparse and travels as
   compressed cell differences. Back to each bucket goes one bit per cell: counted twice or not.
2. A window whose cells all count twice is estimated repeated; no repeated window is lost. Each
   bucket sends every such window once, as 128 hash bits with the least document it has there, and
   the groups of equal windows are resolved exactly. Back goes one bit per window: the bucket holds
   the first occurrence or not.
3. Each bucket removes the words of all windows but the first occurrences.

The three steps share one shuffle of the texts. A bucket holds a few MB of text whatever the input
size; a passage in very many documents sends one row per bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowguard.llm import arrays
from windowguard.llm.packing import pack, pack_bits, pack_sorted, unpack, unpack_bits, unpack_sorted

WINDOW = 20
BUCKET_BYTES = 2 << 20
MIN_BUCKETS = 64
ROWS = 2
BLOCK_BITS = 22
#: Cells of a sketch row per byte of text; a word takes about six bytes.
CELLS_PER_BYTE = 0.6
NO_ID = np.iinfo(np.int64).min

MESSAGE = "bucket int, part int, kind int, data binary"
PAYLOAD = "part int, bucket int, first binary, second binary, docs binary"


@dataclass(frozen=True)
class Sizes:
    """What grows with the input: buckets, bits of a cell number, ranges of the exact step."""

    buckets: int
    cell_bits: int
    window: int

    @classmethod
    def of(cls, text_bytes: int, window: int) -> Sizes:
        buckets = max(MIN_BUCKETS, -(-text_bytes // BUCKET_BYTES))
        cells = max(1, int(text_bytes * CELLS_PER_BYTE))
        return cls(buckets, max(BLOCK_BITS, cells.bit_length()), window)


class Bucket:
    """The windows of one bucket, in the order (doc_id, text, position); null ids come first."""

    def __init__(self, rows: pa.Table, window: int):
        ids = rows.column("doc_id").fill_null(NO_ID).to_numpy()
        texts = rows.column("text")
        if len(np.unique(ids)) < len(ids):
            order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i].as_py() or "")), np.int64)
        else:
            order = np.argsort(ids, kind="stable")
        self.rows = rows.take(pa.array(order))
        self.ids = ids[order]
        self.data, offsets = arrays.text_bytes(self.rows.column("text"))
        self.starts, self.ends, self.first = arrays.spans(self.data, offsets, ~arrays.WHITE)
        self.at = arrays.within(self.first, window, len(self.starts))
        self.key = self._hashes(0, window)
        self.window = window

    def _hashes(self, lane: int, window: int) -> np.ndarray:
        words = arrays.span_hashes(self.data, self.starts, self.ends, lane)
        return arrays.window_hashes(words, window)[self.at]

    def cells(self, row: int, bits: int) -> np.ndarray:
        seed = np.uint64((row + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        return arrays.mix(self.key ^ seed) >> np.uint64(64 - bits)

    def estimated(self, sizes: Sizes, answers: dict[int, bytes]) -> np.ndarray:
        """Indices of the windows whose cells all count twice or more."""
        alive = np.arange(len(self.key))
        for row in range(ROWS):
            cells = self.cells(row, sizes.cell_bits)
            single = arrays.distinct(cells)
            flags = [np.zeros(0, bool)]
            for block, part in blocks(single, sizes.cell_bits):
                flags.append(unpack_bits(answers[row << 32 | block], len(part)))
            hot = single[np.concatenate(flags)]
            if not len(hot):
                return alive[:0]
            own = cells[alive]
            alive = alive[hot[np.minimum(np.searchsorted(hot, own), len(hot) - 1)] == own]
        return alive

    def groups(self, alive: np.ndarray):
        """Distinct estimated windows, sorted by hash: both hashes, first index, and group of each."""
        a, b = self.key[alive], self._hashes(1, self.window)[alive]
        order = np.lexsort((alive, b, a))
        new = np.ones(len(order), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        head = order[new]
        return a[head], b[head], alive[head], group

    def doc_of(self, windows: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.first, self.at[windows], "right") - 1]


def blocks(cells: np.ndarray, bits: int):
    """The non-empty blocks of sorted cells."""
    number = (cells >> np.uint64(BLOCK_BITS)).astype(np.int64)
    cut = np.flatnonzero(np.diff(number)) + 1
    for part in np.split(cells, cut):
        if len(part):
            yield int(part[0]) >> BLOCK_BITS, part


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_MESSAGE = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
_PAYLOAD = pa.schema(
    [("part", pa.int32()), ("bucket", pa.int32()), ("first", pa.binary()), ("second", pa.binary()), ("docs", pa.binary())]
)


def _sketch(sizes: Sizes):
    def make(rows: pa.Table) -> pa.Table:
        bucket = Bucket(rows, sizes.window)
        number = rows.column("bucket")[0].as_py()
        out = []
        for row in range(ROWS):
            cells = np.sort(bucket.cells(row, sizes.cell_bits))
            more = np.ones(len(cells), bool)
            more[2:] = cells[2:] != cells[:-2]  # counts up to two
            for block, part in blocks(cells[more], sizes.cell_bits):
                low = (part & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.uint32)
                out.append((number, block, row, pack_sorted(low)))
        return _table(out, _MESSAGE)

    return make


def _merge_sketch(rows: pa.Table) -> pa.Table:
    """Sum one block over all buckets; tell each bucket which of its cells count twice or more."""
    counts = np.zeros(1 << BLOCK_BITS, np.uint8)
    held = []
    for data in rows.column("data"):
        cells = unpack_sorted(data.as_py(), np.uint32)  # each once, or twice for a count of two
        new = np.ones(len(cells), bool)
        new[1:] = cells[1:] != cells[:-1]
        single = cells[new]
        own = np.diff(np.append(np.flatnonzero(new), len(cells))).astype(np.uint8)
        counts[single] = np.minimum(2, counts[single] + own)
        held.append(single)
    out = []
    for i, cells in enumerate(held):
        key = (rows.column("bucket")[i].as_py(), rows.column("part")[i].as_py(), rows.column("kind")[i].as_py())
        out.append((*key, pack_bits(counts[cells] >= 2)))
    return _table(out, _MESSAGE)


def _answers(rows: pa.Table) -> tuple[dict[int, bytes], dict[int, bytes]]:
    cells, exact = {}, {}
    for part, kind, data in zip(*(rows.column(c).to_pylist() for c in ("part", "kind", "data")), strict=True):
        if kind < ROWS:
            cells[kind << 32 | part] = data
        else:
            exact[part] = data
    return cells, exact


def _ranges(hashes: np.ndarray, n: int):
    """(range, slice) for each non-empty range of sorted hashes."""
    part = ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    cut = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b > a:
            yield int(part[a]), slice(a, b)


def _send_repeated(sizes: Sizes):
    def send(rows: pa.Table, messages: pa.Table) -> pa.Table:
        if rows.num_rows == 0:
            return _table([], _PAYLOAD)
        bucket = Bucket(rows, sizes.window)
        number = rows.column("bucket")[0].as_py()
        a, b, head, _ = bucket.groups(bucket.estimated(sizes, _answers(messages)[0]))
        docs = bucket.doc_of(head)
        out = [
            (part, number, pack_sorted(a[s]), pack(b[s]), pack(docs[s])) for part, s in _ranges(a, sizes.buckets)
        ]
        return _table(out, _PAYLOAD)

    return send


def _resolve(rows: pa.Table) -> pa.Table:
    """Group equal windows of one hash range; tell each bucket where it does not hold the first."""
    owners = rows.column("bucket").to_numpy()
    unpacked = [
        (unpack_sorted(x.as_py(), np.uint64), unpack(y.as_py(), np.uint64), unpack(z.as_py(), np.int64))
        for x, y, z in zip(rows.column("first"), rows.column("second"), rows.column("docs"), strict=True)
    ]
    size = [len(u[0]) for u in unpacked]
    a, b, docs = (np.concatenate([u[i] for u in unpacked]) for i in range(3))
    owner = np.repeat(owners, size)
    order = np.lexsort((owner, docs, b, a))
    repeat = np.zeros(len(order), bool)
    repeat[order[1:]] = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    out = []
    ends = np.cumsum(size)
    for i, end in enumerate(ends.tolist()):
        flags = repeat[end - size[i] : end]
        out.append((int(owners[i]), rows.column("part")[i].as_py(), ROWS, pack_bits(flags)))
    return _table(out, _MESSAGE)


def _remove(sizes: Sizes, id_type: pa.DataType):
    def remove(rows: pa.Table, messages: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", id_type), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])
        if rows.num_rows == 0:
            return _table([], schema)
        bucket = Bucket(rows, sizes.window)
        cells, exact = _answers(messages)
        alive = bucket.estimated(sizes, cells)
        a, _, head, group = bucket.groups(alive)
        elsewhere = np.zeros(len(a), bool)
        for part, s in _ranges(a, sizes.buckets):
            elsewhere[s] = unpack_bits(exact[part], s.stop - s.start)
        gone = elsewhere[group] | (head[group] != alive)
        total = len(bucket.starts)
        removed = arrays.covered(bucket.at[alive[gone]], sizes.window, total)
        words = np.diff(bucket.first)
        lost = arrays.sums(removed, bucket.first)
        texts = kept_texts(bucket, ~removed)
        return pa.table([bucket.rows.column("doc_id"), pa.array(words), pa.array(lost), texts], schema=schema)

    return remove


def kept_texts(bucket: Bucket, keep: np.ndarray) -> pa.Array:
    """The kept words of each document, joined by one space."""
    length = bucket.ends - bucket.starts
    joined = np.full(int(length.sum()) + len(length), 32, np.uint8)
    ends = np.cumsum(length + 1)
    inside = np.ones(len(joined), bool)
    inside[ends - 1] = False
    joined[inside] = bucket.data[~arrays.WHITE[bucket.data]]
    # A space stays after each kept word that another kept word of the document follows.
    owner = np.repeat(np.arange(len(bucket.first) - 1), np.diff(bucket.first))
    some = np.flatnonzero(keep)
    last = np.ones(len(some), bool)
    last[:-1] = owner[some][1:] != owner[some][:-1]
    stay = np.repeat(keep, length + 1)
    stay[ends[some[last]] - 1] = False
    data = joined[stay].tobytes()
    kept_bytes = np.where(keep, length + 1, 0)
    kept_bytes[some[last]] -= 1
    offsets = np.concatenate(([0], np.cumsum(arrays.sums(kept_bytes, bucket.first))))
    large = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))
    return large.cast(pa.string())


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and the remaining ``text`` (words joined by one space) of each row.

    A word goes if a window of ``window`` words that covers it starts with the same words at an
    earlier place: a smaller doc_id, or the same document further up. Windows are judged on the
    input. Rows of one doc_id are taken in the order of their texts, rows without one come before
    all others. Null texts have no words; texts shorter than a window lose nothing; repeated rows
    are documents of their own. doc_id must be an integer; extra columns are left aside.
    """
    rows = docs.select("doc_id", "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sizes = Sizes.of(int(total), window)
    # Rows without an id must not meet in one bucket.
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = {"int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(kind, pa.int64())
    placed = rows.withColumn("bucket", F.pmod(spread, F.lit(sizes.buckets)).cast("int"))
    bucketed = placed.groupBy("bucket")
    sketch = bucketed.applyInArrow(_sketch(sizes), MESSAGE)
    cells = sketch.groupBy("kind", "part").applyInArrow(_merge_sketch, MESSAGE)
    payload = placed.groupBy("bucket").cogroup(cells.groupBy("bucket")).applyInArrow(_send_repeated(sizes), PAYLOAD)
    exact = payload.groupBy("part").applyInArrow(_resolve, MESSAGE)
    messages = cells.unionByName(exact)
    result = f"doc_id {kind}, n_words long, n_removed long, text string"
    return placed.groupBy("bucket").cogroup(messages.groupBy("bucket")).applyInArrow(_remove(sizes, id_type), result)
