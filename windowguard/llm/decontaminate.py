"""Benchmark passages in documents by Wu-Manber search over words.

The patterns are windows of test words (a short item is one pattern of its own length). A shift
table over blocks of two words says how far the search may jump; where it says zero, the hash of
the pattern's last words selects the patterns to compare, and comparing the words themselves
confirms an occurrence. All lanes (stretches of documents) of a batch are searched in step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from windowguard.llm import arrays
from windowguard.llm.frames import fresh
from windowguard.session import stage

WINDOW = 10
BLOCK = 2
SUFFIX = 5
LANE_WORDS = 256
TABLE_BITS = 18
#: Test text of one pass; its patterns take some sixty times as much memory in a worker.
PATTERN_BYTES = 1 << 20
WORD = np.zeros(256, bool)
WORD[48:58] = True
WORD[97:123] = True
WORD[128:] = True


class Patterns:
    """Patterns of one length with their shift table and suffix buckets."""

    def __init__(self, words: list[tuple[bytes, ...]], owners: list[list[int]]):
        self.length = len(words[0])
        self.words, self.owners = words, owners
        self.block = min(BLOCK, self.length)
        flat = [w for row in words for w in row]
        hashes = word_hashes(flat).reshape(len(words), self.length)
        self.shift = np.full(1 << TABLE_BITS, self.length - self.block + 1, np.uint16)
        for end in range(self.block, self.length + 1):
            cells = table_cell(arrays.window_hashes_2d(hashes[:, end - self.block : end]))
            np.minimum.at(self.shift, cells, self.length - end)
        self.tail = min(SUFFIX, self.length)
        suffix = arrays.window_hashes_2d(hashes[:, self.length - self.tail :])
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.order = suffix[order], order

    def search(self, hashes: np.ndarray, lanes: np.ndarray, ends: np.ndarray):
        """Candidate (start, pattern rank) pairs in the word ranges lanes:ends."""
        m, b = self.length, self.block
        blocks = table_cell(arrays.window_hashes(hashes, b))
        at = lanes + m - 1  # last word of the window under test
        limit = ends
        live = at < limit
        at, limit = at[live], limit[live]
        found = []
        while len(at):
            jump = self.shift[blocks[at - b + 1]]
            stop = jump == 0
            if stop.any():
                found.append(at[stop] - m + 1)
            at = at + np.maximum(jump, 1)
            live = at < limit
            at, limit = at[live], limit[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts = np.sort(np.concatenate(found))
        tails = arrays.window_hashes_2d(hashes[starts[:, None] + np.arange(m - self.tail, m)])
        low, high = np.searchsorted(self.suffix, tails, "left"), np.searchsorted(self.suffix, tails, "right")
        some = high > low
        return starts[some], low[some], high[some]


def table_cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return arrays.span_hashes(data, ends - np.array([len(w) for w in words]), ends)


def split_words(column: pa.Array):
    """Lower-cased bytes, word starts and ends, first word of each value."""
    data, offsets = arrays.text_bytes(column)
    data = arrays.LOWER[data]
    return data, *arrays.spans(data, offsets, WORD)


def compile_patterns(items: pa.Table, window: int = WINDOW) -> tuple[list[Patterns], list]:
    """One search structure per pattern length; the items in a fixed order."""
    ids = items.column("item_id").to_pylist()
    data, starts, ends, first = split_words(items.column("text"))
    raw = data.tobytes()
    words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    known: dict[tuple[bytes, ...], set[int]] = {}
    for item in range(len(ids)):
        own = words[first[item] : first[item + 1]]
        for start in range(max(1, len(own) - window + 1) if own else 0):
            known.setdefault(tuple(own[start : start + window]), set()).add(item)
    by_length: dict[int, list] = {}
    for pattern, owners in known.items():
        by_length.setdefault(len(pattern), []).append((pattern, sorted(owners)))
    made = [Patterns([p for p, _ in rows], [o for _, o in rows]) for _, rows in sorted(by_length.items())]
    return made, ids


def scan(column: pa.Array, patterns: list[Patterns]):
    """Per value: number of words, hit runs [first, last), indices of the items found."""
    data, starts, ends, first = split_words(column)
    raw, total = data.tobytes(), len(starts)
    hashes = arrays.span_hashes(data, starts, ends)
    hit = np.zeros(total + 1, np.int32)
    items: list[set[int]] = [set() for _ in range(len(first) - 1)]
    for group in patterns:
        m = group.length
        lanes, stops = lane_bounds(first, m)
        at, low, high = group.search(hashes, lanes, stops)
        value = np.searchsorted(first, at, "right") - 1
        for start, a, b, v in zip(at.tolist(), low.tolist(), high.tolist(), value.tolist(), strict=True):
            text = tuple(raw[x:y] for x, y in zip(starts[start : start + m].tolist(), ends[start : start + m].tolist(), strict=True))
            for rank in range(a, b):
                pattern = group.order[rank]
                if group.words[pattern] == text:
                    hit[start] += 1
                    hit[start + m] -= 1
                    items[v].update(group.owners[pattern])
    flags = np.cumsum(hit[:-1]) > 0
    return first, flags, items


def lane_bounds(first: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut each value's word range into lanes of LANE_WORDS window starts."""
    count = np.maximum(0, first[1:] - first[:-1] - m + 1)
    n = -(-count // LANE_WORDS)
    value = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(value)) - np.repeat(np.cumsum(n) - n, n)
    lanes = first[:-1][value] + nth * LANE_WORDS
    return lanes, np.minimum(lanes + LANE_WORDS + m - 1, first[1:][value])


def runs(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [{"first": a, "last": b} for a, b in edge.reshape(-1, 2).tolist()]


def merge_runs(old: list[dict] | None, new: list[dict]) -> list[dict]:
    out: list[dict] = []
    for run in sorted((old or []) + new, key=lambda r: (r["first"], r["last"])):
        if out and run["first"] <= out[-1]["last"]:
            out[-1]["last"] = max(out[-1]["last"], run["last"])
        else:
            out.append(dict(run))
    return out


def pattern_blocks(spark, benchmark: DataFrame, limit: int) -> Iterator[pa.Table]:
    """The distinct items in blocks of about ``limit`` bytes each, one block at a time.

    An item longer than the limit is a block of its own.
    """
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, -(-int(total) // limit))
    if n > 1:
        items = stage(items.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), "items")
    for block in range(n):
        part = items if n == 1 else items.where(F.col("_block") == block).drop("_block")
        yield part.toArrow()


def find_passages(
    docs: DataFrame, benchmark: DataFrame, name: str, window: int = WINDOW, limit: int = PATTERN_BYTES
) -> DataFrame:
    """Add a struct column ``name`` (n_words, hits, items) to each document.

    ``hits`` are the runs of words inside any occurrence, ``items`` the distinct ids of items that
    occur. Texts are lower-cased (A-Z) and taken as words of digits, letters and non-ASCII bytes.
    A null or empty text has no words. Items without words occur nowhere; the rows of
    one item_id are one item, found if any of their texts occurs; a null id stays a null. With no items nothing is hit. Repeated documents are
    judged one by one; columns of any other name pass through untouched.

    Patterns are broadcast in blocks of at most ``limit`` bytes of test text, one pass over the
    documents for each, so a benchmark of any size fits.
    """
    spark = docs.sparkSession
    kind = benchmark.schema["item_id"].dataType
    found = docs
    for number, items in enumerate(pattern_blocks(spark, benchmark, limit)):
        if number:
            found = stage(found, "passages")
        shared = spark.sparkContext.broadcast(compile_patterns(items, window))
        found = _search(found, shared, kind, name)
    return found


def _search(docs: DataFrame, shared, kind: T.DataType, name: str) -> DataFrame:
    """One pass; adds to the findings of an earlier pass if there was one."""
    again = name in docs.columns
    kept = [c for c in docs.columns if c != name]
    result = T.StructType.fromDDL("n_words long, hits array<struct<first:long,last:long>>")
    result = result.add("items", T.ArrayType(kind))
    schema = T.StructType([f for f in docs.schema if f.name in kept] + [T.StructField(name, result)])
    arrow_type = to_arrow_type(result)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, ids = shared.value
        for batch in batches:
            for piece in arrays.pieces(batch, "text"):
                first, flags, items = scan(piece.column("text"), patterns)
                old = piece.column(name).to_pylist() if again else [None] * piece.num_rows
                rows = []
                for i, before in enumerate(old):
                    hits = runs(flags[first[i] : first[i + 1]])
                    names = [ids[x] for x in sorted(items[i])]
                    if before:
                        hits = merge_runs(before["hits"], hits)
                        names = before["items"] + names
                    names = list(dict.fromkeys(names))  # an id may have several texts
                    rows.append({"n_words": int(first[i + 1] - first[i]), "hits": hits, "items": names})
                columns = [piece.column(c) for c in kept] + [pa.array(rows, arrow_type)]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, name])

    return docs.mapInArrow(search, schema)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: words, hit words, items found and their digest, and the verdict."""
    found = find_passages(docs.select("doc_id", "text"), benchmark, "_found", window).select("doc_id", "_found")
    hit = F.aggregate("_found.hits", F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"])
    names = F.array_sort(F.transform("_found.items", lambda i: F.coalesce(i.cast("string"), F.lit("None"))))
    return found.select(
        "doc_id",
        F.col("_found.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("_found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no test window occurs, with their own columns."""
    name = fresh(docs, "found")
    found = find_passages(docs, benchmark, name, window)
    return found.where(F.size(F.col(f"{name}.hits")) == 0).drop(name)
