"""Ranked lexical search by Block-Max MaxScore over an index that is cut into shards of documents.

A shard is some MB of neighbouring documents. For each term it holds blocks of postings, packed as
variable-length integers, and beside each block the outermost (tf, document length) pairs, from
which the block's highest score follows exactly for any statistics of the whole table. A query's lists are
ordered by their global bounds: those whose bounds together cannot reach the tenth best score are not
essential, only the others propose documents. On the rest, block maxima reject proposals before a
block is unpacked. The heaps of a task's shards are merged as it goes, then those of all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from windowguard.llm import arrays
from windowguard.llm.span_table import first_equal
from windowguard.session import stage

#: Text of one shard.
SHARD_BYTES = 8 << 20
BLOCK = 64
#: Documents whose essential lists are added up before the heap is asked again.
SPAN = 2048
ROWS_OUT = 8192
#: Text of the queries that one pass over the index takes.
QUERY_BYTES = 1 << 20

TERM = np.zeros(256, bool)
TERM[48:58] = True
TERM[65:91] = True
TERM[97:123] = True
TERM[128:] = True

#: Fixed values of the ranking function, in thousandths where it has fractions.
TOP = 1_000_000_000
K1_B, K1_REST, DOUBLE_K1 = 90, 10, 8


def split_terms(column: pa.Array):
    """Lower-cased bytes, term starts and ends, first term of each value."""
    data, offsets = arrays.text_bytes(column)
    data = arrays.LOWER[data]
    return data, *arrays.spans(data, offsets, TERM)


def impact(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A posting's score without its term's weight; grows with tf and falls with the length."""
    m = K1_REST + (K1_B * length * n_docs) // n_terms
    return (TOP * tf) // (1000 * tf + DOUBLE_K1 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def pack_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2^35 in groups of seven bits, low ones first; the bytes, and how many each takes."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 5):
        size += values >= 1 << (7 * k)
    out = np.zeros(int(size.sum()), np.uint8)
    start = np.cumsum(size) - size
    for k in range(int(size.max()) if len(size) else 0):
        rows = np.flatnonzero(size > k)
        more = (size[rows] > k + 1) * 128
        out[start[rows] + k] = ((values[rows] >> (7 * k)) & 127) + more
    return out, size


def unpack_numbers(data: np.ndarray) -> np.ndarray:
    last = data < 128
    end = np.flatnonzero(last)
    start = np.concatenate(([0], end[:-1] + 1)) if len(end) else end
    low = (data & 127).astype(np.int64)
    place = np.arange(len(data)) - np.repeat(start, end - start + 1)
    return np.add.reduceat(low << (7 * place), start) if len(end) else low


def outermost(block: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The postings that no other of their block beats in both tf and length, by block."""
    order = np.lexsort((length, -tf, block))
    # Blocks get falling ranges of values, so that a running minimum starts anew with each.
    drop = length.max() + 1
    value = length[order] - block[order] * drop
    least = np.minimum.accumulate(value)
    keep = np.ones(len(order), bool)
    keep[1:] = value[1:] < least[:-1]
    return order[keep]


class Shard:
    """Collects documents and then gives the rows of their index."""

    def __init__(self, number: int):
        self.number, self.size = number, 0
        self.terms: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.ids: list[pa.Array] = []
        self.lengths: list[np.ndarray] = []
        self.documents = 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        data, starts, ends, first = split_terms(texts)
        holder = first_equal(data, starts, ends)
        new = np.flatnonzero(holder == np.arange(len(holder)))
        raw, known = data.tobytes(), self.terms
        number = np.zeros(len(holder), np.int64)
        number[new] = [known.setdefault(raw[a:b], len(known)) for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
        document = np.repeat(np.arange(len(first) - 1), np.diff(first))
        wide = np.int64(len(known) + 1)
        pairs = np.sort(document * wide + number[holder])
        edge = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1]))) if len(pairs) else np.zeros(0, np.int64)
        tf = np.diff(np.concatenate((edge, [len(pairs)])))
        pairs = pairs[edge]
        self.parts.append((pairs % wide, pairs // wide + self.documents, tf))
        self.ids.append(ids)
        self.lengths.append(np.diff(first).astype(np.int64))
        self.documents += len(first) - 1
        self.size += len(data)

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """One row of the documents, then the rows of the terms."""
        length = np.concatenate(self.lengths)
        ids = pa.concat_arrays(self.ids)
        listed = pa.ListArray.from_arrays([0, len(ids)], ids, type=schema.field("doc_ids").type)
        sizes = pa.ListArray.from_arrays([0, len(length)], pa.array(length, pa.int64()), type=schema.field("lengths").type)
        number = pa.array([self.number], pa.int64())
        blank = [pa.nulls(1, schema.field(n).type) for n in ("term", "df", "blocks", "outer", "postings")]
        yield pa.RecordBatch.from_arrays([number, *blank, listed, sizes], schema=schema)
        if not self.terms:
            return
        term, doc, tf = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(term, kind="stable")  # documents stay ascending within a term
        term, doc, tf = term[order], doc[order], tf[order]
        first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
        df = np.diff(np.concatenate((first, [len(term)])))
        place = np.arange(len(term)) - np.repeat(first, df)
        opens = np.flatnonzero(place % BLOCK == 0)
        block = np.cumsum(place % BLOCK == 0) - 1
        gap = np.diff(doc, prepend=0)
        gap[opens] = 0  # a block's first document stands beside it
        packed, size = pack_numbers(np.stack((gap, tf), 1).ravel())
        ends = np.add.reduceat(size, 2 * opens)
        best = outermost(block, tf, length[doc])
        meta = np.stack((doc[opens], doc[np.append(opens[1:], len(doc)) - 1], ends, np.bincount(block[best], minlength=len(opens))), 1)
        outer = np.stack((tf[best], length[doc[best]]), 1)
        n_blocks = -(-df // BLOCK)
        cut_blocks = np.concatenate(([0], np.cumsum(n_blocks)))
        cut_outer = np.concatenate(([0], np.cumsum(meta[:, 3])))[cut_blocks]
        cut_bytes = np.concatenate(([0], np.cumsum(ends)))[cut_blocks]
        names = pa.array([t.decode("utf-8", "replace") for t in self.terms], pa.string())
        columns = [
            pa.array(np.full(len(df), self.number)),
            names,
            pa.array(df),
            _binaries(meta.astype("<i4"), 16 * cut_blocks),
            _binaries(outer.astype("<i4"), 8 * cut_outer),
            _binaries(packed, cut_bytes),
            pa.nulls(len(df), schema.field("doc_ids").type),
            pa.nulls(len(df), schema.field("lengths").type),
        ]
        table = pa.RecordBatch.from_arrays(columns, schema=schema)
        for at in range(0, table.num_rows, ROWS_OUT):
            yield table.slice(at, ROWS_OUT)


def _binaries(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())]
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, buffers)


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of all documents, written once: rows of terms, and one row per shard for its documents.

    Columns: shard; for a term: term, df, blocks (first and last document, bytes, outermost pairs),
    outer (tf, length), postings; for the documents of a shard (term is null): doc_ids, lengths.
    A null or empty text has no terms; repeated rows and ids are documents of their own; other
    columns are left aside; no documents give no rows. A shard holds a task's texts up to ``shard_bytes``,
    or one longer piece of at least a row. Statistics of the whole table are no part of the index,
    so shards of further documents can be added.
    """
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType.fromDDL("shard long, term string, df long, blocks binary, outer binary, postings binary")
    schema = schema.add("doc_ids", T.ArrayType(kind)).add("lengths", T.ArrayType(T.LongType()))
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        shard = Shard(number)
        for batch in batches:
            for piece in arrays.pieces(batch, "text"):
                shard.add(piece.column("doc_id"), piece.column("text"))
                if shard.size >= shard_bytes:
                    yield from shard.rows(arrow)
                    number += 1
                    shard = Shard(number)
        if shard.documents:
            yield from shard.rows(arrow)

    return stage(docs.select("doc_id", "text").mapInArrow(build, schema), "index")


def query_terms(queries: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each query, over all rows of its id."""
    item = queries.schema["item_id"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, ends, first = split_terms(batch.column("text"))
            raw = data.tobytes()
            terms = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            owner = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(first)))
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(owner), pa.array(terms, pa.string())], names=["item_id", "term"])

    schema = T.StructType([item, T.StructField("term", T.StringType())])
    return queries.select("item_id", "text").mapInArrow(split, schema).distinct()


@dataclass
class Posting:
    """One list of a shard with a query's weight: bounds of its blocks, unpacked only on demand."""

    first: np.ndarray
    last: np.ndarray
    top: np.ndarray  # highest impact by block
    cuts: np.ndarray
    data: np.ndarray
    bound: int = 0

    @classmethod
    def read(cls, blocks: bytes, outer: bytes, postings: bytes, n_docs: int, n_terms: int) -> Posting:
        meta = np.frombuffer(blocks, "<i4").reshape(-1, 4).astype(np.int64)
        pairs = np.frombuffer(outer, "<i4").reshape(-1, 2).astype(np.int64)
        impacts = impact(pairs[:, 0], pairs[:, 1], n_docs, n_terms)
        top = np.maximum.reduceat(impacts, np.cumsum(meta[:, 3]) - meta[:, 3])
        cuts = np.concatenate(([0], np.cumsum(meta[:, 2])))
        return cls(meta[:, 0], meta[:, 1], top, cuts, np.frombuffer(postings, np.uint8), int(top.max()))

    def unpack(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and tf of the blocks low:high."""
        numbers = unpack_numbers(self.data[self.cuts[low] : self.cuts[high]]).reshape(-1, 2)
        count = np.full(high - low, BLOCK)
        count[-1] = len(numbers) - BLOCK * (high - low - 1)  # only a list's last block may be short
        doc = np.cumsum(numbers[:, 0])
        begin = np.cumsum(count) - count
        return doc + np.repeat(self.first[low:high] - doc[begin], count), numbers[:, 1]


class ShardSearch:
    """Searches the lists of one shard."""

    def __init__(self, lists: dict[str, Posting], lengths: np.ndarray, n_docs: int, n_terms: int):
        self.lists, self.lengths = lists, lengths
        self.n_docs, self.n_terms = n_docs, n_terms
        self.impacts: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}

    def block(self, term: str, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of the blocks low:high of a term."""
        doc, tf = self.lists[term].unpack(low, high)
        return doc, impact(tf, self.lengths[doc], self.n_docs, self.n_terms)

    def best(self, weights: dict[str, int], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the k best, with their scores; those below ``floor`` are not.

        ``floor`` is the k-th best score known from elsewhere, 0 if there is none yet. Documents that
        tie with it are kept, as their ids decide.
        """
        mine = sorted((t for t in weights if t in self.lists and weights[t] > 0), key=lambda t: (weights[t] * self.lists[t].bound, t))
        bounds = np.array([weights[t] * self.lists[t].bound for t in mine], np.int64)
        upto = np.concatenate(([0], np.cumsum(bounds)))
        found_docs, found_scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        floor = max(floor, 1)
        for start in range(0, len(self.lengths), SPAN):
            stop = min(start + SPAN, len(self.lengths))
            # The lists below this one cannot lift a document to the floor by themselves.
            essential = int(np.searchsorted(upto, floor, "left")) - 1
            if essential >= len(mine):
                break
            score = np.zeros(stop - start, np.int64)
            for term in mine[essential:]:
                doc, value = self.reach(term, start, stop)
                score[doc - start] += weights[term] * value
            live = np.flatnonzero(score)
            for i in range(essential - 1, -1, -1):
                live = live[score[live] + upto[i + 1] >= floor]
                if not len(live):
                    break
                self.add(mine[i], weights[mine[i]], start, score, live, floor - int(upto[i]))
            live = live[score[live] >= floor]
            if len(live):
                found_docs.append(live + start)
                found_scores.append(score[live])
                scores = np.concatenate(found_scores)
                if len(scores) >= k:
                    floor = max(floor, int(np.partition(scores, -k)[-k]))
        docs, scores = np.concatenate(found_docs), np.concatenate(found_scores)
        keep = scores >= floor
        return docs[keep], scores[keep]

    def reach(self, term: str, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a term within [start, stop)."""
        held = self.impacts.get((term, start))
        if held is None:
            own = self.lists[term]
            low, high = int(np.searchsorted(own.last, start)), int(np.searchsorted(own.first, stop))
            if low >= high:
                held = np.zeros(0, np.int64), np.zeros(0, np.int64)
            else:
                doc, value = self.block(term, low, high)
                inside = slice(*np.searchsorted(doc, (start, stop)))
                held = doc[inside], value[inside]
            self.impacts[term, start] = held
        return held

    def add(self, term: str, factor: int, start: int, score: np.ndarray, live: np.ndarray, needed: int) -> None:
        """Add a list to the live documents that its block maxima can still lift to ``needed``."""
        own, held = self.lists[term], self.impacts.get((term, start))
        if held is None:
            doc = live + start
            at = np.searchsorted(own.last, doc)
            inside = at < len(own.last)
            inside[inside] = own.first[at[inside]] <= doc[inside]
            at, doc = at[inside], doc[inside]
            can = score[doc - start] + factor * own.top[at] >= needed
            if not can.any():
                return
            wanted = np.unique(at[can])
            if len(wanted) * 2 >= np.searchsorted(own.first, start + len(score)) - np.searchsorted(own.last, start):
                held = self.reach(term, start, start + len(score))
            else:
                parts = [self.block(term, b, b + 1) for b in wanted.tolist()]
                held = np.concatenate([d for d, _ in parts]), np.concatenate([v for _, v in parts])
                inside = slice(*np.searchsorted(held[0], (start, start + len(score))))
                held = held[0][inside], held[1][inside]
        score[held[0] - start] += factor * held[1]


def search(index: DataFrame, benchmark: DataFrame, k: int = 10, limit: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item, equal scores by doc_id.

    The rows of one item_id are one query, so are those without an id; its terms count once each.
    Items without terms, or whose terms no document holds with a weight above zero, have no rows. Of documents
    with one id each has its own rank; null ids come last. Queries are broadcast in blocks of about
    ``limit`` bytes of text, one pass over the lists of their terms for each.
    """
    size = index.where(F.col("term").isNull()).select(F.explode("lengths").alias("n")).where("n > 0")
    n_docs, n_terms = (int(x or 0) for x in size.agg(F.count("*"), F.sum("n")).first())
    terms = query_terms(benchmark)
    total = terms.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    df = index.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    terms = stage(terms.join(df, "term"), "query-terms")
    blocks = max(1, -(-int(total) // limit))
    place = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = []
    for number in range(blocks):
        part = terms if blocks == 1 else terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number)
        best = _pass(index, part, n_docs, n_terms, k)
        ranked.append(best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k))
    return reduce(DataFrame.unionByName, ranked).select("item_id", "rank", "doc_id", "score")


def _pass(index: DataFrame, terms: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item_id, doc_id, score: the k best of every task for the items of one block of queries."""
    queries: dict = {}
    for row in terms.toLocalIterator():  # one block of queries
        queries.setdefault(row["item_id"], {})[row["term"]] = weight(n_docs, row["df"])
    shared = index.sparkSession.sparkContext.broadcast(queries)
    wanted = terms.select("term").distinct()
    rows = index.join(wanted, "term", "left_semi").unionByName(index.where(F.col("term").isNull()))
    kind = index.schema["doc_ids"].dataType.elementType
    schema = T.StructType([terms.schema["item_id"], T.StructField("doc_id", kind), T.StructField("score", T.LongType())])
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        heaps = {i: Heap(k) for i in queries}
        ids = lengths = None
        lists: dict[str, Posting] = {}

        def finish() -> None:
            if ids is None or not lists:
                return
            shard = ShardSearch(lists, lengths, n_docs, n_terms)
            for item, weights in queries.items():
                docs, scores = shard.best(weights, k, heaps[item].floor)
                heaps[item].merge(scores, ids, docs)

        for batch in batches:
            columns = [batch.column(n) for n in ("term", "blocks", "outer", "postings", "doc_ids", "lengths")]
            for i in range(batch.num_rows):
                term = columns[0][i].as_py()
                if term is None:  # a shard begins
                    finish()
                    ids, lengths, lists = columns[4][i].values, columns[5][i].values.to_numpy().astype(np.int64), {}
                else:
                    lists[term] = Posting.read(*(columns[c][i].as_py() for c in (1, 2, 3)), n_docs, n_terms)
        finish()
        out = [(item, doc, score) for item, heap in heaps.items() for score, doc in heap.best]
        if out:
            names, docs, scores = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, f.type) for x, f in zip((names, docs, scores), arrow, strict=True)], schema=arrow
            )

    in_order = rows.repartition("shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first())
    return in_order.mapInArrow(run, schema)


class Heap:
    """The k best (score, doc_id) of the shards so far."""

    def __init__(self, k: int):
        self.k, self.best, self.floor = k, [], 0

    def merge(self, scores: np.ndarray, ids: pa.Array, docs: np.ndarray) -> None:
        if not len(docs):
            return
        names = ids.take(pa.array(docs)).to_pylist()
        both = self.best + list(zip(scores.tolist(), names, strict=True))
        both.sort(key=lambda x: (-x[0], x[1] is None, 0 if x[1] is None else x[1]))
        self.best = both[: self.k]
        if len(self.best) == self.k:
            self.floor = self.best[-1][0]
