"""How filters interact: what each removes, alone, in every order, and on average over the orders.

The counts that the filters read come from one pass of a byte transducer: a table gives, for a state
(inside a word or not, bytes that a UTF-8 character still lacks) and a byte, the next state and what
the byte says: word begins, word ended, capital, character, symbol. The stream is cut into lanes that
advance in step. Word spans go into a verified hash table per document, which counts distinct words.
Documents are then merged by what they fail, so the orders are evaluated on a few sums per part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windowguard.llm import arrays
from windowguard.llm.frames import extended
from windowguard.llm.span_table import first_equal
from windowguard.session import stage

LANE = 256
#: A lane's state depends on the bytes of one character before it.
LOOK_BACK = 4
#: Byte that ends a document in the stream; UTF-8 has none of it.
STOP = 0xFF
BEGINS, ENDED, CAPITAL, CHARACTER, SYMBOL = 1, 2, 4, 8, 16
SYMBOLS = b"#$%&*|"

FILTERS = "ABCDE"
MIN_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 3

COUNTS = {
    "n_words": "long",
    "n_distinct": "long",
    "n_capitals": "long",
    "n_chars": "long",
    "n_symbols": "long",
    "text_sha256": "binary",
}


def transducer() -> np.ndarray:
    """Cell (state * 256 + byte): next state * 32 + what the byte says.

    A state is (bytes still missing) * 2 + (inside a word). A continuation byte that none was
    missing for counts as a character of its own.
    """
    byte = np.arange(256)
    follows = (byte & 0xC0) == 0x80
    lacks = np.select([byte >= 0xF8, byte >= 0xF0, byte >= 0xE0, byte >= 0xC0], [0, 3, 2, 1], 0)
    out = np.zeros((8, 256), np.uint8)
    for state in range(8):
        missing, inside = divmod(state, 2)
        part = follows & (missing > 0)
        left = np.where(part, missing - 1, lacks)
        gap = arrays.WHITE | (byte == STOP)
        says = (~gap & (inside == 0)) * BEGINS + (gap & (inside == 1)) * ENDED
        says += ((byte >= 65) & (byte <= 90)) * CAPITAL + (~part & (byte != STOP)) * CHARACTER
        says += np.isin(byte, list(SYMBOLS)) * SYMBOL
        out[state] = (left * 2 + ~gap) * 32 + says
    return out.ravel()


TABLE = transducer()


def transduce(stream: np.ndarray) -> np.ndarray:
    """What each byte of the stream says, all lanes in step."""
    lanes = -(-len(stream) // LANE)
    cells = np.full(lanes * LANE, STOP, np.uint8)
    cells[: len(stream)] = stream
    cells = np.ascontiguousarray(cells.reshape(lanes, LANE).T)
    state = np.zeros(lanes, np.uint16)
    for t in range(LANE - LOOK_BACK, LANE):  # the end of the lane before
        state[1:] = TABLE[(state[1:] << 8) | cells[t, :-1]] >> 5
    for t in range(LANE):
        said = TABLE[(state << 8) | cells[t]]
        state = (said >> 5).astype(np.uint16)
        cells[t] = said & 31
    return cells.T.ravel()[: len(stream)]


def count(column: pa.Array) -> list[np.ndarray]:
    """Words, distinct words, capitals, characters and symbols of each text."""
    data, offsets = arrays.text_bytes(column)
    rows = len(column)
    if not rows:
        return [np.zeros(0, np.int64)] * 5
    stream = np.full(len(data) + rows, STOP, np.uint8)
    document = np.repeat(np.arange(rows), np.diff(offsets))
    stream[np.arange(len(data)) + document] = data
    first = offsets[:-1] + np.arange(rows)
    said = transduce(stream)
    starts, ends = np.flatnonzero(said & BEGINS), np.flatnonzero(said & ENDED)
    owner = np.searchsorted(first, starts, "right") - 1
    new = first_equal(stream, starts, ends, owner) == np.arange(len(starts))
    words, distinct = np.bincount(owner, minlength=rows), np.bincount(owner[new], minlength=rows)
    rest = [np.add.reduceat((said & bit) > 0, first, dtype=np.int64) for bit in (CAPITAL, CHARACTER, SYMBOL)]
    return [words, distinct, *rest]


def measure(docs: DataFrame) -> DataFrame:
    """Replace the ``text`` of documents by the counts of COUNTS; columns of those names are replaced.

    Null counts as empty: all counts zero and the digest of the empty text. Repeated rows are
    measured one by one; a text of any length is read whole; no documents give no rows.
    """
    carried = docs.drop("text", *COUNTS)
    own, schema = carried.columns, extended(carried, **COUNTS)
    names = schema.names

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in arrays.pieces(batch, "text"):
                texts = piece.column("text")
                data, offsets = arrays.text_bytes(texts)
                raw = memoryview(data)
                digests = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                columns = [pa.array(c.astype(np.int64)) for c in count(texts)]
                kept = [piece.column(c) for c in own]
                yield pa.RecordBatch.from_arrays([*kept, *columns, pa.array(digests, pa.binary())], names=names)

    return docs.select(*own, "text").mapInArrow(counted, schema)


def own_failures() -> dict[str, Column]:
    """The filters that look at one document, over the columns of ``measure``."""
    words, chars = F.col("n_words"), F.col("n_chars")
    return {
        "A": words < MIN_WORDS,
        "B": 100 * F.col("n_distinct") < DISTINCT_PERCENT * words,
        "C": 100 * F.col("n_capitals") > CAPITAL_PERCENT * chars,
        "D": F.col("n_symbols") > 0,
    }


def verdicts(labels: DataFrame) -> DataFrame:
    """doc_id, good, toxic of labelled documents; of several labels of a document any one counts."""
    said = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    return (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(*(F.coalesce(F.bool_or(v), F.lit(False)).alias(k) for k, v in said.items()))
    )


def failure_sums(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by language and by the set of filters that they fail.

    Bit i of ``mask`` stands for filter i of FILTERS. Filter E fails a text that a document of smaller
    doc_id has as well, in any language; of equal ids none is smaller, and a null id neither is nor
    has a smaller one. Rows are merged per text before anything is compared, so a text that fills a
    third of the table is a few rows.
    """
    bits = [F.when(test, 1 << i).otherwise(0) for i, test in enumerate(own_failures().values())]
    measured = measure(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), "text"))
    keys = ["doc_id", "part", "text_sha256", "mask"]
    rows = measured.withColumn("mask", sum(bits, F.lit(0)).cast("int")).groupBy(*keys).agg(F.count("*").alias("n"))
    rows = stage(rows, "measured")
    yes = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    rows = rows.join(verdicts(labels), "doc_id", "left").select(*keys, "n", *yes)
    here = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    nameless = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")))
    same = rows.groupBy("text_sha256", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(here).alias("first"), F.coalesce(nameless, F.lit(0)).alias("nameless")
    )
    least = F.min("first.doc_id").over(Window.partitionBy("text_sha256"))
    passed = F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0) + F.col("nameless")
    again = 1 << FILTERS.index("E")
    split = F.array(
        F.struct(F.col("mask"), F.col("passed").alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(again)).alias("mask"), (F.col("n") - F.col("passed")).alias("n")),
    )
    split = same.withColumn("passed", passed).select("part", "good", "toxic", F.inline(split)).where("n > 0")
    return split.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step, filters before as a mask, bit of the step's filter) of every order."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for i, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            out.append(("".join(order), i + 1, before, bit))
            before |= bit
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of each step, for all orders of the filters.

    Parts are the languages, null as the empty string. Without documents there are no rows.
    """
    spark = docs.sparkSession
    sums = stage(failure_sums(docs, labels), "failures")
    pairs = sorted({(before, bit) for _, _, before, bit in steps()})
    case = F.explode(F.array(*(F.struct(F.lit(p).alias("before"), F.lit(b).alias("bit")) for p, b in pairs)))
    mask, before, bit = F.col("mask"), F.col("case.before"), F.col("case.bit")
    comes = mask.bitwiseAND(before) == 0
    fails = mask.bitwiseAND(bit) != 0

    def total(value: str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(value)).otherwise(0)).cast("long")

    cases = (
        sums.withColumn("case", case)
        .groupBy("part", "case")
        .agg(
            total("n", comes & ~fails).alias("kept"),
            total("n", comes & fails).alias("removed"),
            total("n", ~comes & fails).alias("redundant"),
            total("n", mask == bit).alias("unique_fails"),
            total("good", comes & fails).alias("good_lost"),
            total("toxic", comes & fails).alias("toxic_lost"),
        )
        .select("part", "case.before", "case.bit", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    )
    orders = spark.createDataFrame(steps(), "filter_order string, step int, before int, bit int")
    everywhere = F.sum("removed").over(Window.partitionBy("part", "bit")).cast("long")
    return (
        cases.join(F.broadcast(orders), ["before", "bit"])  # 600 rows, whatever the documents
        .withColumn("shapley", everywhere)
        .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    )
