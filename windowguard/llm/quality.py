"""Quality rules: base statistics of a text, and a line labeller that judges what is left.

The lines of a document are labelled content or boilerplate by a linear-chain conditional random
field: weights on line features, weights on label pairs of neighbouring lines, and the best
labelling by the Viterbi algorithm. A document is kept if enough of its words stand in content
lines. Both training (forward-backward) and decoding advance all documents of a batch in step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowguard.llm import arrays
from windowguard.llm.frames import extended, fresh

MIN_WORDS = 10
REPEAT_WINDOW = 5
REPEAT_PERCENT = 20
CONTENT_SHARE = 0.5
#: The labeller is fitted on at most so many labelled documents, lines a document and rounds.
SAMPLE_DOCS, SAMPLE_LINES, ROUNDS = 2000, 100, 150
#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

FEATURES = 11
SYMBOL = np.zeros(256, bool)
SYMBOL[list(SYMBOLS)] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = True
LETTER[128:] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
MARK = ~(LETTER | DIGIT | arrays.WHITE)
STOP = np.zeros(256, bool)
STOP[list(b".!?:;\"')")] = True
START_OF_POINT = np.ones(256, bool)
START_OF_POINT[0x80:0xC0] = False


@dataclass
class Statistics:
    """Counts of one value each, and the features and words of its lines with a word."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    line_first: np.ndarray
    line_words: np.ndarray
    features: np.ndarray


def repeated(keys: np.ndarray) -> np.ndarray:
    """Flags of the keys that occur twice or more."""
    ordered = np.sort(keys)
    twice = arrays.distinct(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def later(keys: np.ndarray) -> np.ndarray:
    """Flags of the keys that occur at an earlier place too."""
    _, first = np.unique(keys, return_index=True)
    flags = np.ones(len(keys), bool)
    flags[first] = False
    return flags


def measure(column: pa.Array) -> Statistics:
    """All counts of a column of texts."""
    data, offsets = arrays.text_bytes(column)
    starts, ends, first = arrays.spans(data, offsets, ~arrays.WHITE)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first)).astype(np.uint64)
    hashes = arrays.span_hashes(data, starts, ends)

    valid = arrays.within(first, REPEAT_WINDOW, len(starts))
    windows = arrays.pair(arrays.window_hashes(hashes, REPEAT_WINDOW)[valid], owner[valid])
    again = arrays.covered(valid[repeated(windows)], REPEAT_WINDOW, len(starts))

    def upto(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total

    points, symbols, marks = upto(START_OF_POINT[data]), upto(SYMBOL[data]), upto(MARK[data])
    upper, letters, digits = upto(UPPER[data]), upto(LETTER[data]), upto(DIGIT[data])

    # Lines with a word: the word range of each, from the newline before to the newline after.
    line_starts, line_ends, line_first = arrays.spans(data, offsets, ~arrays.NEWLINE)
    low, high = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    some = high > low
    before = np.concatenate(([0], np.cumsum(some)))
    line_first = before[line_first]
    line_starts, line_ends, low, high = line_starts[some], line_ends[some], low[some], high[some]
    line_owner = np.repeat(np.arange(len(line_first) - 1), np.diff(line_first)).astype(np.uint64)
    copies = later(arrays.pair(arrays.span_hashes(data, line_starts, line_ends), line_owner))

    count = (high - low).astype(float)
    size = np.maximum(line_ends - line_starts, 1)
    part = lambda total: total[line_ends] - total[line_starts]
    again_sum = np.concatenate(([0], np.cumsum(again)))
    features = np.zeros((len(count), FEATURES))
    if len(count):
        features[:, 0] = 1
        features[:, 1] = np.minimum(part(symbols) / count, 2)
        features[:, 2] = part(upper) / np.maximum(part(letters), 1)
        features[:, 3] = np.minimum(size / count, 30) / 10
        features[:, 4] = np.log1p(count) / 3
        features[:, 5] = copies
        features[:, 6] = (again_sum[high] - again_sum[low]) / count
        features[:, 7] = STOP[data[ends[high - 1] - 1]]
        features[:, 8] = part(digits) / size
        features[:, 9] = np.minimum(part(marks) / count, 3)
        features[:, 10] = count < 3
    return Statistics(
        np.diff(first),
        arrays.sums(points[ends] - points[starts], first),
        symbols[offsets[1:]] - symbols[offsets[:-1]],
        arrays.sums(copies, line_first),
        arrays.sums(again, first),
        line_first,
        high - low,
        features,
    )


@dataclass
class Labeller:
    """Weights of the field: per feature and label, per label pair. Label 1 is content."""

    emission: np.ndarray
    transition: np.ndarray

    @classmethod
    def blank(cls) -> Labeller:
        """Without any labelled line all labellings tie, and ties are content."""
        return cls(np.zeros((FEATURES, 2)), np.zeros((2, 2)))


def _in_step(first: np.ndarray):
    """Order values by falling line count; step t then concerns a prefix of them."""
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    steps = int(count.max()) if len(count) else 0
    alive = [int(n) for n in np.searchsorted(-count[order], -np.arange(steps), "left")]
    return order, first[:-1][order], alive


def decode(model: Labeller, features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best label of every line (Viterbi); a tie goes to content."""
    scores = features @ model.emission
    _, begin, alive = _in_step(first)
    labels, back = np.zeros(len(scores), np.int8), np.zeros((len(scores), 2), np.int8)
    best = scores[begin[: alive[0]]] if alive else scores[:0]
    last = np.zeros(0, np.int8)
    ends: list[np.ndarray] = []
    for t, n in enumerate(alive):
        if t:
            ends.append(best[n:])
            ways = best[:n, :, None] + model.transition
            came = (ways[:, 1] >= ways[:, 0]).astype(np.int8)
            back[begin[:n] + t] = came
            best = np.maximum(ways[:, 0], ways[:, 1]) + scores[begin[:n] + t]
    ends.append(best)
    for t in range(len(alive) - 1, -1, -1):
        n = alive[t]
        if t + 1 < len(alive):
            kept = back[begin[: len(last)] + t + 1, last]
        else:
            kept = last
        final = ends[t]
        last = np.concatenate((kept, (final[:, 1] >= final[:, 0]).astype(np.int8)))
        labels[begin[:n] + t] = last
    return labels


def train(features: np.ndarray, first: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS, decay: float = 1e-3) -> Labeller:
    """Weights of highest conditional likelihood, by gradient steps with adaptive sizes."""
    model = Labeller.blank()
    if not len(features):
        return model
    _, begin, alive = _in_step(first)
    weights = np.concatenate((model.emission.ravel(), model.transition.ravel()))
    mean, spread = np.zeros_like(weights), np.zeros_like(weights)
    target_e = features.T @ np.eye(2)[labels]
    inner = np.ones(len(labels), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    at = np.flatnonzero(inner)
    target_t = np.zeros((2, 2))
    np.add.at(target_t, (labels[at - 1], labels[at]), 1)
    for step in range(1, rounds + 1):
        emission, transition = weights[:-4].reshape(FEATURES, 2), weights[-4:].reshape(2, 2)
        scores = features @ emission
        ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
        ahead[begin[: alive[0]]] = scores[begin[: alive[0]]]
        for t, n in enumerate(alive[1:], 1):
            rows = begin[:n] + t
            ahead[rows] = np.logaddexp.reduce(ahead[rows - 1][:, :, None] + transition, 1) + scores[rows]
        for t in range(len(alive) - 1, 0, -1):
            rows = begin[: alive[t]] + t
            behind[rows - 1] = np.logaddexp.reduce(transition + (scores[rows] + behind[rows])[:, None, :], 2)
        both = ahead + behind
        chance = np.exp(both - np.logaddexp(both[:, 0], both[:, 1])[:, None])
        moves = ahead[at - 1][:, :, None] + transition + (scores[at] + behind[at])[:, None, :]
        moves = np.exp(moves - np.logaddexp(both[at, 0], both[at, 1])[:, None, None]).sum(0)
        slope = np.concatenate(((target_e - features.T @ chance).ravel(), (target_t - moves).ravel())) / len(labels)
        slope -= decay * weights
        mean, spread = 0.9 * mean + 0.1 * slope, 0.99 * spread + 0.01 * slope**2
        weights = weights + 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
    return Labeller(weights[:-4].reshape(FEATURES, 2), weights[-4:].reshape(2, 2))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> Labeller:
    """A labeller trained on the lines of labelled documents: label 1 (content) where quality is 1.

    At most ``sample`` documents are taken, in the order of a hash of their id, with at most
    SAMPLE_LINES lines each; only line features reach the driver. Labels without id or quality are
    left out; of several labels of a document the best counts; without any the labeller is blank.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in arrays.pieces(batch, "text"):
                found = measure(piece.column("text"))
                values = [
                    found.features[a : min(b, a + SAMPLE_LINES)].ravel()
                    for a, b in zip(found.line_first[:-1], found.line_first[1:], strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("quality"), pa.array(values, pa.list_(pa.float64()))],
                    names=["doc_id", "quality", "features"],
                )

    schema = "doc_id long, quality int, features array<double>"
    found = rows.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), "text").mapInArrow(lines, schema).toArrow()
    order = np.argsort(np.array(found.column("doc_id").to_pylist(), dtype=np.int64), kind="stable")
    blocks, verdicts = [], []
    for i in order.tolist()[:sample]:
        block = np.array(found.column("features")[i].as_py()).reshape(-1, FEATURES)
        if len(block):
            blocks.append(block)
            verdicts.append(np.full(len(block), int(found.column("quality")[i].as_py() > 0)))
    if not blocks:
        return Labeller.blank()
    first = np.concatenate(([0], np.cumsum([len(b) for b in blocks])))
    return train(np.concatenate(blocks), first, np.concatenate(verdicts))


RESULT = {
    "n_words": "long",
    "word_chars": "long",
    "n_symbols": "long",
    "n_dup_lines": "long",
    "n_repeat_words": "long",
    "content_words": "long",
    "base_failed": "boolean",
    "kept": "boolean",
}


def judge(docs: DataFrame, model: Labeller, share: float = CONTENT_SHARE) -> DataFrame:
    """Add the counts, ``base_failed`` and ``kept`` to documents; needs a ``text`` column.

    A null or empty text has no words and fails; a text of any length is read whole; repeated rows
    are judged one by one. Existing columns of the result's names are replaced.
    """
    carried = docs.drop(*RESULT)
    schema = extended(carried, **RESULT)
    emission, transition = model.emission, model.transition

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Labeller(emission, transition)
        for batch in batches:
            for piece in arrays.pieces(batch, "text"):
                found = measure(piece.column("text"))
                content = decode(field, found.features, found.line_first) * found.line_words
                content = arrays.sums(content, found.line_first)
                failed = (found.n_words < MIN_WORDS) | (100 * found.n_repeat_words > REPEAT_PERCENT * found.n_words)
                columns = [found.n_words, found.word_chars, found.n_symbols, found.n_dup_lines, found.n_repeat_words]
                columns = [pa.array(c.astype(np.int64)) for c in [*columns, content]]
                columns += [pa.array(failed), pa.array(~failed & (content >= share * found.n_words))]
                yield pa.RecordBatch.from_arrays(piece.columns + columns, schema=pa.schema(
                    [*piece.schema, *(pa.field(n, c.type) for n, c in zip(RESULT, columns, strict=True))]
                ))

    return carried.mapInArrow(verdicts, schema)


def keep_good(docs: DataFrame, model: Labeller, share: float = CONTENT_SHARE) -> DataFrame:
    """The documents that pass, with their own columns."""
    boxed = fresh(docs, "row")
    judged = judge(docs.select(F.struct(*docs.columns).alias(boxed), "text"), model, share)
    return judged.where("kept").select(f"{boxed}.*")
