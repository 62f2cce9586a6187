"""Byte-pair encoding and decoding by a segment tree over the ranks of adjacent pairs.

A text is cut into pieces, and a piece starts as the symbols of its bytes. The leaves of its tree
hold the ranks of adjacent pairs, every inner node the least of its children, so the root yields
the leftmost pair of lowest rank. Merging it changes three leaves, whose paths are updated, and
the pieces are done when no root has a rank. Pieces of one tree size are merged in step; a piece
that is met again is taken from a table of bounded size.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowguard.llm import arrays
from windowguard.llm.frames import extended

#: Fixed value: the pattern that byte-level tokenizer files mean by ``use_regex``.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts whose UTF-8 bytes are all below this one hold no character of a recent version of Unicode.
SETTLED_BYTE = 0xD5
KNOWN_PIECES = 1 << 18
KNOWN_LETTERS = 64
ROWS = 256
ALONE = 16
NONE = np.int64(1) << 62


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass(frozen=True)
class Merges:
    """Merges as sorted pair keys with their ranks, what they make, and the bytes of every id."""

    keys: np.ndarray  # left id << 32 | right id, ascending
    ranks: np.ndarray  # rank of each key
    made: np.ndarray  # by rank, the id that a merge gives
    byte_ids: np.ndarray  # by byte, the id of its symbol
    id_bytes: dict[int, bytes]
    added: dict[str, int]  # strings that are ids of their own wherever they occur

    @classmethod
    def read(cls, path: str) -> Merges:
        """From a byte-level BPE tokenizer file; any other kind of tokenizer is refused."""
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        model, cut, added = spec["model"], spec["pre_tokenizer"] or {}, spec["added_tokens"]
        plain = model["type"] == "BPE" and not any(
            model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        )
        level = cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"] and not spec["normalizer"]
        exact = not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)
        if not (plain and level and exact and (spec["decoder"] or {}).get("type") == "ByteLevel"):
            raise ValueError(f"{path} is no plain byte-level BPE tokenizer")
        vocab, letters = model["vocab"], byte_letters()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        names = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in added}
        return cls(
            keys[order],
            order.astype(np.int64),
            np.array([vocab[a + b] for a, b in pairs], np.int64),
            np.array([vocab[x] for x, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64),
            {i: bytes(letters[x] for x in t) if all(x in letters for x in t) else t.encode() for i, t in names.items()},
            {t["content"]: t["id"] for t in added if t["content"]},
        )

    @cached_property
    def table(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it does not merge."""
        if not len(self.keys):
            return np.full(left.shape, NONE)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


def merge_in_step(symbols: np.ndarray, merges: Merges) -> np.ndarray:
    """Merge the pieces in the rows of ``symbols`` (-1 behind the last one); merged places become -1.

    The width is a power of two. Leaf i of a row's tree holds rank * width + i for the pair that
    starts at place i, so the root also says where its pair stands.
    """
    n, width = symbols.shape
    shift = width.bit_length() - 1
    place = np.arange(width)
    symbols = np.concatenate((symbols, np.full((n, 1), -1, np.int64)), axis=1)
    following = np.broadcast_to(place + 1, (n, width)).copy()
    following[symbols[:, 1:] < 0] = width
    previous = np.broadcast_to(place - 1, (n, width)).copy()
    tree = np.full((n, 2 * width), NONE)

    def leaf(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(rank < NONE, (rank << shift) | at, NONE)

    rows, at = np.nonzero((symbols[:, :-1] >= 0) & (symbols[:, 1:] >= 0))
    tree[rows, width + at] = leaf(merges.rank(symbols[rows, at], symbols[rows, at + 1]), at)
    size = width
    while size > 1:
        tree[:, size // 2 : size] = np.minimum(tree[:, size : 2 * size : 2], tree[:, size + 1 : 2 * size : 2])
        size //= 2
    rows = np.flatnonzero(tree[:, 1] < NONE)
    while len(rows):
        root = tree[rows, 1]
        at = root & (width - 1)
        right = following[rows, at]
        after = following[rows, right]
        before = previous[rows, at]
        symbols[rows, at] = merges.made[root >> shift]
        symbols[rows, right] = -1
        following[rows, at] = after
        inner = after < width
        previous[rows[inner], after[inner]] = at[inner]
        now = symbols[rows, at]
        value = np.where(inner, leaf(merges.rank(now, symbols[rows, after]), at), NONE)
        left = np.where(before >= 0, before, at)
        left_value = np.where(before >= 0, leaf(merges.rank(symbols[rows, left], now), left), value)
        nodes = np.stack((right, at, left)) + width
        tree[rows, nodes] = np.stack((np.full(len(rows), NONE), value, left_value))
        while nodes[0, 0] > 1:
            nodes >>= 1
            tree[rows, nodes] = np.minimum(tree[rows, 2 * nodes], tree[rows, 2 * nodes + 1])
        rows = rows[tree[rows, 1] < NONE]
    return symbols[:, :-1]


def merge_alone(symbols: list[int], merges: Merges) -> list[int]:
    """The same for one piece of any length, on plain lists."""
    width = 1 << max(1, (len(symbols) - 1).bit_length())
    table, made = merges.table, merges.made
    none = int(NONE)
    symbols = list(symbols)
    n = len(symbols)
    following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [none] * (2 * width)

    def leaf(i: int) -> int:
        rank = table.get(symbols[i] << 32 | symbols[following[i]]) if following[i] < n else None
        return none if rank is None else rank * width + i

    for i in range(n):
        tree[width + i] = leaf(i)
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    while tree[1] < none:
        rank, at = divmod(tree[1], width)
        right = following[at]
        symbols[at], symbols[right] = int(made[rank]), -1
        following[at] = following[right]
        if following[at] < n:
            previous[following[at]] = at
        updates = [(right, none), (at, leaf(at))]
        if previous[at] >= 0:
            updates.append((previous[at], leaf(previous[at])))
        for i, value in updates:
            node = width + i
            tree[node] = value
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least
    return [s for s in symbols if s >= 0]


def encode_pieces(pieces: list[bytes], merges: Merges) -> list[bytes]:
    """The ids of each piece as little-endian 32-bit integers."""
    out = [b""] * len(pieces)
    lengths = np.array([len(p) for p in pieces], np.int64)
    widths = 1 << np.ceil(np.log2(np.maximum(lengths, 2))).astype(np.int64)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        if len(rows) < ALONE:
            for i in rows.tolist():
                ids = merges.byte_ids[np.frombuffer(pieces[i], np.uint8)].tolist()
                out[i] = np.array(merge_alone(ids, merges), "<u4").tobytes()
            continue
        step = max(ALONE, (1 << 18) // width)
        for part in (rows[i : i + step] for i in range(0, len(rows), step)):
            data = np.frombuffer(b"".join(pieces[i] for i in part.tolist()), np.uint8)
            filled = np.arange(width) < lengths[part][:, None]
            symbols = np.full(filled.shape, -1, np.int64)
            symbols[filled] = merges.byte_ids[data]
            symbols = merge_in_step(symbols, merges)
            kept = symbols >= 0
            raw = symbols[kept].astype("<u4").tobytes()
            ends = (4 * np.cumsum(kept.sum(1))).tolist()
            for i, a, b in zip(part.tolist(), [0, *ends], ends, strict=False):
                out[i] = raw[a:b]
    return out


class Encoder:
    """Encodes the texts of one task; pieces met before come from a table of bounded size."""

    def __init__(self, merges: Merges):
        from tokenizers.pre_tokenizers import ByteLevel

        self.merges, self.letters = merges, byte_letters()
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in merges.added.items()}
        self.known = dict(self.added)
        self.cut = regex.compile(PATTERN).findall
        self.public_cut = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        longest_first = sorted(merges.added, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")").split if merges.added else None

    def pieces(self, text: str, settled: bool) -> list[str]:
        """The pieces of a text; one with characters unknown here is cut by the public library."""
        if settled or all(unicodedata.category(c) != "Cn" for c in set(text)):
            return self.cut(text)
        return [bytes(self.letters[x] for x in piece).decode() for piece, _ in self.public_cut(text)]

    def cuts(self, text: str, settled: bool) -> list[str]:
        row: list[str] = []
        for i, part in enumerate(self.split(text) if self.split else [text]):
            if i % 2:
                row.append(part)  # a string that is one id
            elif part:
                row += self.pieces(part, settled)
        return row

    def encode(self, texts: list[str], settled: bool = False) -> list[bytes]:
        """The ids of each text; ``settled`` says that no character is newer than the tables used here."""
        cuts = [self.cuts(text, settled) for text in texts]
        pieces = set().union(*cuts)
        fresh = list(pieces.difference(self.known))
        if len(self.known) + len(fresh) > KNOWN_PIECES:
            self.known = dict(self.added)
            fresh = list(pieces.difference(self.known))
        self.known.update(zip(fresh, encode_pieces([p.encode() for p in fresh], self.merges), strict=True))
        out = [b"".join(map(self.known.__getitem__, row)) for row in cuts]
        for piece in fresh:
            if len(piece) > KNOWN_LETTERS:
                del self.known[piece]
        return out


def encode(docs: DataFrame, merges: Merges, name: str = "tokens") -> DataFrame:
    """Add the ids of each ``text`` as an array column, in place of any column of that name.

    A null or empty text has no ids; texts are encoded whole, whatever their length; repeated rows
    are encoded one by one, and other columns pass through. No documents give no rows.
    """
    carried = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(merges)  # a vocabulary file, a few MB
    kind = pa.list_(pa.field("element", pa.int32(), nullable=True))
    names = [*carried.columns, name]

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for piece in arrays.pieces(batch, "text"):
                data, _ = arrays.text_bytes(piece.column("text"))
                settled = not len(data) or int(data.max()) < SETTLED_BYTE
                raw = encoder.encode([t or "" for t in piece.column("text").to_pylist()], settled)
                offsets = np.concatenate(([0], np.cumsum([len(r) // 4 for r in raw]))).astype(np.int32)
                ids = pa.array(np.frombuffer(b"".join(raw), "<u4").astype(np.int32))
                column = pa.ListArray.from_arrays(pa.array(offsets), ids, type=kind)
                yield pa.RecordBatch.from_arrays([*piece.columns, column], names=names)

    return carried.mapInArrow(tokens, extended(carried, **{name: "array<int>"}))


def decode(rows: DataFrame, merges: Merges, tokens: str = "tokens", name: str = "decoded") -> DataFrame:
    """Add the text that the ids of column ``tokens`` spell, in place of any column of that name.

    Bytes that are no UTF-8 become U+FFFD, ids beyond the vocabulary spell nothing, and neither do
    null ids; a null array gives an empty text.
    """
    carried = rows.drop(name)
    names = [*carried.columns, name]
    shared = rows.sparkSession.sparkContext.broadcast(merges.id_bytes)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = []
                for ids in part.column(tokens):
                    ids = ids.values.to_numpy(zero_copy_only=False).tolist() if ids.is_valid else []
                    try:
                        raw = b"".join([known[i] for i in ids])
                    except KeyError:
                        raw = b"".join([known.get(i, b"") for i in ids])
                    texts.append(raw.decode("utf-8", "replace"))
                columns = [*part.columns, pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return carried.mapInArrow(spell, extended(carried, **{name: "string"}))


def digests(rows: DataFrame, tokens: str = "tokens", name: str = "ids_sha256") -> DataFrame:
    """Add the SHA-256 of each array of ids, taken as little-endian unsigned 32-bit integers; null counts as empty."""
    carried = rows.drop(name)
    names = [*carried.columns, name]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for ids in batch.column(tokens):
                raw = ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes() if ids.is_valid else b""
                found.append(hashlib.sha256(raw).hexdigest())
            columns = [*batch.columns, pa.array(found, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return carried.mapInArrow(digest, extended(carried, **{name: "string"}))


def round_trip(docs: DataFrame, merges: Merges) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, from its ids alone."""
    encoded = encode(docs.select("doc_id", "text"), merges).select("doc_id", "tokens")
    known = digests(decode(encoded, merges))
    return known.select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        "ids_sha256",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
