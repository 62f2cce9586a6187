"""Chat formatting by token-level assembly.

A turn becomes START role MESSAGE text END, where the three markers are reserved ids beyond the
vocabulary. Role and text are encoded separately, so no token spans a marker, and control strings
inside them are escaped, so that the formatted string reads back as well. The loss mask is given by
token positions: prefix sums over the turns of a conversation.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>"
#: Control strings of this and of common other templates; each has one opening sign.
CONTROLS = (START, MESSAGE, END, "<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
LOSS_ROLE = "assistant"

TAILS = "|".join(re.escape(c[1:]) for c in CONTROLS)
_PLAIN = re.compile(rf"([<\[])(\\*)({TAILS})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({TAILS})")


def escape(text: str) -> str:
    """Put a backslash behind the opening sign of each control string, escaped ones included."""
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


@dataclass(frozen=True)
class Vocabulary:
    """Byte-level ranks and the pattern that cuts a text before merging; ids from ``size`` are reserved."""

    ranks: dict[bytes, int]
    pattern: str

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    @property
    def size(self) -> int:
        return max(self.ranks.values()) + 1

    def encoding(self):
        import tiktoken

        return tiktoken.Encoding("chat", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})


class Template:
    """Encodes and reads back turns; made once per task."""

    def __init__(self, vocabulary: Vocabulary):
        self.tokens = vocabulary.encoding()
        self.start, self.message, self.end = (vocabulary.size + i for i in range(3))

    def format(self, role: str, text: str) -> tuple[list[int], int, int, str]:
        """Token ids, first and last + 1 position of the loss, and the formatted string."""
        role, escaped = escape(role), escape(text)
        head = [self.start, *self.tokens.encode_ordinary(role), self.message]
        body = self.tokens.encode_ordinary(escaped)
        last = len(head) + (len(body) if role == LOSS_ROLE else 0)
        return [*head, *body, self.end], len(head), last, f"{START}{role}{MESSAGE}{escaped}{END}"

    def text(self, ids: list[int]) -> str:
        return unescape(self.tokens.decode_bytes(ids).decode())

    def read(self, ids: list[int]) -> tuple[str, str]:
        """Role and text of the ids of one turn."""
        middle = ids.index(self.message)
        if ids[0] != self.start or ids[-1] != self.end:
            raise ValueError("not the ids of one turn")
        return self.text(ids[1:middle]), self.text(ids[middle + 1 : -1])


def order(turns: DataFrame) -> list:
    return [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text") if c in turns.columns]


def format_turns(turns: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """conv_id, turn, nth, tokens, offset, loss_first, loss_last, formatted of every turn.

    ``nth`` counts the turns of a conversation from 0, ``offset`` is the place of the turn's first
    token in it, the loss covers the tokens [loss_first, loss_last) of the conversation. Turns are
    taken by (turn, role, text), so ties and repeated rows have a fixed order. Null role or text is
    empty; a null conv_id is a conversation of its own; other columns are left aside.
    """
    context = turns.sparkSession.sparkContext
    shared = context.broadcast(vocabulary)  # a vocabulary file, about a MB

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(shared.value)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                roles, texts = part.column("role").to_pylist(), part.column("text").to_pylist()
                rows = [template.format(r or "", t or "") for r, t in zip(roles, texts, strict=True)]
                ids, first, last, formatted = zip(*rows, strict=True)
                columns = [
                    *(part.column(c) for c in ("conv_id", "turn", "role", "text")),
                    pa.array(ids, pa.list_(pa.int32())),
                    pa.array(first, pa.int64()),
                    pa.array(last, pa.int64()),
                    pa.array(formatted, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = dict(turns.dtypes)
    names = ["conv_id", "turn", "role", "text", "tokens", "first", "last", "formatted"]
    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, tokens array<int>, first long, last long, formatted string"
    encoded = turns.select("conv_id", "turn", "role", "text").mapInArrow(encode, schema)
    in_order = Window.partitionBy("conv_id").orderBy(*order(encoded)[1:])
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.size("tokens")).over(before), F.lit(0))
    return encoded.withColumns({"nth": F.row_number().over(in_order) - 1, "offset": offset}).select(
        "conv_id",
        "turn",
        F.col("nth").cast("long").alias("nth"),
        "tokens",
        "offset",
        (F.col("offset") + F.col("first")).alias("loss_first"),
        (F.col("offset") + F.col("last")).alias("loss_last"),
        "formatted",
    )


def read_back(formatted: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Digests of each conversation, from its tokens and loss positions alone.

    The turns of a conversation are read in order as a stream and fed to running digests, so a
    conversation of any length needs the memory of a batch of turns only.
    """
    context = formatted.sparkSession.sparkContext
    shared = context.broadcast(vocabulary)
    kind = dict(formatted.dtypes)["conv_id"]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(shared.value)
        current, state, id_type = None, None, None

        def result(done: list[tuple]) -> pa.RecordBatch:
            rows = [(c, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]) for c, s in done]
            types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            done, id_type = [], batch.schema.field("conv_id").type
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "offset", "loss_first", "loss_last", "chars"))
            for i, (conv, offset, first, last, chars) in enumerate(zip(*columns, strict=True)):
                if state is None or conv != current:
                    if state is not None:
                        done.append((current, state))
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = batch.column("tokens")[i].as_py()
                role, text = template.read(ids)
                loss = template.text(ids[first - offset : last - offset])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += chars
            if done:
                yield result(done)
        if state is not None:
            yield result([(current, state)])

    rows = formatted.select(
        "conv_id", "nth", "tokens", "offset", "loss_first", "loss_last", F.char_length("formatted").alias("chars")
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "nth").mapInArrow(digest, schema)


def with_probe(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """The turns and conversation -1, whose texts are made of control strings."""
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)
