"""Chat formatting at the level of tokens.

A turn is ``<|turn|>`` role ``<|text|>`` text ``<|end|>``; the three markers are
reserved ids beyond the vocabulary, spliced between segments that are encoded
by themselves, so no text can ever make one. Control strings in roles and texts
are escaped all the same, for readers of the decoded form: ESCAPE goes after the
first character of each, and an ESCAPE of the text itself is doubled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.common import sliced, sparing

ESCAPE = "\u241b"
MARKERS = ("<|turn|>", "<|text|>", "<|end|>")
#: The control strings of this and other public chat templates.
CONTROL = (*MARKERS, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPED = re.compile("|".join(map(re.escape, (ESCAPE, *CONTROL))))
_UNESCAPED = re.compile(f"{ESCAPE}({ESCAPE}?)")
TRAINED_ROLE = "assistant"


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub("\\1", text)


class Template:
    """Encodes and reads turns; the reserved ids follow the vocabulary's."""

    def __init__(self, path: str):
        from wordloom.llm.secrets import _encoding

        self._encoding = _encoding(path)
        self.turn, self.text, self.end = range(self._encoding.n_vocab, self._encoding.n_vocab + 3)

    def ids(self, role: str, text: str) -> tuple[np.ndarray, int, int]:
        """A turn's ids, and between which positions its text's ids lie."""
        segments = [[self.turn], self._encode(role), [self.text], self._encode(text), [self.end]]
        at = np.cumsum([len(x) for x in segments])
        return np.fromiter((i for x in segments for i in x), np.uint32, int(at[-1])), int(at[2]), int(at[3])

    def _encode(self, text: str) -> list[int]:
        return self._encoding.encode_ordinary(escape(text))

    def decode(self, ids: np.ndarray) -> str:
        return self._encoding.decode_bytes(ids.tolist()).decode()

    def read(self, ids: np.ndarray) -> tuple[str, str]:
        """Role and text of a turn's ids."""
        middle = int(np.flatnonzero(ids == self.text)[0])
        if ids[0] != self.turn or ids[-1] != self.end:
            raise ValueError("not a turn")
        return unescape(self.decode(ids[1:middle])), unescape(self.decode(ids[middle + 1 : -1]))

    def chars(self, ids: np.ndarray) -> int:
        """Characters of the ids' decoded form, markers included."""
        own = {self.turn: MARKERS[0], self.text: MARKERS[1], self.end: MARKERS[2]}
        marks = np.flatnonzero(ids >= self.turn)
        return len(self.decode(ids[ids < self.turn])) + sum(len(own[int(ids[k])]) for k in marks)


def format_turns(turns: DataFrame, vocabulary: str | None = None, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """(conv_id, position, ids, first, loss_start, loss_end), a row for each turn, in order within its conversation.

    ids: little-endian unsigned 32-bit numbers. first: ids of the conversation
    before this turn. The loss is on the conversation's ids from loss_start up to
    loss_end, the texts of trained_role; the two are equal elsewhere. Turns are
    encoded where they lie, before the one shuffle by conversation; offsets are
    prefix sums over a conversation's turns, which stream through a sort.

    Turns are ordered by turn (null first), then role and text, so repeated rows
    stay; a null role or text counts as empty; null conv_ids are one
    conversation. An empty table gives an empty result. Other columns are not read.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(path)
        for batch in sliced(batches):
            made = [template.ids(role, text) for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            trained = [x.as_py() == trained_role for x in batch.column(2)]
            columns = [
                pa.array([x[0].astype("<u4").tobytes() for x in made], pa.binary()),
                pa.array([len(x[0]) for x in made], pa.int64()),
                pa.array([x[1] for x in made], pa.int64()),
                pa.array([x[2] if t else x[1] for x, t in zip(made, trained, strict=True)], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *columns], names=["conv_id", "turn", "role", "text", "ids", "n", "a", "b"])

    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    encoded = rows.mapInArrow(sparing(encode), f"conv_id {kind}, turn long, role string, text string, ids binary, n long, a long, b long")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return encoded.select("conv_id", F.row_number().over(order).alias("position"), "ids", before.alias("first"), "a", "b").select("conv_id", "position", "ids", "first", (F.col("first") + F.col("a")).alias("loss_start"), (F.col("first") + F.col("b")).alias("loss_end"))


def digest(formatted: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """What the output of format_turns says, a row for each conversation; turns stream by, one at a time.

    The turns may come in any order and from any table: the window below deals
    and sorts them, which costs nothing where format_turns has just done so. An
    empty table gives an empty result; null conv_ids are one conversation.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(path)
        key, open_, done = None, False, []
        types: list[pa.DataType] = []
        n = loss_chars = chars = 0
        turns = loss = None

        def batch() -> pa.RecordBatch:
            columns = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for part in batches:
            types = [part.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            for k in range(part.num_rows):
                conv = part.column(0)[k].as_py()
                if part.column(6)[k].as_py() == 1:
                    if open_:
                        done.append((key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    key, open_ = conv, True
                    n = loss_chars = chars = 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                ids = np.frombuffer(part.column(2)[k].as_py(), "<u4")
                first, start, stop = (part.column(i)[k].as_py() for i in (3, 4, 5))
                role, text = template.read(ids)
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
                if stop > start:
                    said = unescape(template.decode(ids[start - first : stop - first]))
                    loss.update(said.encode())
                    loss_chars += len(said)
                chars += template.chars(ids)
            if len(done) >= 1000:
                yield batch()
                done = []
        if open_:
            done.append((key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            yield batch()

    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("position"))
    ordered = formatted.select("conv_id", "position", "ids", "first", "loss_start", "loss_end", place.alias("place"))
    return ordered.mapInArrow(sparing(run), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
