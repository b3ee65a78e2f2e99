"""Packing documents into sequences of a fixed length by reciprocal-capacity classes.

A document is cut into pieces whose lengths are the capacity divided by a whole
number (rounded down), longest first; what is left below the smallest of them
is a piece of its own length. Pieces of one length form a class, and each class
fills its sequences with the same number of pieces, so a worker needs to know
nothing of the others. Sequences that stay open at a worker's end meet those of
``fan_in`` workers, are filled on in the same way, and so on in a tree; what the
last one leaves open is at most a sequence's worth of each class, whatever the
input, and goes best fit into mixed sequences.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import shared_folder, sparing
from wordloom.llm.encoding import PieceEncoder

CAPACITY = 4096
#: Lengths below CAPACITY // CLASSES are classes of their own.
CLASSES = 64
_ROWS, _BYTES = 1024, 2 << 20
_ROW_GROUP = 8 << 20


def piece_lengths(n: int, capacity: int = CAPACITY, classes: int = CLASSES) -> list[int]:
    """The lengths into which a document of n tokens is cut, in order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    least = capacity // classes
    while rest >= least:
        k = -(-capacity // rest)  # the fewest pieces to a sequence whose length is no longer than rest
        while capacity // k > rest:
            k += 1
        out.append(capacity // k)
        rest -= capacity // k
    return out + [rest] * (rest > 0)


class _Filler:
    """Open sequences by class; a full one leaves with its number."""

    def __init__(self, capacity: int, base: int):
        self.capacity, self.number = capacity, base
        self.open: dict[int, list[tuple]] = defaultdict(list)

    def put(self, piece: tuple) -> list[tuple]:
        length = piece[2]
        waiting = self.open[length]
        waiting.append(piece)
        if len(waiting) < self.capacity // length:
            return []
        return self._close(self.open.pop(length))

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        out, offset = [], 0
        for x in pieces:
            out.append((*x, self.number, offset))
            offset += x[2]
        self.number += 1
        return out

    def rest(self) -> list[tuple]:
        return [x for pieces in self.open.values() for x in pieces]

    def mixed(self) -> list[tuple]:
        """The rest, best fit: longest pieces first, each to the fullest sequence that has room."""
        bins: list[list[tuple]] = []
        by_room: dict[int, list[int]] = defaultdict(list)
        for x in sorted(self.rest(), key=lambda x: -x[2]):
            room = next((r for r in range(x[2], self.capacity) if by_room.get(r)), None)
            if room is None:
                bins.append([])
                room, at = self.capacity, len(bins) - 1
            else:
                at = by_room[room].pop()
            bins[at].append(x)
            by_room[room - x[2]].append(at)
        return [y for pieces in bins for y in self._close(pieces)]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 2, capacity: int = CAPACITY, classes: int = CLASSES, fan_in: int = 8) -> DataFrame:
    """Pack whole documents: (id_col, start, length, ids, doc_tokens, sequence_id, offset), a row for each piece.

    ids: the piece's ids as little-endian unsigned 32-bit numbers; a document's
    ids end with end_id. Each id of a document lies in one piece, a sequence has
    capacity ids at most, and its pieces lie in it without a gap from offset 0.

    A null or empty text is one piece, the end id alone. Rows that repeat are
    packed each; ids of rows may be null. An empty table gives an empty result.
    Other columns are not read. Needs a checkpoint folder that executors share.
    """
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    kind = docs.schema[id_col].dataType.simpleString()
    fields = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    schema = f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encoder = PieceEncoder.shared(path)
        for batch in batches:
            ids = batch.column(0)
            for k, got in enumerate(encoder.encode(x.as_py() for x in batch.column(1))):
                data, start = got + end, 0
                total, name = len(data) // 4, ids[k].as_py()
                for n in piece_lengths(total, capacity, classes):
                    yield name, start, n, data[4 * start : 4 * (start + n)], total
                    start += n

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)

    def level(number: int, last: bool):
        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filler = _Filler(capacity, (number << 56) + (TaskContext.get().partitionId() << 32))
            out: list[tuple] = []
            held = 0

            def batch() -> pa.RecordBatch:
                columns = zip(*out, strict=True)
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=fields)

            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            for piece in again(batches) if number else cut(batches):
                full = filler.put(piece)
                out += full
                held += sum(len(x[3]) for x in full)
                if len(out) >= _ROWS or held >= _BYTES:
                    yield batch()
                    out, held = [], 0
            out += filler.mixed() if last else [(*x, None, None) for x in filler.rest()]
            if out:
                yield batch()

        return sparing(fill)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema[id_col].dataType)
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/packing-{uuid.uuid4().hex}"

    def written(rows: DataFrame, number: int) -> DataFrame:
        """rows in the shared folder. Open pieces come last in each file, so a filter on them skips nearly all its row groups."""
        rows.write.option("parquet.block.size", _ROW_GROUP).parquet(f"{folder}/{number}")
        return spark.read.schema(schema).parquet(f"{folder}/{number}")

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    workers, number = given.rdd.getNumPartitions(), 0
    rows = written(given.mapInArrow(level(0, False), schema), 0)
    done = rows.filter("sequence_id IS NOT NULL")
    while True:
        number, workers = number + 1, -(-workers // fan_in)
        last = workers <= 1
        waiting = rows.filter("sequence_id IS NULL").coalesce(max(1, workers))
        rows = written(waiting.mapInArrow(level(number, last), schema), number)
        done = done.unionByName(rows.filter("sequence_id IS NOT NULL"))
        if last:
            return done.withColumnRenamed("id", id_col)


def padded(sequence_tokens: F.Column, capacity: int = CAPACITY) -> F.Column:
    """A sequence's length with padding: a power of two stays, others go to capacity."""
    return F.when(F.expr("1") == F.bit_count(sequence_tokens), sequence_tokens).otherwise(F.lit(capacity).cast("long"))
