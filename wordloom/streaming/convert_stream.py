"""Conversion of a stream of texts.

Each micro-batch is converted as a table of its own. What it needs of earlier
ones is their dictionary: with ``words`` a batch resolves only words that none
before it met (``WordStore``), else all of its own. Results are those of the
batch form either way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wordloom.operators.convert import convert
from wordloom.operators.resolve import Options, dictionary
from wordloom.operators.word_store import WordStore


def convert_stream(stream: DataFrame, key: str, text: str, sink_path: str, checkpoint: str, options: Options = Options(), once: bool = True, words: str | None = None) -> StreamingQuery:
    """Start a query that writes (key, text, changes, stats, unresolved, batch) of each micro-batch as Parquet.

    A batch that is run again after a failure overwrites its own folder, so the
    sink holds each batch once. words: the folder of the stream's dictionary,
    which belongs to this checkpoint and these options.
    """
    store = WordStore(stream.sparkSession, words, options) if words else None

    def write(batch: DataFrame, number: int) -> None:
        lookup = (lambda found, _: store.entries(found, number)) if store else dictionary
        convert(batch, key, F.col(text), options, lookup=lookup).write.mode("overwrite").parquet(f"{sink_path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
