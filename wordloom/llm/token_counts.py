"""Token counts of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import sparing
from wordloom.llm.encoding import PieceEncoder


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limit: int = 512, batch_bytes: int = 1 << 20, slice_chars: int = 1 << 16) -> DataFrame:
    """Count each text's tokens: (id_col, n_bytes, n_tokens, over_limit), a row for each row of docs.

    Texts reach the tokenizer in batches of about ``batch_bytes``; texts over
    ``slice_chars`` are cut where no token can span, so the counts are those of
    the whole text. Only lengths come back from Python. No shuffle.

    A null text counts as empty: 0 bytes, 0 tokens. Ids may be null or repeat.
    An empty table gives an empty result. Other columns are not read.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.shared(path, batch_bytes=batch_bytes, slice_chars=slice_chars)
        for batch in batches:
            ids = encoder.encode(x.as_py() for x in batch.column(2))
            counts = pa.array((len(x) // 4 for x in ids), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], names=["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(sparing(lengths), f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
