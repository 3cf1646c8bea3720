"""What the operators of this subpackage share: column guards, batch iteration and the identity of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import Staging, hot_above, join_hot, small_batches

__all__ = ["Staging", "hot_above", "join_hot", "need", "slices", "small_batches", "text_key"]

#: Text bytes that a Python worker handles at a time, whatever the size of its Arrow batches.
SLICE_BYTES = 2 << 20


def need(df: DataFrame, *names: str) -> None:
    """Raises where a column is missing; extra columns are no concern of an operator."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each piece of a batch with its texts as UTF-8 (null: empty); pieces hold about SLICE_BYTES, or one row."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
        texts = [x or b"" for x in column.to_pylist()]
        start = size = 0
        for i, x in enumerate(texts):
            if i > start and size + len(x) > SLICE_BYTES:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(x)
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def text_key(text: str = "text") -> list:
    """Two independent 64-bit hashes of a text (null: as empty), its identity where texts themselves would be too wide to shuffle."""
    t = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(t).alias("text_h1"), F.xxhash64(F.lit(7), t).alias("text_h2")]
