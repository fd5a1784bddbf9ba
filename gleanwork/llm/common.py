"""Row keys and Arrow helpers of the operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LONG = (1 << 63) - 1


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(kid, tid, text): a null text is empty; a null id sorts after every other.

    Rows with equal kid and tid hold the same id and text, so whatever is computed
    for one of them holds for all.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(MAX_LONG)).alias("kid"),
        F.xxhash64(text).alias("tid"),
        text.alias("text"),
    )


def public_id(kid: Column) -> Column:
    """The id as it came: null where keyed() put the largest long."""
    return F.when(kid != F.lit(MAX_LONG), kid)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its values; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 4 << 20):
    """Ranges of rows with about `limit` bytes, or one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; nulls are empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch of the schema from arrays or lists, by name."""
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema], schema=schema)
