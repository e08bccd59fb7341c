"""Whole-number vectors, shared by the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.frames import by_value

by_value(__name__)
col, lit = F.col, F.lit

#: Fixed value: steps of a component to 1.
SCALE = 1024


def quantised(df: DataFrame, id_col: str, vec_col: str, shift: int = 0) -> DataFrame:
    """``vec_id, x``: each component ``c`` as the whole number ``floor(1024 c) + shift``.

    Vectors that are null, or hold null or components that are not finite, are left out.
    """
    v = col(vec_col).cast("array<double>")
    # NaN is above every number, so the comparison is false for it too.
    whole = F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    return df.where(whole).select(col(id_col).alias("vec_id"), F.transform(v, lambda c: F.floor(c * SCALE) + shift).alias("x"))


def matrix(lists: pa.Array, width: int, fill: int = 0) -> np.ndarray:
    """Lists of whole numbers as the rows of a matrix; shorter ones are filled up."""
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.full((len(sizes), width), fill, np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of at most ``rows``, the last of which may be smaller."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            held.append(part)
            n += part.num_rows
            batch = batch.slice(part.num_rows)
            if n == rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
