"""Vectors of numbers as exact integer codes, in batches of NumPy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Codes take the narrowest of these types that holds the whole vector, so that equal vectors have equal codes.
WIDTHS = ("<i2", "<i4", "<i8")
#: Integers from this on are an error: sums of their products would fit no decimal.
LARGEST = 2.0**61


def coded(vectors: DataFrame, id_col: str, vector_col: str, scale: int, dims: int | None = None) -> DataFrame:
    """``(id, dims, code)`` of the rows whose vector is not NULL and has finite entries only, ``dims`` of them if given.

    ``code`` holds ``floor(scale * entry)`` for each entry, as integers in bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            lengths = pc.fill_null(pc.list_value_length(lists), -1).to_numpy()
            entries = pc.fill_null(lists.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
            starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
            for length in np.unique(lengths):
                if length < 0 or dims is not None and length != dims:
                    continue
                rows = np.flatnonzero(lengths == length)
                matrix = entries[starts[rows, None] + np.arange(length)]
                finite = np.isfinite(matrix).all(axis=1)
                rows, matrix = rows[finite], np.floor(scale * matrix[finite])
                if matrix.size and np.abs(matrix).max() >= LARGEST:
                    raise OverflowError(f"an entry times {scale} is not below {LARGEST:.0f}")
                ids = batch.column(0).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.full(len(rows), length, np.int32)), pa.array(encode(matrix.astype(np.int64)), pa.binary())],
                    names=["id", "dims", "code"],
                )

    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    return rows.mapInArrow(run, f"id {vectors.schema[id_col].dataType.simpleString()}, dims int, code binary")


def encode(matrix: np.ndarray) -> list[bytes]:
    if not matrix.size:
        return [b""] * len(matrix)
    top = np.maximum(matrix.max(axis=1), ~matrix.min(axis=1))
    width = np.searchsorted([2**15, 2**31], top, side="right")
    narrow = matrix.astype(WIDTHS[0])
    return [narrow[i].tobytes() if not w else matrix[i].astype(WIDTHS[w]).tobytes() for i, w in enumerate(width.tolist())]


def decode(codes: list[bytes], dims: int) -> np.ndarray:
    """The integers of codes that all have ``dims`` entries, one row each."""
    if not dims or not codes:
        return np.zeros((len(codes), dims), np.int64)
    kinds = {2 * dims: WIDTHS[0], 4 * dims: WIDTHS[1], 8 * dims: WIDTHS[2]}
    if len({len(c) for c in codes}) == 1:
        return np.frombuffer(b"".join(codes), kinds[len(codes[0])]).reshape(-1, dims).astype(np.int64)
    return np.array([np.frombuffer(c, kinds[len(c)]) for c in codes], np.int64)


def by_dims(batch: pa.RecordBatch, dims_at: int, code_at: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(dims, places, matrix)``: the batch's vectors by length, at most ``most`` at a time, with their places in the batch."""
    lengths, codes = batch.column(dims_at).to_numpy(), batch.column(code_at)
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        for start in range(0, len(rows), most):
            some = rows[start : start + most]
            yield length, some, decode(codes.take(pa.array(some)).to_pylist(), length)
