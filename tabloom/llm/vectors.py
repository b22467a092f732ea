"""Vectors in blocks: which rows take part, and a set of queries against all rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def whole(vector: str) -> Column:
    """True where the vector has no NULL, NaN or infinite component."""
    return F.col(vector).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def matrix(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """A row for each vector, as doubles; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    width = max(int(sizes.max(initial=0)), 1) if width is None else width
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, at] = flat
    return out


def against_all(rows: DataFrame, queries: DataFrame, search: Callable[[pa.Table, pa.Table], pa.Table], schema: str,
                n_rows: int, n_queries: int, row_block: int = 8192, query_block: int = 1024) -> DataFrame:
    """``search(block of rows, block of queries)`` for every pair of blocks; blocks are drawn by a hash of vec_id, so that
    their sizes don't depend on the data.  Each row is sent once for each block of queries and each query once for
    each block of rows, and no pair of rows is ever made outside a task."""
    nr, nq = max(1, -(-n_rows // row_block)), max(1, -(-n_queries // query_block))
    draw = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("rb", draw(nr)).withColumn("qb", every(nq))
    right = queries.withColumn("qb", draw(nq)).withColumn("rb", every(nr))
    return (left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb"))
            .applyInArrow(lambda a, b: search(a, b) if a.num_rows and b.num_rows else search(a.slice(0, 0), b.slice(0, 0)),
                          schema))
