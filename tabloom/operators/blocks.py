"""Rows as matrices: blocks of a feature vector and a label, and sums over all blocks.

A pass over the blocks multiplies matrices in Python tasks; what a task sends on is one array, as large as what it sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tabloom.functions.columns import ref

#: Numbers of a block at most, but for single rows that are wider.
BLOCK = 1 << 19
#: Tasks whose sums are added before they reach the driver.
TOGETHER = 64


def blocks_of(df: DataFrame, features: str, label: str | None = None) -> DataFrame:
    """Blocks (rows, x, y) of the vectors, as bytes of doubles; y has a zero for each row if there is no label."""
    y = F.lit(0.0) if label is None else ref(label).cast("double")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            step = max(1, BLOCK // max(1, x.shape[1]))
            for low in range(0, len(x), step):
                part = x[low:low + step]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(part)], pa.int32()), pa.array([part.astype("<f8").tobytes()]),
                     pa.array([labels[low:low + step].astype("<f8").tobytes()])], ["rows", "x", "y"])

    return df.select(vector_to_array(ref(features)).alias("x"), y.alias("y")).mapInArrow(pack, "rows int, x binary, y binary")


def kept_blocks(df: DataFrame, features: str, label: str | None = None) -> RDD:
    """The blocks as (rows, x, y), kept for many passes.  Iterations over small data are short, and a job over kept tuples
    starts in half the time of a query."""
    return blocks_of(df, features, label).rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)


def block_sums(blocks: RDD, of_block: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum of ``of_block(x, y)``, an array of one shape, over all blocks; None if there is no block.

    Sums are added in the order of the partitions; tasks' sums meet in groups of neighbours first, so that the driver gets few."""
    def task(part: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        total = None
        for n, x, y in rows:
            found = of_block(np.frombuffer(x, "<f8").reshape(n, -1), np.frombuffer(y, "<f8"))
            total = found if total is None else total + found
        return iter([] if total is None else [(part, total)])

    def added(found: Iterable[tuple]) -> np.ndarray:
        return reduce(np.add, [total for _, total in sorted(found, key=lambda r: r[0])])

    parts = blocks.mapPartitionsWithIndex(task)
    if blocks.getNumPartitions() > TOGETHER:
        parts = parts.map(lambda r: (r[0] // TOGETHER, r)).groupByKey().mapValues(added)
    found = parts.collect()
    return added(found) if found else None
