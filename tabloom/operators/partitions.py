"""Partitioning of tables that are read many times."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

# Rows that keep a core busy for much longer than it takes to start a task.
ROWS_PER_TASK = 50_000
# More rows per core than this come in enough row groups, however few the files are.
MOST_ROWS_PER_CORE = 5_000_000
# A fit keeps some 250 bytes of a row: more rows than this in a partition make a task that grows with the table.
MOST_ROWS_PER_TASK = 1_000_000


def even_partitions(df: DataFrame, rows_per_task: int | None = None) -> int | None:
    """Partitions that suit a small table in few files; None for any other table.

    Fewer files than cores leave cores idle.  A table in many files, or without files to count, is left
    as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not 0 < len(df.inputFiles()) < cores:
        return None
    rows = df.count()
    if rows > cores * MOST_ROWS_PER_CORE:
        return None
    return max(1, min(cores, -(-rows // (rows_per_task or ROWS_PER_TASK))), -(-rows // MOST_ROWS_PER_TASK))


def bounded_partitions(df: DataFrame) -> int | None:
    """Partitions of at most ``MOST_ROWS_PER_TASK`` rows; None if the table's own hold no more, or if it has no files."""
    if not df.inputFiles():
        return None
    sizes = df.groupBy(F.spark_partition_id().alias("part")).count()
    most, rows = sizes.agg(F.max("count"), F.sum("count")).first()
    return -(-rows // MOST_ROWS_PER_TASK) if (most or 0) > MOST_ROWS_PER_TASK else None


def spread(df: DataFrame, rows_per_task: int | None = None, bounded: bool = False) -> DataFrame:
    """``df`` over as many cores as its rows can use, if it is small and comes from few files.

    ``bounded`` also deals out a large table, so that no partition grows with it: for rows that fits keep."""
    partitions = even_partitions(df, rows_per_task) or (bounded_partitions(df) if bounded else None)
    return df.repartition(partitions) if partitions else df


@contextmanager
def kept(df: DataFrame, rows_per_task: int | None = None) -> Iterator[DataFrame]:
    """``df`` spread and kept for many passes, however large it is: for few columns that cost more to compute than to keep."""
    copy = spread(df, rows_per_task, bounded=True).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield copy
    finally:
        copy.unpersist()


@contextmanager
def working_copy(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` for several passes: spread and kept if it is small, else read anew each time.

    Columnar files give a pass the few columns it needs; a copy of a large table would not be cheaper.
    """
    partitions = even_partitions(df)
    if not partitions:
        yield df
        return
    copy = df.repartition(partitions).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield copy
    finally:
        copy.unpersist()
