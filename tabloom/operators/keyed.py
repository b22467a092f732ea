"""Attach a table with one row per key to a large, possibly skewed table.

Three ways, chosen by measured size:

* a lookup of few rows and bytes is broadcast;
* otherwise keys that hold more than one ten-thousandth of all rows are "hot".  There are at most ten
  thousand of them, together no larger than ten thousand average rows, so they are broadcast, and their
  rows never meet in one task;
* the rest is joined by shuffle, where no key holds more than one ten-thousandth of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from tabloom.functions.columns import ref
from tabloom.operators.scratch import checkpointed

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
HOT_SHARE = 10_000
SPREAD = 4096


@dataclass
class Lookup:
    """A table with unique ``key``, per-key row count ``n`` and further columns."""

    frame: DataFrame
    key: str
    small: bool
    total: int

    @property
    def values(self) -> list[str]:
        return [c for c in self.frame.columns if c != self.key]


def measure(frame: DataFrame, key: str, rows: int | None = None, max_bytes: int = BROADCAST_BYTES,
            stored: bool = False) -> Lookup:
    """Fix the lookup table: as local rows when it is small, as a checkpoint when it is not.

    ``stored`` says that the table is read from files already and needs no checkpoint.
    """
    rows = BROADCAST_ROWS if rows is None else rows
    frame = frame.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        width = 16 * len(frame.columns)
        size = frame.agg(
            F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.sum(F.octet_length(ref(key).cast("string")) + width), F.lit(0)).alias("bytes"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
        small = size["rows"] <= rows and size["bytes"] <= max_bytes
        if stored:
            fixed = None
        elif small:
            fixed = frame.sparkSession.createDataFrame(frame.toArrow(), frame.schema)
        else:
            fixed = checkpointed(frame)
    finally:
        frame.unpersist()
    return Lookup(frame if fixed is None else fixed, key, small, size["total"])


def numeric_lookup(frame: DataFrame, key: str, rows: int, total: int) -> Lookup:
    """A lookup of known length that holds numbers only and is stored already."""
    small = rows <= BROADCAST_ROWS and rows * 16 * len(frame.columns) <= BROADCAST_BYTES
    return Lookup(frame, key, small, total)


def attach(df: DataFrame, lookup: Lookup, on: str | None = None) -> DataFrame:
    """``df`` with the lookup's value columns; NULL where the key is not in the lookup.

    Every row of ``df`` is kept once.  Keys are compared null-safely, so the NULL group finds its
    statistics too.
    """
    on = on or lookup.key
    values = lookup.values
    if lookup.small:
        return _left_join(df, lookup.frame, on, lookup.key, values)
    hot_frame, cold_frame = split_hot(lookup)
    hot_names = [f"__hot_{v}" for v in values]
    hot = hot_frame.select(ref(lookup.key), *[ref(v).alias(h) for v, h in zip(values, hot_names)])
    joined = _left_join(df, hot, on, lookup.key, hot_names)
    # The task number spreads copies of one row; it is the same when a task is retried.
    spread = F.pmod(F.xxhash64(F.spark_partition_id(), *[ref(c) for c in _hashable(df)]), F.lit(SPREAD)) + 1
    salt = F.when(ref("__hot_n").isNotNull(), spread).otherwise(F.lit(0).cast("bigint"))
    joined = joined.withColumn("__place", F.xxhash64(ref(on), salt))
    # The place is a hash of key and salt, so that the salt takes part in the partitioning; a constant
    # salt column would be optimised into a filter.
    cold = cold_frame.select(ref(lookup.key).alias("__key"),
                             F.xxhash64(ref(lookup.key), F.lit(0).cast("bigint")).alias("__cold_place"),
                             *[ref(v).alias(f"__cold_{v}") for v in values])
    joined = joined.join(
        cold, (ref("__place") == ref("__cold_place")) & ref(on).eqNullSafe(ref("__key")), "left")
    merged = [F.coalesce(ref(f"__hot_{v}"), ref(f"__cold_{v}")).alias(v) for v in values]
    return joined.select(*[ref(c) for c in df.columns], *merged)


def split_hot(lookup: Lookup) -> tuple[DataFrame, DataFrame]:
    """The keys with more than their share of rows, and the others."""
    limit = lookup.total / HOT_SHARE
    return lookup.frame.filter(F.col("n") > limit), lookup.frame.filter(F.col("n") <= limit)


def _left_join(df: DataFrame, right: DataFrame, on: str, key: str, values: Sequence[str]) -> DataFrame:
    right = F.broadcast(right.select(ref(key).alias("__key"), *[ref(v) for v in values]))
    joined = df.join(right, ref(on).eqNullSafe(ref("__key")), "left")
    return joined.select(*[ref(c) for c in df.columns], *[ref(v) for v in values])


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant", "udt")
            and not hasattr(f.dataType, "sqlType")]
