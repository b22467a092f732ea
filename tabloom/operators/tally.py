"""Value counts: the shared basis of modes, cardinalities, category labels and ranks.

All columns are counted in one job.  The count combines on the map side, so a value that fills a third
of the table reaches the shuffle as one row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabloom.functions.columns import as_number, as_text, ref
from tabloom.functions.missing import is_missing


def count_values(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """Rows (column, value, n) for named expressions of one type; NULLs are not counted."""
    wide = df.select([expression.alias(name) for name, expression in values.items()])
    long = wide.unpivot([], [ref(name) for name in values], "column", "value")
    return long.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"))


def present_text(df: DataFrame, columns: Sequence[str], match: str = "contains") -> dict[str, Column]:
    """Categorical values with the missing ones set to NULL."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return {c: F.when(~is_missing(c, types[c], match), as_text(c)) for c in columns}


def present_numbers(columns: Sequence[str]) -> dict[str, Column]:
    return {c: as_number(c) for c in columns}


def most_frequent(counts: DataFrame) -> DataFrame:
    """Rows (column, value, n): the most frequent value of each column, the smallest on a tie."""
    best = F.min(F.struct((-F.col("n")).alias("negated"), F.col("value").alias("value")))
    return counts.groupBy("column").agg(best.alias("best")).select(
        "column", F.col("best.value").alias("value"), (-F.col("best.negated")).alias("n"))


def distinct_counts(counts: DataFrame) -> DataFrame:
    """Rows (column, n_distinct)."""
    return counts.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))


def max_count_distinct(df: DataFrame, columns: Sequence[str], floor: int = 2) -> int:
    """One more than the largest number of distinct values, at least ``floor``; the tree learners'
    ``maxBins``."""
    if not columns:
        return floor
    counts = count_values(df, {c: as_text(c) for c in columns})
    top = distinct_counts(counts).agg(F.max("n_distinct")).first()[0]
    return max(floor, (top or 0) + 1)
