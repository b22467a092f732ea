"""Reading input tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tabloom.functions.columns import ref


def dataset_path(root: str, name: str, train_only: bool | str = False) -> str:
    """Path of a dataset, or of its training part; the flag may be text from a command line."""
    flags = {True: True, False: False, "True": True, "False": False}
    if train_only not in flags:
        raise ValueError(f"train_only must be True or False, not {train_only!r}")
    suffix = "-train" if flags[train_only] else ""
    return f"{root.rstrip('/')}/{name}{suffix}.parquet"


def load_table(spark: SparkSession, root: str, name: str, columns: Sequence[str] | None = None,
               train_only: bool | str = False) -> DataFrame:
    """A Parquet table, reduced to ``columns`` at the scan."""
    df = spark.read.parquet(dataset_path(root, name, train_only))
    return df.select([ref(c) for c in columns]) if columns is not None else df
