"""Small helpers for naming and typing columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T


def ref(name: str) -> Column:
    """Reference a column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_number(name: str) -> Column:
    """The column as a double, with NaN read as NULL."""
    value = ref(name).cast("double")
    return F.when(~F.isnan(value), value)


def as_text(name: str) -> Column:
    return ref(name).cast("string")


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))
