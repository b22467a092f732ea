"""What counts as a missing value, by column type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F, types as T

from tabloom.functions.columns import is_float, ref

# Text markers that stand for a missing value.
MISSING_MARKERS = ("?", "None", "Null")


def is_missing(name: str, dtype: T.DataType, match: str = "contains") -> Column:
    """TRUE where the value is missing, never NULL.

    Text is missing when it is NULL, empty, spells NaN, or holds one of the markers: anywhere in the
    text with ``match="contains"``, as the whole trimmed text with ``match="exact"``.  Floating point
    columns are missing when NULL or NaN, all other types only when NULL.
    """
    value = ref(name)
    if isinstance(dtype, T.StringType):
        if match == "contains":
            marked = reduce(lambda a, b: a | b, [value.contains(m) for m in MISSING_MARKERS])
        elif match == "exact":
            marked = F.trim(value).isin(*MISSING_MARKERS)
        else:
            raise ValueError(f"match must be 'contains' or 'exact', not {match!r}")
        blank = (value == "") | (F.lower(F.trim(value)) == "nan")
        return value.isNull() | F.coalesce(marked | blank, F.lit(False))
    if is_float(dtype):
        return value.isNull() | F.coalesce(F.isnan(value), F.lit(False))
    return value.isNull()
