"""Which columns are numeric, which are categorical, and which are left alone."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

from tabloom.functions.columns import ref


@dataclass(frozen=True)
class ColumnRoles:
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    other: tuple[str, ...]
    label: str | None = None

    def without(self, names: Iterable[str]) -> "ColumnRoles":
        gone = set(names)
        return ColumnRoles(
            tuple(c for c in self.numeric if c not in gone),
            tuple(c for c in self.categorical if c not in gone),
            tuple(c for c in self.other if c not in gone),
            self.label,
        )


def _is_numeric(dtype: T.DataType, strict: bool) -> bool:
    if strict:
        return isinstance(dtype, (T.IntegerType, T.DoubleType))
    return isinstance(dtype, T.NumericType)


def column_roles(df: DataFrame, label: str | None = None, strict: bool = False) -> ColumnRoles:
    """Roles by column type, in schema order, the label left out.

    ``strict`` admits only int and double as numeric; the default admits every numeric type.
    """
    numeric, categorical, other = [], [], []
    for field in df.schema.fields:
        if field.name == label:
            continue
        if _is_numeric(field.dataType, strict):
            numeric.append(field.name)
        elif isinstance(field.dataType, (T.StringType, T.BooleanType)):
            categorical.append(field.name)
        else:
            other.append(field.name)
    return ColumnRoles(tuple(numeric), tuple(categorical), tuple(other), label)


def numeric_columns(df: DataFrame, label: str | None = None, strict: bool = False) -> list[str]:
    return list(column_roles(df, label, strict).numeric)


def categorical_columns(df: DataFrame, label: str | None = None) -> list[str]:
    return list(column_roles(df, label).categorical)


def cast_to_roles(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    """Numeric columns as double and categorical columns as string; the rest unchanged.

    Sums of integers cannot overflow afterwards, and booleans can be indexed like text.
    """
    numeric, categorical = set(roles.numeric), set(roles.categorical)

    def typed(name: str):
        if name in numeric:
            return ref(name).cast("double").alias(name)
        if name in categorical:
            return ref(name).cast("string").alias(name)
        return ref(name)

    return df.select([typed(c) for c in df.columns])


def role_table(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    """One row per column: its role and how many rows hold a value, from one pass."""
    named = [(c, r) for r in ("numeric", "categorical", "other") for c in getattr(roles, r)]
    counts = df.agg(*[F.count(ref(c)).alias(c) for c, _ in named])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(r).alias("role"), ref(c).alias("n_present"))
            for c, r in named]
    return counts.select(F.inline(F.array(*rows)))
