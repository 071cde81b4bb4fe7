"""Choosing and naming columns, and building blocks for projections."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def rewrite_names(df: DataFrame, *, lower: bool = False, replace: Mapping[str, str] | None = None) -> DataFrame:
    """Rewrite all column names at once: lower case, then literal replacements in order."""
    names = []
    for name in df.columns:
        new = name.lower() if lower else name
        for old, sub in (replace or {}).items():
            new = new.replace(old, sub)
        names.append(new)
    return df.toDF(*names)


def flatten_names(df: DataFrame, separator: str = "_", swap: bool = False) -> DataFrame:
    """Turn struct columns ``a{x, y}`` into ``a_x, a_y`` (or ``x_a, y_a`` with ``swap``)."""
    picked = []
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StructType):
            for inner in field.dataType.names:
                parts = (inner, field.name) if swap else (field.name, inner)
                picked.append(F.col(f"`{field.name}`.`{inner}`").alias(separator.join(parts)))
        else:
            picked.append(F.col(f"`{field.name}`"))
    return df.select(*picked)


def sort_columns(df: DataFrame, first: Iterable[str] = ()) -> DataFrame:
    head = list(first)
    return df.select(*head, *sorted(c for c in df.columns if c not in head))


def names_containing(df: DataFrame, *include: str, exclude: Iterable[str] = ()) -> list[str]:
    """Names holding any of ``include`` and none of ``exclude``."""
    barred = list(exclude)
    return [
        c for c in df.columns
        if any(part in c for part in include) and not any(part in c for part in barred)
    ]


def names_of_type(df: DataFrame, *kinds: type[T.DataType], negate: bool = False) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) != negate]


def numeric_names(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    barred = set(exclude)
    return [c for c in names_of_type(df, T.NumericType) if c not in barred]


def with_prefix(df: DataFrame, prefix: str, keep: Iterable[str] = ()) -> DataFrame:
    kept = set(keep)
    return df.toDF(*[c if c in kept else prefix + c for c in df.columns])


def indicator(condition: Column) -> Column:
    """1 where the condition is true, 0 where it is false or unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def dummies(column: str, values: Iterable[str], prefix: str) -> dict[str, Column]:
    """One 0/1 column per value; nulls carry 0 everywhere."""
    return {prefix + str(v): indicator(F.col(column) == F.lit(v)) for v in values}
