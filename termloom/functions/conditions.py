"""Predicates that treat null as one more value, and conditional expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def differs(column: Column, value) -> Column:
    """``column`` is not ``value``; a null differs from every value."""
    return ~column.eqNullSafe(F.lit(value))


def not_among(column: Column, values: Iterable) -> Column:
    """``column`` is none of ``values``; a null is none of them."""
    return column.isNull() | ~column.isin(list(values))


def contains_any(column: Column, parts: Sequence[str]) -> Column:
    """Null-safe: a null text contains nothing."""
    hit = reduce(lambda a, b: a | b, [column.contains(p) for p in parts])
    return F.coalesce(hit, F.lit(False))


def first_match(rules: Sequence[tuple[Column, object]], otherwise=None) -> Column:
    """The value of the first rule whose condition holds; null (not a text) by default."""
    chain = F
    for condition, value in rules:
        chain = chain.when(condition, value if isinstance(value, Column) else F.lit(value))
    return chain.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def mapped(column: Column, table: Mapping) -> Column:
    """Whole-value replacement from a small fixed table; other values pass through."""
    return F.coalesce(codes(column, table), column)


def codes(column: Column, table: Mapping) -> Column:
    """Value -> code from a small fixed table; values outside the table give null."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), column)


def first_known(*columns: Column) -> Column:
    return F.coalesce(*columns)


def row_sum(columns: Sequence[Column]) -> Column:
    """Sum of the values that are known; 0 when none is."""
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in columns])


def row_mean(columns: Sequence[Column]) -> Column:
    """Mean of the values that are known; null when none is."""
    known = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in columns])
    return F.try_divide(row_sum(columns).cast("double"), known)


def row_max(columns: Sequence[Column]) -> Column:
    return F.greatest(*columns) if len(columns) > 1 else columns[0]
