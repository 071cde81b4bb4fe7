"""Row selection, de-duplication and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.operators.spread import key_counts, left_join_spread


def union_tables(*tables: DataFrame) -> DataFrame:
    """All rows of all tables, columns matched by name."""
    first, *rest = tables
    for table in rest:
        first = first.unionByName(table)
    return first


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep one whole row per key: the one that comes first in ``order``, known values before nulls.

    An aggregate, not a row number: rows are reduced before the shuffle, so a key with very
    many rows costs no more than any other.
    """
    rest = [c for c in df.columns if c not in keys]
    known_first = [x for i, c in enumerate(order) for x in (F.col(c).isNull().alias(f"_null{i}"), F.col(c))]
    best = F.min(F.struct(*known_first, *[F.col(c) for c in rest if c not in order])).alias("_best")
    return (
        df.groupBy(*keys).agg(best)
        .select(*[F.col(c) if c in keys else F.col(f"_best.`{c}`").alias(c) for c in df.columns])
    )


def flag_repeated(df: DataFrame, keys: Sequence[str], spread: Sequence[str], name: str = "dup") -> DataFrame:
    """Mark every row whose key occurs more than once. Nulls count as equal to each other."""
    keyed = df.withColumn("_key", F.struct(*keys))  # a struct of nulls is itself no null
    counts = key_counts(keyed, ["_key"])
    repeated = counts.filter("_n > 1").select("_key", F.lit(True).alias(name))
    marked = left_join_spread(keyed, repeated, ["_key"], spread, counts=counts)
    return marked.withColumn(name, F.coalesce(F.col(name), F.lit(False))).drop("_key")


def split_population(df: DataFrame, label: str, open_values: Sequence) -> tuple[DataFrame, DataFrame]:
    """Rows still open (label null or one of ``open_values``) and rows with a final label."""
    is_open = F.col(label).isNull() | F.col(label).isin(list(open_values))
    return df.filter(is_open), df.filter(~is_open)


def override_cells(df: DataFrame, key: str, column: str, corrections: dict) -> DataFrame:
    """Point corrections, written out by hand, of one column by key."""
    fixed = F.create_map(*[F.lit(x) for item in corrections.items() for x in item])
    return df.withColumn(column, F.coalesce(F.try_element_at(fixed, F.col(key)), F.col(column)))


def null_outside(column: Column, low=None, high=None, missing=None) -> Column:
    """Null out values below ``low``, above ``high`` or equal to ``missing``."""
    bad = F.lit(False)
    if low is not None:
        bad = bad | (column < low)
    if high is not None:
        bad = bad | (column > high)
    if missing is not None:
        bad = bad | (column == missing)
    return F.when(~bad, column)
