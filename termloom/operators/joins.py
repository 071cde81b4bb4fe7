"""Left-join forms on top of the Spark join. Size decides between broadcast and shuffle:
tables read from files are broadcast by Spark only below its own size threshold, lookups
derived from data go through ``spread.lookup_join``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators.spread import left_join_spread, lookup_join


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str = "_in") -> DataFrame:
    """Left join; columns both sides have get ``suffix`` on the right."""
    clash = {c: c + suffix for c in right.columns if c in left.columns and c not in keys}
    return left.join(right.withColumnsRenamed(clash), list(keys), "left")


def attach_on(
    left: DataFrame, right: DataFrame, pairs: Mapping[str, str], suffix: str = "_in"
) -> DataFrame:
    """Left join on differently named keys (``{left: right}``); the right keys are kept."""
    clash = {c: c + suffix for c in right.columns if c in left.columns}
    renamed = right.withColumnsRenamed(clash)
    condition = [left[a] == renamed[clash.get(b, b)] for a, b in pairs.items()]
    return left.join(renamed, condition, "left")


def attach_marked(
    left: DataFrame, right: DataFrame, keys: Sequence[str], name: str = "_merge"
) -> DataFrame:
    """Left join with a column that says ``both`` or ``left_only``."""
    marked = right.withColumn(name, F.lit("both"))
    return left.join(marked, list(keys), "left").withColumn(
        name, F.coalesce(F.col(name), F.lit("left_only"))
    )


def attach_checked(
    left: DataFrame, right: DataFrame, on: str, compare: Sequence[str], flag: str = "new"
) -> DataFrame:
    """Left join on ``on`` where both sides also carry the columns in ``compare``.

    ``flag`` is 0 where all of them are equal and 1 where they differ or the right side is
    missing; the right copies are dropped.
    """
    twins = right.withColumnsRenamed({c: f"_{c}" for c in compare})
    same = F.lit(True)
    for c in compare:
        same = same & F.coalesce(F.col(c) == F.col(f"_{c}"), F.lit(False))
    return (
        left.join(twins, on, "left")
        .withColumn(flag, F.when(same, 0).otherwise(1))
        .drop(*[f"_{c}" for c in compare])
    )


def keep_known(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose key occurs in ``right``."""
    return left.join(right.select(*keys), list(keys), "left_semi")


def map_values(
    df: DataFrame, column: str, mapping: DataFrame, raw: str, clean: str, spread: Sequence[str]
) -> DataFrame:
    """Whole-value replacement from a two-column table; unmapped values pass through."""
    lookup = mapping.select(F.col(raw).alias(column), F.col(clean).alias("_clean"))
    joined = left_join_spread(df, lookup, [column], spread)
    return joined.withColumn(column, F.coalesce("_clean", column)).select(*df.columns)


def fill_from_groups(
    df: DataFrame, column: str, groups: DataFrame, keys: Sequence[str], value: str, spread: Sequence[str]
) -> DataFrame:
    """Fill nulls of ``column`` with the value its group has in ``groups``."""
    lookup = groups.select(*keys, F.col(value).alias("_fill"))
    return (
        lookup_join(df, lookup, keys, spread)
        .withColumn(column, F.coalesce(column, "_fill"))
        .select(*df.columns)
    )
