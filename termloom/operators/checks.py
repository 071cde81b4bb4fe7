"""The consistency checks of the jobs, each as a one-row DataFrame ``check, failures``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.operators.summaries import missing, uniqueness, value_counts


def unique_key(df: DataFrame, keys: Sequence[str], name: str = "unique_key") -> DataFrame:
    return uniqueness(df, keys).select(
        F.lit(name).alias("check"), (F.col("n_rows") - F.col("n_keys")).alias("failures")
    )


def no_rows(df: DataFrame, condition: Column, name: str) -> DataFrame:
    """No row may satisfy ``condition``."""
    return df.agg(F.count_if(condition).alias("failures")).select(F.lit(name).alias("check"), "failures")


def parts_add_up(df: DataFrame, total: str, parts: Sequence[str], name: str = "parts_add_up") -> DataFrame:
    whole = sum((F.coalesce(F.col(c), F.lit(0)) for c in parts), F.lit(0))
    return no_rows(df, ~F.col(total).eqNullSafe(whole), name)


def same_keys(before: DataFrame, after: DataFrame, keys: Sequence[str], name: str = "same_keys") -> DataFrame:
    """Keys of ``before`` that a step has lost."""
    lost = before.select(*keys).distinct().join(after.select(*keys), list(keys), "left_anti")
    return lost.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(name).alias("check"), "failures")


def frequency_complete(df: DataFrame, column: str, name: str = "frequency_complete") -> DataFrame:
    """The frequency table and the missing values together hold every row."""
    listed = value_counts(df, column).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("listed"))
    rows = df.agg((F.count(F.lit(1)) - F.count_if(missing(df, column))).alias("known"))
    return rows.select(F.lit(name).alias("check"), F.abs(F.col("known") - listed.scalar()).alias("failures"))
