"""Category codes learned from data. A fitted encoder is a table (value, code), so its
vocabulary is never held by the driver and is stored like any other table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions import codes as fixed
from termloom.functions.conditions import codes
from termloom.operators.spread import lookup_join, ranked
from termloom.session import checkpointed


def fit_labels(df: DataFrame, column: str) -> DataFrame:
    """Known values in alphabetical order with codes 0, 1, 2..."""
    values = df.select(F.col(column).alias("value")).dropna().distinct()
    return checkpointed(ranked(values, ["value"], "code"))


def encode_labels(
    df: DataFrame,
    column: str,
    table: DataFrame,
    name: str,
    spread: Sequence[str] = ("id",),
    offset: int = 0,
) -> DataFrame:
    """Replace values by their codes plus ``offset``. Missing and unseen values share the
    first code after the last one. ``table`` is a stored table, as ``fit_labels`` gives it."""
    lookup = table.select(F.col("value").alias(column), F.col("code").alias("_code"))
    unseen = table.count()
    joined = lookup_join(df, lookup, [column], spread, stored=True)
    return joined.withColumn(name, (F.coalesce("_code", F.lit(unseen)) + offset).cast("int")).drop("_code")


def condition_code(condition: Column) -> Column:
    return codes(condition, fixed.CONDITION_CODES)


def area_code(area: Column) -> Column:
    return codes(area, fixed.AREA_CODES)


def sex_code(sex: Column) -> Column:
    return codes(sex, fixed.SEX_CODES)
