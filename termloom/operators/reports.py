"""Outcome tables: counts and rates by programme, area, cohort and year reached."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTCOME_COLUMNS = {
    "y_active": "active",
    "y_graduate": "graduate",
    "y_inv_desert": "involuntary desertion",
    "y_vol_desert": "voluntary desertion",
}


def outcome_counts(
    entities: DataFrame, by: str, label: str = "y", name_of: str | None = None
) -> DataFrame:
    """Entities and outcomes per group, with the sum of the parts and what it misses.

    ``name_of`` adds the sorted distinct names of the group as one text; names are made
    distinct by an aggregate of their own first, so the text grows with names, not rows.
    """
    counts = entities.filter(F.col(by).isNotNull()).groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(label) == v).alias(c) for c, v in OUTCOME_COLUMNS.items()],
    )
    total = sum((F.col(c) for c in OUTCOME_COLUMNS), F.lit(0).cast("long"))
    counts = counts.withColumn("y_sum", total).withColumn("dif", F.col("n") - F.col("y_sum"))
    if name_of is None:
        return counts
    names = (
        entities.select(by, name_of).dropna().distinct()
        .groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(name_of)), "|").alias("names"))
    )
    return counts.join(names, by, "left")


def outcome_rates(counts: DataFrame) -> DataFrame:
    """Completion as a share, voluntary dropout as percent, and whether the parts add up."""
    return counts.withColumns(
        {
            "completion_rate": F.try_divide("y_graduate", "n"),
            "dropout_rate": F.try_divide("y_vol_desert", "n") * 100,
            "check": F.when(F.col("dif") == 0, 0).otherwise(1),
        }
    )


def share_of(part: str, columns: Sequence[str]) -> Column:
    """``part`` as percent of the sum of ``columns``."""
    whole = sum((F.col(f"`{c}`") for c in columns), F.lit(0).cast("long"))
    return F.try_divide(F.col(f"`{part}`"), whole) * 100
