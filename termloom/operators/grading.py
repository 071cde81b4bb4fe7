"""Grades: normalisation, status, indicator columns and the term table built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions import codes as fixed
from termloom.functions.columns import indicator
from termloom.functions.conditions import first_match
from termloom.operators.panel import grouped_terms

STATUSES = list(fixed.STATUS_GRADES)


def normalised_grade(grade: Column) -> Column:
    """Withdrawals to R, transfers and exemptions to CO, incomplete to OTH."""
    return first_match(
        [
            (grade.isin(fixed.WITHDRAWAL_GRADES), "R"),
            (grade.isin(fixed.TRANSFER_GRADES), "CO"),
            (grade.isin(fixed.OTHER_GRADES), "OTH"),
        ],
        otherwise=grade,
    )


def grade_status(grade: Column) -> Column:
    """passed, failed, withdrawn or other; null for a missing or unknown grade."""
    return first_match([(grade.isin(letters), s) for s, letters in fixed.STATUS_GRADES.items()])


def grade_column_name(grade: str) -> str:
    return "grade_" + grade.lower().replace("+", "_plus")


def with_grade_status(enrolment: DataFrame, grade: str = "grade_orig", credits: str = "credits") -> DataFrame:
    """Normalised grade, status, a 0/1 column per grade and status, credits per status."""
    df = enrolment.withColumn("grade", normalised_grade(F.col(grade)))
    df = df.withColumn("grade_status", grade_status(F.col("grade")))
    df = df.withColumns(
        {s: indicator(F.col("grade_status") == s) for s in STATUSES}
        | {grade_column_name(g): indicator(F.col("grade") == g) for g in fixed.GRADE_COLUMNS}
        | {"grade_nan": indicator(F.col("grade").isNull())}
    )
    return df.withColumns(
        {f"credits_{s}": F.col(s) * F.col(credits) for s in STATUSES}
        | {"credits_nan": F.col("grade_nan") * F.col(credits)}
    )


def term_sums(credits: str = "credits") -> dict[str, Column]:
    """The 20 sums of the term table."""
    sums = {"credits_total": F.col(credits)}
    sums |= {f"{s}_quant": F.col(s) for s in STATUSES}
    sums |= {"grade_nan_quant": F.col("grade_nan")}
    sums |= {f"credits_{s}": F.col(f"credits_{s}") for s in [*STATUSES, "nan"]}
    sums |= {
        grade_column_name(g).replace("grade_", "grades_"): F.col(grade_column_name(g))
        for g in fixed.GRADE_COLUMNS
    }
    return sums


def term_rollup(graded: DataFrame, keys: Sequence[str] = ("id", "year", "trim")) -> DataFrame:
    """Enrolments to one row per entity and term. Sums only, so rows are reduced before the
    shuffle; lists are a separate operator (``summaries.counted_lists``)."""
    return grouped_terms(graded, keys, term_sums())
