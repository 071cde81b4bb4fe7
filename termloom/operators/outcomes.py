"""Outcome labels, year buckets, targets and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions import codes as fixed
from termloom.functions.columns import indicator
from termloom.functions.conditions import codes, contains_any, first_match

DROPOUTS = ["involuntary desertion", "voluntary desertion"]


def graduated(grad_date: Column) -> Column:
    return indicator(grad_date.isNotNull())


def changed_since_entry(program: Column, program_in: Column) -> Column:
    """0 where both are known and equal, 1 otherwise."""
    return 1 - indicator(program == program_in)


def outcome(
    grad: Column,
    last_termid: Column,
    condition: Column,
    terms_out: Column,
    current_terms: list[str],
    suspended_from: int = 4,
    away_from: int = 2,
) -> Column:
    """The rule table, first match wins.

    graduate > active > involuntary (separated) > suspended long or short > voluntary after
    ``away_from`` terms. Entities out for less keep a null: they may still return.
    """
    separated = contains_any(condition, fixed.SEPARATION_MARKS)
    suspended = contains_any(condition, fixed.SUSPENSION_MARKS)
    return first_match(
        [
            (grad == 1, "graduate"),
            (last_termid.isin(current_terms), "active"),
            (separated, "involuntary desertion"),
            (suspended & (terms_out >= suspended_from), "voluntary desertion"),
            (suspended & (terms_out < suspended_from), "suspended"),
            (~suspended & (terms_out >= away_from), "voluntary desertion"),
        ]
    )


def year_reached(terms: Column) -> Column:
    """Study year reached: edges belong to the earlier year (4 terms = 1st year)."""
    a, b, c, d, e = fixed.YEAR_LABELS
    return first_match([(terms <= 4, a), (terms <= 8, b), (terms <= 12, c), (terms <= 16, d), (terms > 16, e)])


def year_of_dropout(label: Column, terms: Column) -> Column:
    """Study year of a dropout: edges belong to the later year (4 terms = 2nd year)."""
    a, b, c, d, e = fixed.YEAR_LABELS
    out = label.isin(DROPOUTS)
    return first_match(
        [
            (out & (terms < 4), a), (out & (terms < 8), b), (out & (terms < 12), c),
            (out & (terms < 16), d), (out & (terms >= 16), e),
        ]
    )


def outcome_number(label: Column) -> Column:
    """0 graduate, 1 voluntary, 2 involuntary, 3 active; null for everything else."""
    return codes(label, fixed.OUTCOME_CODES)


def with_targets(entities: DataFrame, label: str = "y", year_desert: str = "year_desert") -> DataFrame:
    """Numeric outcome and one 0/1 target per year; the fourth takes year 5 and later too."""
    years = fixed.YEAR_LABELS
    groups = {1: years[:1], 2: years[1:2], 3: years[2:3], 4: years[3:]}
    return entities.withColumns(
        {"y_num": outcome_number(F.col(label))}
        | {f"y_m{n}": indicator(F.col(year_desert).isin(g)) for n, g in groups.items()}
    )


def two_way(number: Column) -> Column:
    """Both kinds of dropout as 1."""
    return F.when(number == 2, 1).otherwise(number)


def sponsor_checks(approval: Column, start_year: Column) -> dict[str, Column]:
    """Year of approval and 1 where it is not the first year of the sponsorship."""
    return {
        "approval_year": F.year(approval),
        "comp_year": 1 - indicator(start_year == F.year(approval)),
    }
