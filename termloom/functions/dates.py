"""Dates and terms. A term is a year and a quarter 1..4; ``term_number`` makes it one integer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(column: Column, fmt: str | None = None) -> Column:
    """Null, not an error, for a text that is no date."""
    return F.try_to_timestamp(column, F.lit(fmt)) if fmt else F.try_to_timestamp(column)


def date_parts(column: Column, suffix: str) -> dict[str, Column]:
    """Year, month, day and weekday with Monday as 0."""
    return {
        f"year_{suffix}": F.year(column),
        f"month_{suffix}": F.month(column),
        f"day_{suffix}": F.day(column),
        f"dayweek_{suffix}": F.weekday(column),
    }


def date_part(column: Column) -> Column:
    return F.to_date(column)


def time_part(column: Column) -> Column:
    """``HH:mm:ss``, independent of the session time zone."""
    return F.format_string("%02d:%02d:%02d", F.hour(column), F.minute(column), F.second(column))


def with_year(column: Column, year: Column) -> Column:
    """The same month and day in another year; 29 February becomes 28 where needed."""
    first = F.make_date(year, F.month(column), F.lit(1))
    return F.make_date(year, F.month(column), F.least(F.day(column), F.day(F.last_day(first))))


def year_repaired(column: Column, year: Column, low: int, high: int) -> Column:
    """Dates whose year lies outside ``low..high`` are moved to ``year``."""
    outside = (F.year(column) < low) | (F.year(column) > high)
    return F.when(outside, with_year(column, year)).otherwise(F.to_date(column))


def term_number(year: Column, quarter: Column) -> Column:
    return (year * 4 + quarter).cast("int")


def term_label(year: Column, quarter: Column) -> Column:
    return F.concat_ws("_", year.cast("string"), quarter.cast("string"))


def terms_skipped(year: Column, quarter: Column, prev_year: Column, prev_quarter: Column) -> Column:
    """Terms between two attended terms: 0 for neighbours, null where there is none before."""
    return term_number(year, quarter) - term_number(prev_year, prev_quarter) - 1


def terms_since(year: Column, quarter: Column, ref_year: int, ref_quarter: int) -> Column:
    """Terms without attendance after (year, quarter), up to and with the reference term."""
    return F.lit(ref_year * 4 + ref_quarter) - term_number(year, quarter)
