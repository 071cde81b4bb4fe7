"""Cleaning of scores, ages, dates and places."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions import codes as fixed
from termloom.functions.conditions import mapped, row_mean
from termloom.functions.dates import date_parts, year_repaired
from termloom.functions.text import (
    clean, drop_punctuation, head_before, null_if_short, strip, to_ascii,
)
from termloom.operators.joins import fill_from_groups, map_values
from termloom.operators.rows import null_outside
from termloom.operators.summaries import group_mode


def limit_scores(df: DataFrame, limits: Sequence[tuple] = tuple(fixed.SCORE_LIMITS)) -> DataFrame:
    """Null out scores outside their limits, one projection for all rules."""
    present = [rule for rule in limits if rule[0] in df.columns]
    return df.withColumns({name: null_outside(F.col(name), *rest) for name, *rest in present})


def pick_version(
    df: DataFrame,
    scores: Sequence[str] = tuple(fixed.VERSIONED_SCORES),
    deciders: Sequence[str] = tuple(fixed.VERSION_DECIDERS),
    second: str = "_2",
    chosen: str = "_fin",
) -> DataFrame:
    """Take version 2 of all ``scores`` where its mean over ``deciders`` is higher.

    An unknown mean on either side keeps version 1.
    """
    mean_1 = row_mean([F.col(c) for c in deciders])
    mean_2 = row_mean([F.col(c + second) for c in deciders])
    take_2 = F.coalesce(mean_2 > mean_1, F.lit(False))
    return df.withColumns({c + chosen: F.when(take_2, F.col(c + second)).otherwise(F.col(c)) for c in scores})


def plausible_age(age: Column, low: int = 10, high: int = 70) -> Column:
    """Ages strictly between the bounds; null otherwise."""
    return F.when((age > low) & (age < high), age)


def birth_parts(df: DataFrame, dob: str, age: str) -> DataFrame:
    """Parts of the birth date, null where the age at entry is not plausible."""
    estimate = plausible_age(F.col(age))
    parts = date_parts(F.col(dob), "birth")
    return df.withColumns(
        {"age_in_estim": estimate}
        | {name: F.when(estimate.isNotNull(), part) for name, part in parts.items()}
    )


def repair_entry_date(
    df: DataFrame,
    date: str,
    year: str,
    quarter: str,
    low: int,
    high: int,
    spread: Sequence[str] = ("id",),
) -> DataFrame:
    """Move dates outside ``low..high`` to the entry year, then fill missing ones with the
    most frequent date of the same entry year and quarter."""
    fixed_year = df.withColumn(date, year_repaired(F.col(date), F.col(year), low, high))
    modes = group_mode(fixed_year, [year, quarter], date, "_mode").dropna(subset=[year, quarter])
    return fill_from_groups(fixed_year, date, modes, [year, quarter], "_mode", spread)


def clean_city(city: Column, synonyms: Mapping[str, str] = fixed.CITY_SYNONYMS) -> Column:
    """Lower case, head before , / (, stripped, ASCII, no punctuation, synonyms, length > 2."""
    head = strip(head_before(F.lower(city), ",", "/", "("))
    return null_if_short(mapped(drop_punctuation(to_ascii(head)), synonyms))


def clean_places(
    df: DataFrame,
    city: str = "birth_city",
    country: str = "birth_country",
    nationality: str = "nationality",
    city_map: DataFrame | None = None,
    spread: Sequence[str] = ("id",),
) -> DataFrame:
    """City cleaned; country and nationality fill each other; a missing city takes the place
    that stands for its country; last the outside map (``raw, clean``), if one is given."""
    land = clean(mapped(F.lower(F.col(country)), fixed.COUNTRY_SYNONYMS))
    nation = clean(F.col(nationality))
    df = df.withColumns(
        {
            city: clean_city(F.col(city)),
            country: F.coalesce(land, nation),
            nationality: F.coalesce(nation, land),
        }
    )
    df = df.withColumn(city, mapped(F.coalesce(city, country), fixed.COUNTRY_PLACES))
    if city_map is None:
        return df
    return map_values(df, city, city_map, "raw", "clean", spread)
