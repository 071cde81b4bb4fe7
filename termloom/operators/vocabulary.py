"""Token features: lists over a year, vocabulary, counts per entity.

Counts are kept in long form (entity, token, n): no column per token, no list per entity, no
limit on the vocabulary. Components are learned from and applied to this form
(``components.fit_count_components``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import tokens
from termloom.operators.spread import lookup_join


def joined_lists(df: DataFrame, lists: Sequence[str], name: str) -> DataFrame:
    """Several list columns of a row as one list; a missing list adds nothing."""
    empty = F.array().cast("array<string>")
    return df.withColumn(name, F.concat(*[F.coalesce(F.col(c), empty) for c in lists]))


def text_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per token of each text."""
    return df.select(key, F.explode(tokens(F.col(text))).alias("token"))


def list_tokens(df: DataFrame, key: str, items: str) -> DataFrame:
    """One row per list element."""
    return df.select(key, F.explode(items).alias("token"))


def vocabulary(exploded: DataFrame) -> DataFrame:
    """Distinct tokens; the empty one is no token."""
    return exploded.select("token").filter(F.col("token") != "").distinct()


def token_counts(exploded: DataFrame, key: str) -> DataFrame:
    """How often each token occurs per key."""
    return exploded.filter(F.col("token") != "").groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))


def learned_from(counts: DataFrame, learn: Column) -> DataFrame:
    """The tokens of the rows that ``learn`` names, from counts of all rows: both are one shuffle of the counts."""
    return counts.groupBy("token").agg(F.max(learn).alias("_learned")).filter("_learned").select("token")


def learned_only(counts: DataFrame, learned: DataFrame) -> DataFrame:
    """Counts of the tokens of a learned vocabulary.

    Joined after counting, with one row per key and token. A vocabulary within the bound of ``lookup_join`` is broadcast. With a
    larger one, a common word has a row for each key; how many is found by a summary of frequent tokens, and just those are split
    and their word repeated.
    """
    known = learned.select("token", F.lit(True).alias("_known"))
    return lookup_join(counts, known, ["token"], counts.columns).filter("_known").drop("_known")
