"""What the operators of this subpackage share: tables, words, row keys, shipping of functions."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
#: What separates words made of digits, letters a-z and characters beyond ASCII.
NON_WORD_RUN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(module: str) -> None:
    """Send the functions of ``module`` to executors by value: they need not have this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters unchanged."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def split_words(text: Column, separator: str) -> Column:
    """The non-empty pieces between runs of ``separator``; only the ends can be empty."""
    pieces = F.split(text, separator, -1)
    first = F.when(F.get(pieces, F.lit(0)) == "", 1).otherwise(0)
    last = F.when(F.element_at(pieces, -1) == "", 1).otherwise(0)
    return F.slice(pieces, first + 1, F.greatest(F.size(pieces) - first - last, F.lit(0)))


def row_key(*columns: str) -> Column:
    """A hash by which a row is found again. Rows that are equal in ``columns`` share it."""
    return F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in columns])


def per_row_key(results: DataFrame, key: str) -> DataFrame:
    """One row per key: rows with one key have equal results."""
    return results.dropDuplicates([key])


def chosen(labels: DataFrame, label: str, learn: Column, sample: int) -> DataFrame:
    """(id, label): at most ``sample`` labelled ids; one label an id, the greatest if rows differ."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & learn)
    each = known.groupBy(F.col("doc_id").alias("id")).agg(F.max(label).cast("long").alias("label"))
    return each.orderBy(F.xxhash64("id"), "id").limit(sample)


def text_groups(values: pa.Array, size: int) -> Iterator[list[str]]:
    """The texts (null as empty) in lists of about ``size`` characters."""
    some, held = [], 0
    for x in values:
        some.append(x.as_py() or "")
        held += len(some[-1])
        if held >= size:
            yield some
            some, held = [], 0
    if some:
        yield some


ship(__name__)
