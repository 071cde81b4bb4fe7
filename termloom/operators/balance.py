"""Training/test split and balancing of classes by interpolation between neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.operators.neighbours import nearest_neighbours, neighbour_slots
from termloom.operators.spread import exploded_copies, ranked
from termloom.session import checkpointed

# The two combined variants call the plain oversampler as well, so their result is the same.
METHODS = ("smote", "smote_enn", "smote_tomek")


HASH_RANGE = 1 << 32


def hash_number(seed: int, *columns: str) -> Column:
    """0 .. 2**32 - 1 from the key: the same row always gets the same number, wherever it is
    and in whatever engine (first eight digits of an MD5 sum)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash_share(key: Sequence[str], seed: int, of: int = 10_000) -> Column:
    """0 .. of - 1, evenly spread."""
    return F.pmod(hash_number(seed, *key), F.lit(of))


def train_test(
    df: DataFrame, key: Sequence[str] = ("id",), test_share: float = 0.25, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Seeded split by key; all targets of a row stay together."""
    is_test = hash_share(key, seed) < F.lit(round(test_share * 10_000))
    return df.filter(~is_test), df.filter(is_test)


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def oversample(
    df: DataFrame,
    label: str,
    features: Sequence[str],
    key: str = "id",
    k: int = 5,
    seed: int = 42,
    method: str = "smote",
    block: int = 2000,
) -> DataFrame:
    """Raise every class to the size of the largest.

    Output: ``key, label, features, synthetic`` - all input rows and, for each smaller class,
    new rows on the line between a row and one of its k nearest rows of the class. Base rows
    are used equally often, up to one; neighbour and position on the line come from a hash,
    so the result does not depend on partitioning.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if not isinstance(df.schema[key].dataType, T.IntegralType):
        raise ValueError("the key must be an integer column")
    features = list(features)
    base = df.select(key, label, *[F.col(f).cast("double").alias(f) for f in features])
    # one row per class
    sizes = {r[label]: r["n"] for r in class_distribution(base, label).collect()}
    largest = max(sizes.values())
    parts = [base.withColumn("synthetic", F.lit(0))]
    for value, n in sorted(sizes.items(), key=lambda item: str(item[0])):
        if n < largest:
            rows = checkpointed(base.filter(F.col(label).eqNullSafe(F.lit(value))))
            parts.append(_synthetic(rows, label, value, features, key, k, seed, largest - n, n, block))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _synthetic(
    rows: DataFrame, label: str, value, features: list[str], key: str, k: int, seed: int,
    wanted: int, held: int, block: int,
) -> DataFrame:
    vec = rows.select(F.col(key).cast("long").alias("_id"), F.array(*features).alias("vec"))
    # equal vectors become one row with a count, named by the lowest id among them
    distinct = checkpointed(
        vec.groupBy("vec").agg(F.min("_id").alias("key"), F.count(F.lit(1)).alias("n"))
    )
    near = nearest_neighbours(distinct.select("key", "vec"), "key", "vec", k, block)
    slots = neighbour_slots(near, distinct.select("key", "n"), k)
    # the k neighbour vectors travel with their row, so the new rows need no join
    ends = (
        slots.select("key", F.posexplode("slots").alias("at", "other"))
        .join(distinct.select(F.col("key").alias("other"), F.col("vec").alias("end")).hint("merge"), "other")
        .groupBy("key")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "end"))), lambda s: s["end"]).alias("ends"))
    )
    reach = checkpointed(distinct.select("key", "vec").join(ends.hint("merge"), "key", "left"))

    # whole rounds for all rows, one more for the first by hash
    placed = ranked(vec.select("_id", hash_number(seed, "_id").alias("_h")), ["_h", "_id"], "_place")
    rounds, extra = divmod(wanted, held)
    quota = placed.select("_id", (F.lit(rounds) + F.when(F.col("_place") < extra, 1).otherwise(0)).alias("times"))
    bases = vec.join(quota.filter("times > 0").hint("merge"), "_id")
    draws = exploded_copies(bases.join(reach.hint("merge"), "vec").drop("key"), "times", "_j")

    draw = hash_number(seed + 1, "_id", "_j")
    step = hash_number(seed + 2, "_id", "_j") / float(HASH_RANGE)
    # a class of one distinct row has no neighbour: the row itself is repeated
    end = F.when(
        F.size("ends") > 0,
        F.try_element_at("ends", (F.pmod(draw, F.size("ends")) + 1).cast("int")),
    ).otherwise(F.col("vec"))
    drawn = draws.select("_id", "vec", end.alias("end"), step.alias("u"))
    made = drawn.withColumn("_new", F.zip_with("vec", "end", lambda a, b: a + F.col("u") * (b - a)))
    return made.select(
        F.col("_id").cast(rows.schema[key].dataType).alias(key),
        F.lit(value).cast(rows.schema[label].dataType).alias(label),
        *[F.col("_new")[i].alias(f) for i, f in enumerate(features)],
        F.lit(1).alias("synthetic"),
    )
