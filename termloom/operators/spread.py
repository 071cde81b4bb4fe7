"""Keeping work spread out when one key holds a large share of the rows.

Three tools, used by the other operators wherever a plain shuffle on the key would put a
hot group into one task:

* ``ranked`` - positions in a total order from a range-partitioned sort, no one-task window;
* ``left_join_spread`` - a left join that splits each hot key by its own number of rows;
* ``lookup_join`` - broadcasts a derived lookup only after measuring its bytes, and takes the
  salted join beyond that bound.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from termloom.session import checkpointed

# A key is hot if it holds more rows than one task should: HOT_ROWS, or total / HOT_KEYS in
# tables so large that this is more. So there are at most HOT_KEYS hot keys, whatever the data,
# and none of their salts holds more than that many rows.
HOT_KEYS = 4096
HOT_ROWS = 1_000_000
# Items of the frequent-item summary. It is off by at most 3.5 / (TRACKED / 0.75) of the rows, and reports every item that
# has twice as many, which is less than the share of 1 / HOT_KEYS.
TRACKED = 24_576
LOOSE_SALTS = 1 << 20  # rows without a key match nothing and are only spread
BROADCAST_BYTES = 32 << 20


def ranked(df: DataFrame, order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """Add the 0-based position of each row in ``order`` (which should be a total order).

    The sort is range partitioned, so equal or hot prefixes are split. Positions inside a
    partition come from the row ids Spark gives; the start of each partition is the sum of
    the sizes before it, a table with as many rows as there are partitions.
    """
    row_bits = 33
    placed = checkpointed(
        df.orderBy(*order).withColumn("_row", F.monotonically_increasing_id())
    )
    split = placed.select(
        *df.columns,
        F.shiftright("_row", row_bits).alias("_part"),
        F.col("_row").bitwiseAND(F.lit((1 << row_bits) - 1)).alias("_pos"),
    )
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        split.groupBy("_part").agg((F.max("_pos") + 1).alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    )
    return (
        split.join(F.broadcast(starts), "_part")
        .select(*df.columns, (F.col("_start") + F.col("_pos")).alias(name))
    )


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key (known keys only) as ``keys, _n``. Callers that need it more than once pass
    it on, so that Spark plans the same shuffle and runs it once."""
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def _most(total: Column, least_rows: int) -> Column:
    return F.greatest(F.lit(least_rows).cast("long"), F.ceil(total / F.lit(HOT_KEYS)).cast("long"))


def hot_keys(counts: DataFrame, keys: Sequence[str], least_rows: int = HOT_ROWS) -> DataFrame:
    """Every key with more rows than one task should hold, and over how many tasks to split it."""
    most = _most(counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).scalar(), least_rows)
    return counts.filter(F.col("_n") >= most).select(*keys, (F.floor(F.col("_n") / most) + 1).cast("int").alias("_salts"))


def key_hash(keys: Sequence[str], types: Sequence[T.DataType]) -> Column:
    """A hash that is equal for keys that join: of one type on both sides, with one zero."""
    columns = [F.col(k).cast(t) for k, t in zip(keys, types)]
    return F.xxhash64(*[c + F.lit(0).cast(t) if isinstance(t, (T.FloatType, T.DoubleType)) else c for c, t in zip(columns, types)])


def hot_hashes(df: DataFrame, keys: Sequence[str], least_rows: int = HOT_ROWS) -> DataFrame:
    """(_hash, _salts) for every key with more rows than one task should hold.

    Found by a mergeable summary of frequent items, of bounded size in every task: no row per key is shuffled. It
    may take a key with somewhat fewer rows for a hot one, which costs a salt, but misses none.
    """
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    hashed = df.select(key_hash(keys, [df.schema[k].dataType for k in keys]).alias("_hash"))
    top = F.expr(f"approx_top_k(_hash, {HOT_KEYS}, {TRACKED})")
    found = hashed.agg(F.count(F.lit(1)).alias("_total"), top.alias("_top"))
    most = _most(F.col("_total"), least_rows)
    return (
        found.select("_total", F.explode("_top").alias("_t")).filter(F.col("_t.count") >= most)
        .select(F.col("_t.item").alias("_hash"), (F.floor(F.col("_t.count") / most) + 1).cast("int").alias("_salts"))
    )


def left_join_spread(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    *,
    least_rows: int = HOT_ROWS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Left join that splits each hot key of ``left`` over as many tasks as its rows need.

    ``counts`` (from ``key_counts``) are used in place of a summary of frequent keys where the caller has them anyway.

    ``spread`` names columns of ``left`` whose hash picks the salt. Only the rows of
    ``right`` that match a hot key are repeated. Rows with a null key match nothing and are
    spread as well, so a third of all rows without a key does no harm.
    """
    keys = list(keys)
    types = [left.schema[k].dataType for k in keys]
    if counts is None:
        hot = hot_hashes(left, keys, least_rows)
    else:
        hot = hot_keys(counts, keys, least_rows).select(key_hash(keys, types).alias("_hash"), "_salts").dropDuplicates(["_hash"])
    hot = F.broadcast(hot)  # at most HOT_KEYS rows of 12 bytes
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    salted_left = (
        left.withColumn("_hash", key_hash(keys, types)).join(hot, "_hash", "left")
        .withColumn(
            "_salt",
            F.pmod(
                F.xxhash64(*spread), F.when(no_key, F.lit(LOOSE_SALTS)).otherwise(F.coalesce("_salts", F.lit(1)))
            ).cast("int"),
        )
        .drop("_salts", "_hash")
    )
    salted_right = (
        right.withColumn("_hash", key_hash(keys, types)).join(hot, "_hash", "left")
        .withColumn(
            "_salt",
            F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)),
        )
        .drop("_salts", "_hash")
    )
    joined = salted_left.join(salted_right, [*keys, "_salt"], "left").drop("_salt")
    return joined.select(*left.columns, *[c for c in right.columns if c not in keys])


def table_bytes(df: DataFrame) -> int:
    """About the bytes of a table in memory: its texts and 16 for every cell."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() == "string"]
    row = reduce(lambda a, b: a + b, texts, F.lit(16 * len(df.columns)))
    return df.agg(F.coalesce(F.sum(row.cast("long")), F.lit(0))).first()[0]


def lookup_join(
    left: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    *,
    most_bytes: int = BROADCAST_BYTES,
    stored: bool = False,
) -> DataFrame:
    """Left join to a lookup derived from data.

    The lookup is computed once, written (unless it is ``stored`` already) and measured; it is
    broadcast only within ``most_bytes`` and joined with salting otherwise.
    """
    kept = lookup if stored else checkpointed(lookup)
    if table_bytes(kept) <= most_bytes:
        return left.join(F.broadcast(kept), list(keys), "left").select(
            *left.columns, *[c for c in lookup.columns if c not in keys]
        )
    return left_join_spread(left, kept, keys, spread)


def exploded_copies(df: DataFrame, times: str, name: str, chunk: int = 10_000) -> DataFrame:
    """Repeat each row ``times`` times, numbered from 0 in ``name``.

    A row with a very large count is first split into chunks that are dealt out to all
    tasks, so no task writes all copies of one row.
    """
    last = F.col(times) - 1
    chunks = (
        df.filter(F.col(times) > 0)
        .withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / chunk))))
    )
    spread = chunks.repartition(*[F.xxhash64(*df.columns), F.col("_chunk")])
    return spread.withColumn(
        name,
        F.explode(
            F.sequence(
                F.col("_chunk") * chunk,
                F.least(F.col("_chunk") * chunk + (chunk - 1), last.cast("long")),
            )
        ),
    ).drop("_chunk")
