"""Benchmark decontamination by a prefix-filtered set join.

A window is ``width`` consecutive words of an item (all words of a shorter item). Each window is a set of word shingles at
known offsets, and a window that occurs has all of them. So one necessary prefix token is enough to find every candidate:
the shingle that is rarest in the corpus. A first pass counts, with partial sums in every task, how often the corpus has each
shingle of the benchmark; windows with a shingle that it does not have are out. A second pass joins the rarest shingles alone. The
offset of the shingle gives the place of the candidate, which has to lie inside the document (length and positional bounds), and the
words at that place, which travel with the hit, are compared with those of the window, so the result is exact.

Both passes look each shingle up in a bit table first, so the few that can match are the only ones that become rows.

Defined cases: null texts have no words; items without words have no window; rows with one item_id are
one item; an item whose id is null marks words but has no id to count or list. Equal rows get equal
results, extra columns are not read, an empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import NON_WORD_RUN, ascii_lower, row_key, split_words, text_of
from termloom.operators.spread import BROADCAST_BYTES, table_bytes
from termloom.session import checkpointed

WIDTH = 10
SHINGLE = 5
#: The rarest shingles, with their windows, are broadcast up to so many rows (of a few hundred bytes); beyond, they are shuffled.
BROADCAST_ROWS = 100_000
#: Bits for each shingle in the bit table, and the most it has (in words of 64): beyond, it just lets more pass.
BITS_EACH = 32
MOST_WORDS = 1 << 20


def words_of(text: Column) -> Column:
    return split_words(ascii_lower(text), NON_WORD_RUN)


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, win, words): each distinct window of each item."""
    items = benchmark.select("item_id", words_of(text_of()).alias("words")).filter(F.size("words") > 0)
    n = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(n - (width - 1), F.lit(1)))
    placed = items.select("item_id", "words", F.explode(starts).alias("at"))
    return (
        placed.select("item_id", F.slice("words", F.col("at"), width).alias("words"))
        .distinct()
        .withColumn("win", F.array_join("words", " "))
    )


def shingle_hash(words: str, at: Column, size: Column | int) -> Column:
    return F.xxhash64(F.slice(words, at, size))


def window_shingles(windows: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(win, words, n, size, offset, h) of each distinct window: hashes of its shingles."""
    n = F.size("words")
    own = F.least(n, F.lit(size))
    at = F.explode(F.sequence(F.lit(1), n - own + 1))
    return (
        windows.select("win", "words").dropDuplicates(["win"])
        .select("win", "words", n.alias("n"), own.alias("size"), at.alias("at"))
        .select("win", "words", "n", "size", (F.col("at") - 1).alias("offset"), shingle_hash("words", F.col("at"), F.col("size")).alias("h"))
    )


def bit_table(hashes: DataFrame) -> tuple[Column, int]:
    """(array of longs, its length): a bit for each hash ``h``. Other hashes share bits, so it never misses one."""
    n = hashes.count()
    words = min(MOST_WORDS, 1 << max(0, -(-n * BITS_EACH // 64) - 1).bit_length())
    place, bit = bit_place(F.col("h"), words)
    # shifting a long by 63 is its sign
    filled = hashes.groupBy(place.alias("id")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("w"))
    dense = hashes.sparkSession.range(words).join(filled, "id", "left").select("id", F.coalesce("w", F.lit(0).cast("bigint")).alias("w"))
    listed = dense.agg(F.sort_array(F.collect_list(F.struct("id", "w"))).alias("x")).select(F.col("x.w").alias("bits"))
    return checkpointed(listed).scalar(), words


def bit_place(h: Column, words: int) -> tuple[Column, Column]:
    low = h.bitwiseAND(F.lit(words * 64 - 1))
    return F.shiftright(low, 6).cast("int"), low.bitwiseAND(F.lit(63)).cast("int")


def hits(docs: DataFrame, hashes: DataFrame, sizes: list[int], context: int | None = None) -> DataFrame:
    """(row, at, h) of the document shingles that may be among ``hashes``; ``at`` counts from 0.

    With ``context``, also ``around``: up to so many words before the shingle and so many from its start on, ``first``: where
    they begin, and ``n_words`` of the document.
    """
    bits, words = bit_table(hashes)
    texts = docs.select(row_key("doc_id", "text").alias("row"), words_of(text_of()).alias("words"))
    n = F.size("words")

    def known(x: Column) -> Column:
        place, bit = bit_place(x["h"], words)
        return F.bit_get(F.element_at("_bits", place + 1), bit) == 1

    places = None
    for size in sizes:
        some = F.when(n >= size, F.transform(
            F.sequence(F.lit(0), n - size), lambda i: F.struct(i.alias("at"), shingle_hash("words", i + 1, size).alias("h"))
        ))
        some = F.coalesce(some, F.array().cast("array<struct<at:int,h:bigint>>"))
        places = some if places is None else F.concat(places, some)
    passed = texts.withColumn("_bits", bits).select("row", "words", F.filter(places, known).alias("x"))
    # outer, then without nulls: from a plain explode Spark would infer a filter on the array and push it, with all the
    # splitting of the text in it, below the words
    if context is None:
        return passed.select("row", F.explode_outer("x").alias("x")).select("row", "x.at", "x.h").filter("h IS NOT NULL")

    def around(x: Column) -> Column:
        first = F.greatest(x["at"] - context, F.lit(0))
        return F.struct(x["at"], x["h"], first.alias("first"), F.slice("words", first + 1, x["at"] - first + context).alias("around"))

    found = passed.select("row", n.alias("n_words"), F.explode_outer(F.transform("x", around)).alias("x"))
    return found.select("row", "n_words", "x.*").filter("h IS NOT NULL")


def anchors(parts: DataFrame, counted: DataFrame) -> DataFrame:
    """(win, words, n, offset, size, h, found): the rarest shingle of each window all of whose shingles the corpus has."""
    rarity = parts.select("win", "h", "offset").join(counted, "h", "left")
    rarest = (
        rarity.groupBy("win").agg(F.min(F.struct(F.coalesce("found", F.lit(0)).alias("found"), "h", "offset")).alias("r"))
        .filter(F.col("r.found") > 0).select("win", "r.*")
    )
    return parts.drop("h", "size").dropDuplicates(["win"]).drop("offset").join(rarest, "win").join(
        parts.select("win", "offset", "size"), ["win", "offset"]
    )


def contaminated(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, size: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """(row, n_hit, items): documents with a window, their words inside one, and the items' ids as text."""
    size = min(size, width)
    windows = checkpointed(item_windows(benchmark, width))
    parts = checkpointed(window_shingles(windows, size))
    sizes = sorted(r[0] for r in parts.select("size").distinct().collect()) or [size]  # at most ``size`` values
    hashes = checkpointed(parts.select("h").distinct())
    counted = hits(docs, hashes, sizes).groupBy("h").agg(F.count("*").alias("found"))
    prefix = checkpointed(anchors(parts, counted))
    used = sorted(r[0] for r in prefix.select("size").distinct().collect()) or [size]
    index = prefix.select("h", "win", F.col("words").alias("wanted"), "n", "offset")
    index = F.broadcast(index) if index.count() <= broadcast_rows else index
    start = F.col("at") - F.col("offset")
    inside = (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    same = F.slice("around", start - F.col("first") + 1, F.col("n")) == F.col("wanted")
    found = (
        hits(docs, checkpointed(prefix.select("h").distinct()), used, width).join(index, "h")
        .filter(inside).filter(same).select("row", "win", "n", start.alias("start")).distinct()
    )
    found = checkpointed(found)
    hit_words = (
        found.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("at"))
        .distinct()
        .groupBy("row")
        .agg(F.count("*").alias("n_hit"))
    )
    items = (
        found.select("row", "win").distinct()
        .join(windows.select("win", F.col("item_id").cast("string").alias("item")), "win")
        .groupBy("row")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    return hit_words.join(items, "row", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


def marked(docs: DataFrame, benchmark: DataFrame, **how: int) -> DataFrame:
    """Per document: doc_id, row, n_words, n_hit, items."""
    counts = docs.select(
        "doc_id", row_key("doc_id", "text").alias("row"), F.size(words_of(text_of())).cast("long").alias("n_words")
    )
    return (
        counts.join(contaminated(docs, benchmark, **how), "row", "left")
        .withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
        .withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    )


def clean(docs: DataFrame, benchmark: DataFrame, **how: int) -> DataFrame:
    """The documents without any window of the benchmark; columns as before.

    The keys of the others are written and measured: up to ``BROADCAST_BYTES`` they are broadcast, and no text is shuffled.
    """
    columns = docs.columns
    bad = checkpointed(contaminated(docs, benchmark, **how).select(F.col("row").alias("_llm_row")))
    bad = F.broadcast(bad) if table_bytes(bad) <= BROADCAST_BYTES else bad
    return (
        docs.withColumn("_llm_row", row_key("doc_id", "text")).join(bad, "_llm_row", "left_anti").select(*columns)
    )
