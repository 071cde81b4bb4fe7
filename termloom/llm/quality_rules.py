"""Quality rules from line frequency across documents.

Every line is normalised (lower case, runs of blanks as one space, trimmed) and hashed. A line
that stands in more than ``max_share`` of a host's distinct texts, and in ``min_docs`` of them at
least, is boilerplate of that host and is removed. Exact copies of a text count once, so copies of a
document do not turn its lines into boilerplate. A document is depleted, and rejected, if fewer than
``min_words`` words or less than ``min_rest`` of its words remain.

Absolute limits hold besides, which do not grow with a host or the table: a line in ``short_docs`` distinct
texts over all hosts, or in ``long_docs`` if it has more than ``LONG_WORDS`` words, is removed everywhere. Texts
over all hosts are at least those of each host, so this holds per host too. None switches them off.

Defined cases: a null text is empty and fails the base rules; a null host is a host of its own; equal
rows get equal results; documents without lines have nothing removed. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import BLANK_RUN, BLANKS, row_key, split_words, text_of
from termloom.session import checkpointed

MAX_SHARE = 0.1
MIN_DOCS = 10
MIN_WORDS = 10
MIN_REST = 0.1
REPEAT_WINDOW = 5
#: Absolute limits, in distinct texts.
LONG_WORDS = 50
SHORT_DOCS = 200
LONG_DOCS = 10


def has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS)) != ""


def normal_line(line: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(line), BLANK_RUN, " "), F.lit(" "))


def repeated_words(measured: DataFrame, width: int = REPEAT_WINDOW) -> DataFrame:
    """Adds ``n_repeat_words`` from ``words``: how many words stand in windows that occur again.

    Windows are hashed. Only texts with a repeated window sort theirs by hash, keep those with an
    equal neighbour, and add up what the kept positions cover; the work is n log n in the words.
    """
    n = F.size("words")
    windows = F.when(
        n >= width,
        F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(F.slice("words", i, width))),
    ).otherwise(F.array().cast("array<bigint>"))
    hashed = measured.withColumn("_windows", windows)
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    in_order = F.when(
        twice, F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
    ).otherwise(F.array().cast("array<struct<h:bigint,at:int>>"))
    near = hashed.withColumn("_sorted", in_order).withColumn(
        "_at",
        F.sort_array(
            F.transform(
                F.filter(
                    "_sorted",
                    lambda x, i: F.coalesce(F.get("_sorted", i - 1)["h"] == x["h"], F.lit(False))
                    | F.coalesce(F.get("_sorted", i + 1)["h"] == x["h"], F.lit(False)),
                ),
                lambda x: x["at"],
            )
        ),
    )
    covered = F.aggregate(
        F.transform(
            "_at", lambda p, i: F.least(F.lit(width), F.coalesce(F.get("_at", i + 1) - p, F.lit(width))).cast("long")
        ),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    return near.withColumn("n_repeat_words", covered).drop("_windows", "_sorted", "_at")


def measures(docs: DataFrame) -> DataFrame:
    """One narrow row per document: base measures, and hash and words of each line."""
    texts = docs.select(
        "doc_id", "source", row_key("doc_id", "source", "text").alias("row"), text_of().alias("text")
    )
    parts = texts.withColumn("words", split_words(F.col("text"), BLANK_RUN)).withColumn(
        "lines", F.filter(F.split("text", "\n", -1), has_word)
    )
    counted = repeated_words(parts)
    n = F.size("words").cast("long")
    return counted.select(
        "doc_id",
        "source",
        "row",
        F.xxhash64("text").alias("body"),
        n.alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        ((n < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * n)).alias("base_failed"),
        F.transform("lines", lambda x: F.xxhash64(normal_line(x))).alias("line"),
        F.transform("lines", lambda x: F.size(split_words(x, BLANK_RUN))).alias("line_words"),
    )


def frequent_lines(measured: DataFrame, max_share: float = MAX_SHARE, min_docs: int = MIN_DOCS) -> DataFrame:
    """(source, line, n_docs) of the lines above the limits of their host."""
    lines = measured.select("source", "body", F.explode(F.array_distinct("line")).alias("line"))
    by_line = (
        lines.distinct().groupBy("source", "line").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= min_docs)
    )
    hosts = (
        measured.select(F.col("source").alias("host"), "body").distinct().groupBy("host").agg(F.count("*").alias("n_host"))
    )
    return by_line.join(hosts, by_line.source.eqNullSafe(hosts.host)).filter(
        F.col("n_docs") > max_share * F.col("n_host")
    ).select("source", "line", "n_docs")


def widespread_lines(measured: DataFrame, short_docs: int, long_docs: int) -> DataFrame:
    """(line) of the lines in so many distinct texts over all hosts, by their length."""
    lines = measured.select("body", F.explode(F.array_distinct(F.arrays_zip("line", "line_words"))).alias("x"))
    lines = lines.select("body", "x.line", (F.col("x.line_words") > LONG_WORDS).alias("long")).distinct()
    by_line = lines.groupBy("line", "long").agg(F.count("*").alias("n_docs"))
    return by_line.filter(F.col("n_docs") >= F.when(F.col("long"), long_docs).otherwise(short_docs)).select("line").distinct()


def verdicts(
    docs: DataFrame,
    max_share: float = MAX_SHARE,
    min_docs: int = MIN_DOCS,
    min_words: int = MIN_WORDS,
    min_rest: float = MIN_REST,
    short_docs: int | None = SHORT_DOCS,
    long_docs: int | None = LONG_DOCS,
) -> DataFrame:
    """Per document: base measures, what is removed (``removed``: hashes of lines), and ``kept``.

    ``row`` is the key by which :func:`row_key` of (doc_id, source, text) finds the row again.
    """
    measured = checkpointed(measures(docs))
    frequent = frequent_lines(measured, max_share, min_docs).select(F.col("source").alias("host"), F.col("line").alias("hot"))
    lines = measured.select("row", "source", F.explode(F.array_distinct("line")).alias("line"))
    gone = lines.join(frequent, lines.source.eqNullSafe(frequent.host) & (lines.line == frequent.hot)).select("row", "line")
    if short_docs is not None and long_docs is not None:
        gone = gone.unionByName(lines.join(widespread_lines(measured, short_docs, long_docs), "line").select("row", "line"))
    removed = gone.groupBy("row").agg(F.collect_set("line").alias("removed"))
    found = measured.join(removed, "row", "left").withColumn(
        "removed", F.coalesce("removed", F.array().cast("array<bigint>"))
    )
    gone = F.aggregate(
        F.zip_with("line", "line_words", lambda h, w: F.when(F.array_contains("removed", h), w).otherwise(0)),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    rest = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") > 0) & ((rest < min_words) | (rest < min_rest * F.col("n_words")))
    return (
        found.withColumn("n_removed_words", F.when(F.size("removed") == 0, F.lit(0).cast("long")).otherwise(gone))
        .withColumn("kept", ~F.col("base_failed") & ~depleted)
        .drop("line", "line_words", "body")
    )


def filtered(docs: DataFrame, **limits: float | None) -> DataFrame:
    """The kept documents without their removed lines; columns as before, ``n_chars`` (if there) recounted.

    The limits are those of :func:`verdicts`.
    """
    columns = docs.columns
    decided = verdicts(docs, **limits)
    changed = (
        decided.filter(~F.col("kept") | (F.size("removed") > 0))
        .dropDuplicates(["row"])
        .select(F.col("row").alias("_llm_row"), F.col("kept").alias("_llm_kept"), F.col("removed").alias("_llm_removed"))
    )
    lines = F.filter(
        F.split("text", "\n", -1),
        lambda x: ~(has_word(x) & F.array_contains("_llm_removed", F.xxhash64(normal_line(x)))),
    )
    text = F.when(F.size("_llm_removed") > 0, F.array_join(lines, "\n")).otherwise(F.col("text"))
    out = (
        docs.withColumn("_llm_row", row_key("doc_id", "source", "text"))
        .join(changed, "_llm_row", "left")
        .filter(F.coalesce("_llm_kept", F.lit(True)))
        .withColumn("text", text)
    )
    if "n_chars" in columns:
        out = out.withColumn(
            "n_chars",
            F.when(F.size("_llm_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(
                F.col("n_chars")
            ),
        )
    return out.select(*columns)
