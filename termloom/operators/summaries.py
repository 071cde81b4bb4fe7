"""Aggregates: summaries, quantiles, frequencies, contingency, modes, checks."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termloom.operators.spread import hot_hashes, key_hash, lookup_join
from termloom.session import checkpointed

# ``quantiles``: size of a rank sketch, the share of ranks added to both sides of what it says (several times its error),
# rows of a group that are sorted in one task, and buckets of one narrowing step.
SKETCH_K = 2048
MARGIN = 0.005
ROW_TARGET = 100_000
BUCKETS = 256


def known_double(column: Column) -> Column:
    """As a double; NaN is missing, as everywhere in this module."""
    return F.nanvl(column.cast("double"), F.lit(None).cast("double"))


def missing(df: DataFrame, column: str) -> Column:
    """Null, or NaN in a column of floating numbers."""
    at = F.col(column)
    is_float = df.schema[column].dataType.typeName() in ("double", "float")
    return at.isNull() | F.isnan(at) if is_float else at.isNull()


def value_counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Frequency of each known value, most frequent first."""
    return (
        df.filter(~missing(df, column)).groupBy(column)
        .agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), column)
    )


def value_shares(df: DataFrame, column: str, name: str = "pct") -> DataFrame:
    """Frequencies as percent of all known values. The total is a scalar subquery."""
    known = df.filter(~missing(df, column))
    total = known.agg(F.count(F.lit(1))).scalar()
    counts = known.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn(name, F.col("n") / total * 100)


def contingency(df: DataFrame, rows: str, columns: str, values: Sequence, prefix: str = "") -> DataFrame:
    """Counts by two columns; ``values`` are the column headings. Nulls are left out.

    Counts are taken in long form first, so the pivot only sees one row per cell.
    """
    cells = (
        df.filter(F.col(rows).isNotNull() & F.col(columns).isNotNull())
        .groupBy(rows, columns).agg(F.count(F.lit(1)).alias("_n"))
    )
    return cells.groupBy(rows).agg(
        *[
            F.sum(F.when(F.col(columns) == F.lit(v), F.col("_n")).otherwise(0)).cast("long").alias(f"{prefix}{v}")
            for v in values
        ]
    )


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row, one pass: the number of missing values in every column."""
    return df.agg(*[F.count_if(missing(df, c)).alias(c) for c in columns or df.columns])


def uniqueness(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys and whether the key is unique."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        F.coalesce(F.max("_n") <= 1, F.lit(True)).alias("is_unique"),
    )


def group_mode(df: DataFrame, by: Sequence[str], column: str, name: str | None = None) -> DataFrame:
    """Most frequent known value per group, the lowest one on ties.

    Counted by (group, value) first, so no task holds all values of a group.
    """
    counts = (
        df.filter(~missing(df, column)).groupBy(*by, column)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    best = F.min(F.struct((-F.col("_n")).alias("_n"), F.col(column).alias("_v")))
    return counts.groupBy(*by).agg(best.alias("_best")).select(*by, F.col("_best._v").alias(name or column))


def _places(total: Column, probs: Sequence[float]) -> list[tuple[int, int, Column]]:
    """(number of the level, side, rank) of the two values between which each level lies."""
    out = []
    for i, p in enumerate(probs):
        place = (total - 1) * F.lit(float(p))
        out += [(i, 0, F.floor(place).cast("long")), (i, 1, F.ceil(place).cast("long"))]
    return out


def _brackets(known: DataFrame, by: list[str], probs: Sequence[float], whole: bool) -> DataFrame:
    """(by, _lo, _hi): for each level a pair of values that very likely enclose its ranks; ``whole``: surely."""
    sketched = known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_total"), F.min("_v").alias("_least"), F.max("_v").alias("_most"),
        *([] if whole else [F.kll_sketch_agg_double("_v", F.lit(SKETCH_K)).alias("_sketch")]),
    )

    if whole:
        ends = [(F.col("_least"), F.col("_most"))] * len(probs)
    else:
        few = F.col("_total") <= SKETCH_K  # a group this small is opened whole

        def at(share: float, end: str) -> Column:
            if not 0 < share < 1:
                return F.col(end)
            return F.when(few, F.col(end)).otherwise(F.kll_sketch_get_quantile_double("_sketch", F.lit(float(share))))

        ends = [(at(p - MARGIN, "_least"), at(p + MARGIN, "_most")) for p in probs]
    return sketched.select(*by, F.array(*[x for x, _ in ends]).alias("_lo"), F.array(*[x for _, x in ends]).alias("_hi"))


def _collapsed(known: DataFrame, brackets: DataFrame, by: list[str], levels: int) -> DataFrame:
    """(by, _pos, _gap, _n): values inside a bracket with their counts; all values between two brackets are one row.

    The order of (_pos, _gap) is that of the values.
    """
    held = lookup_join(known, brackets, by, ["_v"], stored=True)
    lows, highs = [F.col("_lo")[i] for i in range(levels)], [F.col("_hi")[i] for i in range(levels)]
    inside = reduce(lambda a, b: a | b, [F.col("_v").between(x, y) for x, y in zip(lows, highs)])
    below = [F.when(y < F.col("_v"), y) for y in highs]
    before = F.coalesce(F.greatest(*below) if levels > 1 else below[0], F.lit(float("-inf")))
    placed = held.select(*by, F.when(inside, F.col("_v")).otherwise(before).alias("_pos"), F.when(inside, 0).otherwise(1).alias("_gap"))
    return placed.groupBy(*by, "_pos", "_gap").agg(F.count(F.lit(1)).alias("_n"))


def _cumulated(table: DataFrame, group: Sequence[str], *order: str) -> DataFrame:
    upto = Window.partitionBy(*group).orderBy(*order)
    whole = Window.partitionBy(*group)
    return table.withColumn("_hi", F.sum("_n").over(upto)).withColumn("_lo", F.col("_hi") - F.col("_n")).withColumn(
        "_total", F.sum("_n").over(whole)
    )


def _searched(probs: Sequence[float]) -> Column:
    """The ranks of a group that fall into [_lo, _hi)."""
    ranks = [F.struct(F.lit(i).alias("q"), F.lit(side).alias("side"), k.alias("k")) for i, side, k in _places(F.col("_total"), probs)]
    return F.filter(F.array(*ranks), lambda r: (r["k"] >= F.col("_lo")) & (r["k"] < F.col("_hi")))


def _narrowed(counts: DataFrame, by: list[str], probs: Sequence[float]) -> DataFrame:
    """The same counts with fewer rows: a sketch of the values left gives buckets, and those without a searched
    rank become one row each."""
    shares = F.array(*[F.lit((j + 1) / BUCKETS) for j in range(BUCKETS - 1)])
    splits = (
        counts.groupBy(*by).agg(F.kll_sketch_agg_double("_pos", F.lit(SKETCH_K)).alias("_sketch"))
        .select(*by, F.kll_sketch_get_quantile_double("_sketch", shares).alias("_splits"))
    )
    dealt = lookup_join(counts, splits, by, ["_pos"]).withColumn("_bucket", F.size(F.filter("_splits", lambda x: x <= F.col("_pos"))))
    dealt = checkpointed(dealt.drop("_splits"))
    sums = _cumulated(dealt.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_n")), by, "_bucket")
    opened = sums.select(*by, "_bucket", (F.size(_searched(probs)) > 0).alias("_open"))
    marked = lookup_join(dealt, opened, [*by, "_bucket"], ["_pos"])
    shut = marked.filter("NOT _open").groupBy(*by, "_bucket").agg(
        F.max("_pos").alias("_pos"), F.lit(1).alias("_gap"), F.sum("_n").alias("_n")
    )
    columns = [*by, "_pos", "_gap", "_n"]
    return checkpointed(marked.filter("_open").select(*columns).unionByName(shut.select(*columns)))


def quantiles(
    df: DataFrame, by: Sequence[str], column: str, probs: Sequence[float], row_target: int = ROW_TARGET
) -> DataFrame:
    """Exact quantiles with linear interpolation: ``by`` + ``p_<percent>`` columns.

    ``percentile`` would hold all distinct values of a group in one task. Here a first scan builds one mergeable rank sketch
    for each group, which encloses every searched rank between two values, wherever they lie. A second scan counts the values inside
    these brackets exactly and everything between two brackets as one row. While a group still has more than
    ``row_target`` rows, a sketch of these splits them again; the table itself is not read any more. A rank that the sketch
    did not enclose is noticed, as it falls between two brackets, and its group is searched anew without a first guess.
    """
    by = list(by)
    known = df.select(*by, known_double(F.col(column)).alias("_v"))
    for c in [*by, "_v"]:
        known = known.filter(F.col(c).isNotNull())
    known = known.withColumn("_v", F.col("_v") + F.lit(0.0))  # one zero

    def ranks(rows: DataFrame, whole: bool) -> DataFrame:
        brackets = checkpointed(_brackets(rows, by, probs, whole))
        counts = checkpointed(_collapsed(rows, brackets, by, len(probs)))

        def largest() -> int:
            return counts.groupBy(*by).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]

        size = largest()
        while size > row_target:
            counts = _narrowed(counts, by, probs)
            before, size = size, largest()
            if size >= before:  # as many rows as searched ranks can have
                break
        cells = _cumulated(counts, by, "_pos", "_gap")
        return cells.withColumn("_hit", F.explode(_searched(probs))).select(*by, "_total", "_pos", "_gap", "_hit.q", "_hit.side")

    found = checkpointed(ranks(known, False))
    missed = found.filter("_gap = 1").select(*by).distinct()
    if not missed.isEmpty():
        missed = checkpointed(missed)
        again = ranks(known.join(missed, by, "left_semi"), True)
        found = found.join(missed, by, "left_anti").unionByName(again)

    def picked(i: int, side: int) -> Column:
        return F.max(F.when((F.col("q") == i) & (F.col("side") == side), F.col("_pos")))

    out = []
    for i, p in enumerate(probs):
        place = (F.max("_total") - 1) * F.lit(float(p))
        part = place - F.floor(place)
        out.append((picked(i, 0) + (picked(i, 1) - picked(i, 0)) * part).alias(f"p_{round(p * 100)}"))
    return found.groupBy(*by).agg(*out)


def describe_by(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Count, mean, deviation, least, quartiles and greatest value per group."""
    value = known_double(F.col(column))
    known_group = df
    for c in by:
        known_group = known_group.filter(F.col(c).isNotNull())
    basic = known_group.groupBy(*by).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    quarts = quantiles(known_group, by, column, [0.25, 0.5, 0.75])
    return basic.join(quarts, list(by), "left")


def long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per cell: (column, value)."""
    return df.select(*[known_double(F.col(c)).alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "value"
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``describe_by`` for several numeric columns at once, one row per column."""
    return describe_by(long_form(df, columns), ["column"], "value")


def box_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """What a box chart shows: quartiles, 1.5 IQR fences and how many values lie outside."""
    cells = long_form(df, columns)
    quarts = quantiles(cells, ["column"], "value", [0.25, 0.5, 0.75])
    reach = (F.col("p_75") - F.col("p_25")) * 1.5
    fences = quarts.select(
        "column", "p_25", "p_50", "p_75",
        (F.col("p_25") - reach).alias("low_fence"), (F.col("p_75") + reach).alias("high_fence"),
    )
    # one row per column of the table, so the lookup is as small as the schema
    outside = F.count_if(
        (F.col("value") < F.col("low_fence")) | (F.col("value") > F.col("high_fence"))
    )
    return (
        cells.join(F.broadcast(fences), "column")
        .groupBy("column", "p_25", "p_50", "p_75", "low_fence", "high_fence")
        .agg(outside.alias("n_outside"))
    )


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between the least and the greatest value: bin, left edge, count.

    The range is a scalar subquery.
    """
    values = df.select(known_double(F.col(column)).alias("_v")).filter(F.col("_v").isNotNull())
    edges = values.agg(F.struct(F.min("_v").alias("lo"), F.max("_v").alias("hi"))).scalar()
    placed = values.withColumn("_e", edges).select(
        "_v", F.col("_e.lo").alias("_lo"), ((F.col("_e.hi") - F.col("_e.lo")) / bins).alias("_w")
    )
    bin_no = F.when(
        F.col("_w") > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / F.col("_w")) + 1, F.lit(bins))
    ).otherwise(1)
    counted = placed.select(bin_no.cast("int").alias("bin"), "_lo", "_w").groupBy("bin", "_lo", "_w").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counted.select("bin", (F.col("_lo") + (F.col("bin") - 1) * F.col("_w")).alias("left_edge"), "n")


#: Rows of a group that one task lists.
HOT_LIST_ROWS = 10_000


def counted_lists(df: DataFrame, keys: Sequence[str], lists: dict[str, str], hot_rows: int = HOT_LIST_ROWS) -> DataFrame:
    """Group size and sorted lists per key: one row per key whatever the size of the group.

    A list holds each distinct item once, as ``{item, n}`` with how often it occurs (texts;
    null items are left out), so it is bounded by the catalogue it is drawn from and not by
    the rows of the group. Rows without a key belong to no group.

    The rows of a group are shuffled once, by its key, and counted there from sorted lists. Groups of about ``hot_rows`` rows
    and more are too much for one task: their items are counted with map-side combine first, under a shuffle of their own.
    """
    keys = list(keys)
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    items = {f"_item{i}": F.col(c) for i, c in enumerate(lists.values())}
    rows = checkpointed(df.select(*keys, *[c.alias(n) for n, c in items.items()]))
    hot = F.broadcast(hot_hashes(rows, keys, hot_rows))  # bounded by the summary
    marked = rows.withColumn("_hash", key_hash(keys, [rows.schema[k].dataType for k in keys])).join(hot, "_hash", "left")
    rest = marked.filter(F.col("_salts").isNull()).select(*keys, *items)
    sorted_ = rest.repartition(*keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("size"), *[F.sort_array(F.collect_list(F.col(c).cast("string"))).alias(c) for c in items]
    )
    starts = sorted_.withColumns({f"{c}_starts": _run_starts(F.col(c)) for c in items})
    small = starts.select(*keys, "size", *[_runs(F.col(c), F.col(f"{c}_starts")).alias(name) for c, name in zip(items, lists)])
    large = _lists_of_hot(marked.filter(F.col("_salts").isNotNull()), keys, dict(zip(lists, items)))
    return small.unionByName(large)


def _run_starts(values: Column) -> Column:
    """Where a new value begins in a sorted list."""
    at = F.sequence(F.lit(0), F.size(values) - 1)
    return F.when(F.size(values) > 0, F.filter(at, lambda i: (i == 0) | (F.get(values, i) != F.get(values, i - 1)))).otherwise(
        F.array().cast("array<int>")
    )


def _runs(values: Column, starts: Column) -> Column:
    return F.transform(starts, lambda i, j: F.struct(
        F.get(values, i).alias("item"), (F.coalesce(F.get(starts, j + 1), F.size(values)) - i).cast("long").alias("n")
    ))


def _lists_of_hot(df: DataFrame, keys: Sequence[str], lists: dict[str, str]) -> DataFrame:
    """``counted_lists`` of groups of any size; the lists share one count."""
    cells = [F.struct(F.lit(name).alias("list"), F.col(c).cast("string").alias("item")) for name, c in lists.items()]
    whole = F.struct(F.lit("").alias("list"), F.lit("").alias("item"))
    counts = (
        df.select(*keys, F.explode(F.array(whole, *cells)).alias("_c")).select(*keys, "_c.*")
        .filter(F.col("item").isNotNull()).groupBy(*keys, "list", "item").agg(F.count(F.lit(1)).alias("n"))
    )
    entry = F.struct("item", "n")
    return counts.groupBy(*keys).agg(
        F.max(F.when(F.col("list") == "", F.col("n"))).alias("size"),
        *[F.sort_array(F.collect_list(F.when(F.col("list") == name, entry))).alias(name) for name in lists],
    )


def list_text(column: str) -> Column:
    """A counted list as text: ``item`` or ``item*n``, between blanks."""
    def shown(e: Column) -> Column:
        return F.when(e["n"] > 1, F.concat(e["item"], F.lit("*"), e["n"].cast("string"))).otherwise(e["item"])

    return F.array_join(F.transform(column, shown), " ")


GRID_POINTS = 200
CUT = 3


def density(df: DataFrame, column: str, points: int = GRID_POINTS, cut: float = CUT) -> DataFrame:
    """(x, density): the smoothed curve over a histogram, at ``points`` places from ``cut`` widths below the least value
    to as many above the greatest.

    A Gaussian kernel of rule-of-thumb width (deviation x n^(-1/5)) over linear bins: every value shares its weight between
    the two grid points beside it, so one pass with map-side combine reduces the table to ``points`` weights, and
    the convolution only sees those. Without two different values there is no curve.
    """
    known = df.select(known_double(F.col(column)).alias("v")).filter(F.col("v").isNotNull())
    shape = known.agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("deviation"), F.min("v").alias("least"), F.max("v").alias("most")
    ).filter("deviation > 0")
    width = F.col("deviation") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    start, reach = F.col("least") - cut * width, F.col("most") - F.col("least") + 2 * cut * width
    grid = shape.select(
        F.struct("n", width.alias("width"), start.alias("start"), (reach / (points - 1)).alias("step")).alias("grid")
    ).scalar()
    placed = known.withColumn("grid", grid).filter(F.col("grid").isNotNull()).select(
        "grid.*", ((F.col("v") - F.col("grid.start")) / F.col("grid.step")).alias("place")
    )
    at = F.least(F.floor("place"), F.lit(points - 2).cast("long"))
    part = F.col("place") - at
    shares = F.array(F.struct(at.alias("i"), (1 - part).alias("w")), F.struct((at + 1).alias("i"), part.alias("w")))
    weights = (
        placed.select("n", "width", "start", "step", F.explode(shares).alias("s"))
        .groupBy("n", "width", "start", "step", "s.i").agg(F.sum("s.w").alias("w"))
    )
    curve = weights.groupBy("n", "width", "start", "step").agg(F.collect_list(F.struct("i", "w")).alias("bins"))  # at most ``points``
    out = curve.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))

    def kernel(total: Column, b: Column) -> Column:
        u = (F.col("j") - b["i"]) * F.col("step") / F.col("width")
        return total + b["w"] * F.exp(u * u * -0.5)

    height = F.aggregate(F.array_sort("bins"), F.lit(0.0), kernel)
    return out.select(
        (F.col("start") + F.col("j") * F.col("step")).alias("x"),
        (height / (F.col("n") * F.col("width") * math.sqrt(2 * math.pi))).alias("density"),
    )
