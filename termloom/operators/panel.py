"""The entity x term panel: order, gaps, changes, last values, windows, reshaping.

All windows partition by entity and run on one row per entity and term. ``term_rollup``
or ``one_per_term`` bring any input to that form with an aggregate, so the rows of one
entity are bounded by the number of terms in the calendar, however many events it has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termloom.functions.columns import indicator
from termloom.functions.dates import term_label, term_number, terms_since, terms_skipped
from termloom.functions.text import zero_padded


def one_per_term(
    df: DataFrame, entity: str, first: str, attributes: Sequence[str], totals: dict[str, Column]
) -> DataFrame:
    """Several rows of an entity and term to one: attributes of the row lowest in ``first``
    (a null comes last), ``totals`` aggregated over all of them."""
    best = F.min(F.struct(F.col(first).isNull().alias("_null"), first, *[a for a in attributes if a != first])).alias("_first")
    return (
        df.groupBy(entity, "year", "trim")
        .agg(best, *[c.alias(name) for name, c in totals.items()])
        .select(entity, "year", "trim", *[F.col(f"_first.{a}").alias(a) for a in attributes], *totals)
    )


def term_order(panel: DataFrame, entity: str = "id") -> DataFrame:
    """1, 2, 3... for the terms an entity attended, and the label trim01, trim02..."""
    by_term = Window.partitionBy(entity).orderBy(term_number(F.col("year"), F.col("trim")))
    return panel.withColumn("trim_order", F.dense_rank().over(by_term)).withColumn(
        "trim_order_str", zero_padded(F.col("trim_order"), 2, "trim")
    )


def term_gaps(panel: DataFrame, entity: str = "id") -> DataFrame:
    """Terms skipped before each attended term; null for the first."""
    by_term = Window.partitionBy(entity).orderBy(term_number(F.col("year"), F.col("trim")))
    year, trim = F.col("year"), F.col("trim")
    return panel.withColumn(
        "prev_trims_out",
        terms_skipped(year, trim, F.lag(year).over(by_term), F.lag(trim).over(by_term)),
    )


def change_flag(panel: DataFrame, column: str, name: str, entity: str = "id") -> DataFrame:
    """0 where ``column`` equals that of the previous term, 1 where it is known and does not
    (also when the previous one is null), null for a null and for the first term."""
    by_term = Window.partitionBy(entity).orderBy(term_number(F.col("year"), F.col("trim")))
    here = F.col(column)
    before = F.lag(here).over(by_term)
    is_first = F.row_number().over(by_term) == 1
    return panel.withColumn(
        name,
        F.when(is_first, F.lit(None)).when(here == before, 0).when(here.isNotNull(), 1).cast("int"),
    )


def entity_summary(
    panel: DataFrame,
    last: Sequence[str],
    reference: tuple[int, int],
    entity: str = "id",
) -> DataFrame:
    """One row per entity from a panel that has order, gaps and change flags.

    Terms attended, last year and term, ``last_<column>`` for every column in ``last``, total
    terms skipped, total programme changes and terms without attendance up to ``reference``.
    """
    t = term_number(F.col("year"), F.col("trim"))
    latest = F.max(F.struct(t.alias("t"), "year", "trim")).alias("_latest")
    known = [
        F.max(F.when(F.col(c).isNotNull(), F.struct(t.alias("t"), F.col(c).alias("v")))).alias(f"_{c}")
        for c in last
    ]
    grouped = panel.groupBy(entity).agg(
        F.max("trim_order").alias("trim_quant"),
        F.coalesce(F.sum("prev_trims_out"), F.lit(0)).cast("long").alias("prev_trims_out_sum"),
        F.coalesce(F.sum("program_change"), F.lit(0)).cast("long").alias("program_change_quant"),
        latest,
        *known,
    )
    year, trim = F.col("_latest.year"), F.col("_latest.trim")
    return grouped.select(
        entity, "trim_quant", "prev_trims_out_sum", "program_change_quant",
        year.alias("last_year_enroll"), trim.alias("last_trim_enroll"),
        term_label(year, trim).alias("last_termid"),
        terms_since(year, trim, *reference).alias("trim_unenroll_quant"),
        *[F.col(f"_{c}.v").alias(f"last_{c}") for c in last],
    )


def ever_paused(entities: DataFrame) -> DataFrame:
    """Entities that skipped a term at some time or are out at the reference term."""
    return entities.filter((F.col("prev_trims_out_sum") > 0) | (F.col("trim_unenroll_quant") > 0))


def reenrol_probability(panel: DataFrame, entities: DataFrame, entity: str = "id") -> DataFrame:
    """For every gap length up to the longest absence: entities that came back after exactly
    that gap, as percent of all that ever paused. An entity counts once per gap length."""
    returned = (
        panel.filter(F.col("prev_trims_out") > 0)
        .groupBy(F.col("prev_trims_out").alias("trim_out_quant"), entity).agg(F.lit(1).alias("_one"))
        .groupBy("trim_out_quant").agg(F.count(F.lit(1)).alias("n_entities"))
    )
    frame = (
        entities.agg(
            F.max("trim_unenroll_quant").alias("longest"),
            F.count_if((F.col("prev_trims_out_sum") > 0) | (F.col("trim_unenroll_quant") > 0)).alias("n_paused"),
        )
        .filter("longest >= 1")
        .select("n_paused", F.explode(F.expr("sequence(1, longest)")).alias("trim_out_quant"))
    )
    return frame.join(returned, "trim_out_quant", "left").select(
        "trim_out_quant",
        F.coalesce("n_entities", F.lit(0)).cast("long").alias("n_entities"),
        (F.try_divide(F.coalesce("n_entities", F.lit(0)), "n_paused") * 100).alias("prob_reenroll"),
    )


def survivors(entities: DataFrame, column: str = "trim_quant") -> DataFrame:
    """How many entities reached at least each value of ``column``."""
    downwards = Window.partitionBy(F.lit(0)).orderBy(F.desc(column)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )  # over one row per distinct value
    counts = entities.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("n_at_least", F.sum("n").over(downwards))


def at_risk(entities: DataFrame, label: str, milestones: Sequence[int] = (0, 4, 8, 12)) -> DataFrame:
    """Outcome counts among the entities with at least so many terms, one column each."""
    return entities.filter(F.col(label).isNotNull()).groupBy(label).agg(
        *[F.count_if(F.col("trim_quant") >= m).alias(f"n_ge_{m}") for m in milestones]
    )


def year_window(panel: DataFrame, year_no: int, entity: str = "id") -> DataFrame:
    """Rows of study year ``year_no`` (terms 4(n-1)+1 .. 4n) of the entities that completed it.

    ``trim_quant`` must be on the panel; the entity's number of terms is compared, so no join.
    """
    last = 4 * year_no
    return panel.filter(F.col("trim_order").between(last - 3, last) & (F.col("trim_quant") >= last))


def with_trim_quant(panel: DataFrame, entity: str = "id") -> DataFrame:
    return panel.withColumn("trim_quant", F.max("trim_order").over(Window.partitionBy(entity)))


def term_list(panel: DataFrame) -> list[int]:
    """All term orders of a panel, from one number: the greatest."""
    return list(range(1, 1 + (panel.agg(F.max("trim_order")).first()[0] or 0)))


def pivot_terms(
    panel: DataFrame, attributes: Sequence[str], orders: Sequence[int], entity: str = "id"
) -> DataFrame:
    """Long to wide: ``trimNN_<attribute>`` for the listed term orders, sorted by name.

    The list is given (``term_list`` finds that of a panel). Two rows of an entity for one term are an error, as
    none of them could stand in the cell.
    """
    def cell(n: int, a: str) -> Column:
        here = F.col("trim_order") == n
        twice = F.raise_error(F.concat(F.lit(f"term {n} has two rows of entity "), F.first(entity).cast("string")))
        return F.when(F.count_if(here) > 1, twice.cast(panel.schema[a].dataType)).otherwise(F.max(F.when(here, F.col(a))))

    cells = {f"trim{n:02d}_{a}": cell(n, a).alias(f"trim{n:02d}_{a}") for n in orders for a in attributes}
    return panel.groupBy(entity).agg(*[cells[name] for name in sorted(cells)])


def grouped_terms(
    enrolment: DataFrame, keys: Sequence[str], sums: dict[str, Column]
) -> DataFrame:
    """Events to one row per entity and term: number of events and the listed sums."""
    return enrolment.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("course_quant"),
        *[F.sum(c).alias(name) for name, c in sums.items()],
    )


def first_term_check(entities: DataFrame, panel: DataFrame, entity: str = "id") -> DataFrame:
    """1 where the year of entry is not the year of the first term on record."""
    first = panel.groupBy(entity).agg(F.min(F.struct("year", "trim")).alias("_first"))
    return (
        entities.join(first, entity, "left")
        .withColumn("trim01_year", F.col("_first.year")).withColumn("trim01_trim", F.col("_first.trim"))
        .drop("_first")
        .withColumn("check_first_term", 1 - indicator(F.col("year_in") == F.col("trim01_year")))
    )
