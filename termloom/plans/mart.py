"""From source tables to one labelled row per entity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions import codes as fixed
from termloom.functions.columns import indicator
from termloom.functions.conditions import differs, not_among
from termloom.functions.dates import term_label
from termloom.functions.text import blank_to_null, joined_key, strip
from termloom.operators.cleaning import limit_scores, pick_version
from termloom.operators.grading import term_rollup, with_grade_status
from termloom.operators.joins import attach, attach_checked, attach_marked
from termloom.operators.outcomes import changed_since_entry, graduated, outcome, year_of_dropout, year_reached
from termloom.operators.panel import change_flag, entity_summary, term_gaps, term_order
from termloom.operators.rows import first_per_key, override_cells, union_tables


def label_entities(entities: DataFrame, current_terms: Sequence[str]) -> DataFrame:
    """Outcome, year reached and year of dropout for rows that carry ``grad`` and the
    entity summary."""
    labelled = entities.withColumn(
        "y",
        outcome(
            F.col("grad"), F.col("last_termid"), F.col("last_acad_condition"),
            F.col("trim_unenroll_quant"), list(current_terms),
        ),
    )
    return labelled.withColumns(
        {
            "year_desert": year_of_dropout(F.col("y"), F.col("trim_quant")),
            "year_order": year_reached(F.col("trim_quant")),
        }
    )


def clean_registry(
    registry: DataFrame, level: str = "G1", first_year: int = 2007, dropped_term: str = "2022_4"
) -> DataFrame:
    """First degrees, entered since ``first_year``, last programme record, one row per id,
    without the incomplete term; graduation and programme-change flags added."""
    kept = registry.withColumns({c: strip(F.col(c)) for c in ("program", "program_in")}).filter(
        (F.col("nivel") == level) & (F.col("year_in") >= first_year) & (F.col("changed") == "NO")
    )
    unique = first_per_key(kept, ["id"], ["date_in", "program"])
    flagged = unique.withColumns(
        {
            "grad": graduated(F.col("grad_date")),
            "program_change": changed_since_entry(F.col("program"), F.col("program_in")),
            "termid_in": term_label(F.col("year_in"), F.col("trim_in")),
        }
    )
    return flagged.filter(differs(F.col("termid_in"), dropped_term))


def clean_biography(biography: DataFrame) -> DataFrame:
    return biography.withColumns(
        {f.name: blank_to_null(F.col(f.name)) for f in biography.schema if f.dataType.typeName() == "string"}
    )


def clean_admission(
    tests: DataFrame, corrections: Mapping[str, Mapping[int, float]] | None = None
) -> DataFrame:
    """Point corrections, limits, then the version with the higher mean."""
    for column, cells in (corrections or {}).items():
        tests = override_cells(tests, "id", column, dict(cells))
    picked = pick_version(limit_scores(tests))
    return picked.select("id", *fixed.POMA_SCORES, *[c + "_fin" for c in fixed.VERSIONED_SCORES])


def build_panel(
    gpa_term: DataFrame,
    enrolment: DataFrame,
    areas: DataFrame,
    level: str = "G1",
    dropped_term: str = "2022_4",
) -> DataFrame:
    """GPA records with their enrolment sums, in term order, with gaps and programme changes.

    The order is taken before the incomplete term is dropped, which leaves earlier terms as
    they are.
    """
    key = joined_key(F.col("id"), F.col("year"), F.col("trim"))
    sums = term_rollup(with_grade_status(enrolment, "grade")).withColumn("id_termid", key)
    records = attach(gpa_term, areas.select("program", "area", "area_name", "program_name"), ["program"])
    records = records.withColumns(
        {"id_termid": key, "termid": term_label(F.col("year"), F.col("trim"))}
    )
    joined = attach_checked(records, sums, "id_termid", ["id", "year", "trim"])
    ordered = term_order(joined.filter(F.col("nivel") == level))
    kept = ordered.filter(differs(F.col("termid"), dropped_term))
    return change_flag(term_gaps(kept), "program", "term_program_change")


def build_mart(
    sources: Mapping[str, DataFrame],
    reference: tuple[int, int],
    current_terms: Sequence[str],
    corrections: Mapping[str, Mapping[int, float]] | None = None,
    level: str = "G1",
    first_year: int = 2007,
    dropped_term: str = "2022_4",
) -> tuple[DataFrame, DataFrame]:
    """Entities and panel from the source tables (``tables.SCHEMAS``).

    ``enrolment`` may be given as several period tables (``enrolment_1``, ``enrolment_2``...).
    Wide term columns are not made here; ``panel.pivot_terms`` gives them where needed.
    """
    parts = [sources[n] for n in sorted(sources) if n.startswith("enrolment")]
    panel = build_panel(
        sources["gpa_term"], union_tables(*parts), sources["programme_area"], level, dropped_term
    )
    registry = clean_registry(sources["registry"], level, first_year, dropped_term)
    entities = attach(registry, clean_biography(sources["biography"]), ["id"])
    entities = attach_marked(
        entities, clean_admission(sources["admission_test"], corrections), ["id"], "admission_match"
    )
    last = entity_summary(
        panel.withColumnRenamed("term_program_change", "program_change"),
        ["acad_condition", "program", "program_name", "area", "area_name"],
        reference,
    )
    entities = attach(entities, last, ["id"])
    areas = sources["programme_area"].select("program", "area_name")
    entities = attach(entities, areas, ["program"])
    entities = attach(
        entities, areas.select(F.col("program").alias("program_in"), F.col("area_name").alias("area_in_name")),
        ["program_in"],
    )
    return label_entities(entities, current_terms), panel


def modelling_rows(
    entities: DataFrame, more_admissions: Sequence[str] = (), panel: DataFrame | None = None
) -> DataFrame:
    """Entities used for modelling: excluded admissions and programmes out (unknown ones
    stay), sex known. With a panel, its early terms are looked at as well."""
    kept = entities
    for value in [*fixed.EXCLUDED_ADMISSIONS, *more_admissions]:
        kept = kept.filter(differs(F.col("admin_type"), value))
    kept = kept.filter(
        not_among(F.col("program_in"), fixed.EXCLUDED_PROGRAMMES)
        & not_among(F.col("last_program"), fixed.EXCLUDED_TERM_PROGRAMMES)
        & F.col("sex").isNotNull()
    )
    if panel is None:
        return kept
    excluded = panel.filter(
        (F.col("trim_order").between(2, 4) & F.col("program").isin(fixed.EXCLUDED_TERM_PROGRAMMES))
        | ((F.col("trim_order") == 2) & (F.col("program_name") == fixed.EXCLUDED_PROGRAMME_NAME))
    ).groupBy("id").agg(F.lit(1).alias("_excluded"))
    marked = kept.join(excluded, "id", "left")
    return marked.filter(indicator(F.col("_excluded") == 1) == 0).drop("_excluded")
