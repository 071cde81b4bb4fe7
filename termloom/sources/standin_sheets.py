"""The given tables in the shape of the source tables of ``tables.SCHEMAS``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.codes import POMA_SCORES
from termloom.sources import standins


def sheets(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Registry, biography and scores from customers, GPA records from orders, enrolments of
    two periods from line items, programme areas from the order priorities."""
    people = standins.registry(spark, sf_dir)
    key = F.col("id")
    registry = people.select(
        "id", "grad_date", "year_in", "trim_in", "age_in", "admin_type",
        F.when(key % 10 == 0, "G2").otherwise("G1").alias("nivel"),
        F.when(key % 11 == 0, "SI").otherwise("NO").alias("changed"),
        F.lit("1998-01-01").cast("timestamp").alias("date_in"),
        F.concat(F.lit(" "), "program_in").alias("program"), "program_in",
    )
    biography = people.select(
        "id", "sex", F.when(key % 4 == 0, "  ").otherwise(F.col("area_in_name")).alias("nationality")
    )
    score = F.col("balance_cents") % 900

    def other(shift: int):
        return ((F.col("balance_cents") + key * shift) % 800).cast("double")

    tests = people.filter(key % 5 != 0).select(
        "id", score.cast("double").alias("paa_verb"), other(3).alias("paa_mat"), other(5).alias("paa_redact"),
        F.when(key % 2 == 0, other(7)).alias("paa_verb_2"), other(11).alias("paa_mat_2"), other(13).alias("paa_redact_2"),
        *[F.col("balance_cents").cast("double").alias(c) for c in POMA_SCORES],
        *[other(17).alias(f"elash_{c}{v}") for v in ("", "_2") for c in ("total", "lang", "list", "read")],
    )
    gpa = standins.terms(spark, sf_dir).select(
        "id", "year", "trim", F.col("program_n").alias("program"), F.lit("G1").alias("nivel"),
        (F.col("amount_cents") / 100).alias("gpa_trim"), (F.col("amount_cents") / 100).alias("gpa_cum"), "acad_condition",
    )
    # one row per priority, a fixed small set of names
    areas = (
        standins.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("program")).distinct()
        .select(
            "program", F.substring("program", 3, 20).alias("program_name"), F.lit("GRADO").alias("nivel"),
            F.substring("program", 1, 1).alias("area"), F.concat(F.lit("AREA "), F.substring("program", 1, 1)).alias("area_name"),
        )
    )
    lines = standins.enrolment(spark, sf_dir).withColumnRenamed("grade_orig", "grade")
    return {
        "registry": registry, "biography": biography, "admission_test": tests, "gpa_term": gpa, "programme_area": areas,
        "enrolment_1": lines.filter("year < 1998"), "enrolment_2": lines.filter("year >= 1998"),
    }
