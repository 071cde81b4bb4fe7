"""Model tables of the given tables: entry data and study years of the customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.text import clean
from termloom.operators.cascade import Stage, fit_cascade
from termloom.operators.encode import condition_code, sex_code
from termloom.operators.models import DEEPEST
from termloom.operators.outcomes import two_way, with_targets
from termloom.operators.panel import year_window
from termloom.operators.rows import split_population
from termloom.plans.bundle import Bundle, Recipe, load_bundle, schema_hash, score_stored
from termloom.plans.standin_mart import labelled
from termloom.plans.training import entry_table, fit_year, year_feature_names, year_table
from termloom.session import checkpointed
from termloom.sources import standins

NUMERIC = ["age_in", "year_in", "trim_in", "nation", "sex_n"]
CATEGORIES = ["admin_type", "area_in_name"]
ENTRY_FEATURES = [*NUMERIC, *[f"{c}_code" for c in CATEGORIES]]
TARGETS = ["y_two", "y_m1", "y_m2", "y_m3", "y_m4"]
ATTRIBUTES = ["amount", "n_orders", "gap", "course_quant", "credits_total"]
COMPONENTS = 125
RECIPE = Recipe(NUMERIC, CATEGORIES, ATTRIBUTES, "cond_code", COMPONENTS)
PARAMS = {"minInstancesPerNode": 5, "maxDepth": DEEPEST}


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled entities with numeric targets; the sex that is not known has its own code."""
    rows = with_targets(labelled(spark, sf_dir)).withColumns(
        {"sex_n": F.coalesce(sex_code(F.col("sex")), F.lit(2)), "y_two": two_way(F.col("y_num"))}
    )
    return checkpointed(rows.select("id", "y", "program_in", "sex", *NUMERIC, *CATEGORIES, *TARGETS))


def closed_and_open(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities with a final label for training, the others for scoring."""
    still_open, final = split_population(rows.filter("y IS DISTINCT FROM 'suspended'"), "y", ["active"])
    return final, still_open


def model_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms with measures and coded conditions; the enrolment sums are reduced before they
    meet the terms."""
    sums = standins.enrolment(spark, sf_dir).groupBy("id", "year", "trim").agg(
        F.count(F.lit(1)).alias("course_quant"), F.sum("credits").alias("credits_total")
    )
    p = standins.panel_with_quant(spark, sf_dir).withColumns(
        {
            "amount": F.col("amount_cents") / 1e7,  # about the size of the other measures
            "gap": F.coalesce("prev_trims_out", F.lit(0)),
            "cond_code": condition_code(clean(F.col("acad_condition"))),
        }
    )
    return checkpointed(p.join(sums, ["id", "year", "trim"], "left"))


def year_courses(spark: SparkSession, sf_dir: str, panel: DataFrame, year_no: int) -> DataFrame:
    """How often each course code occurs in a study year: ``id, token, n``. Events are reduced
    to counts before they meet the panel."""
    counted = (
        standins.enrolment(spark, sf_dir)
        .groupBy("id", "year", "trim", "clave").agg(F.count(F.lit(1)).alias("k"))
    )
    window = year_window(panel, year_no).select("id", "year", "trim")
    return (
        counted.join(window, ["id", "year", "trim"])
        .groupBy("id", F.col("clave").cast("string").alias("token")).agg(F.sum("k").alias("n"))
    )


def years(spark: SparkSession, sf_dir: str, year_nos=(1, 2, 3), max_iter: int = 100):
    """Year tables of all entities and the models learned on the closed ones."""
    rows = people(spark, sf_dir)
    panel = model_panel(spark, sf_dir)
    closed = closed_and_open(rows)[0].select("id")
    out = []
    for n in year_nos:
        courses = checkpointed(year_courses(spark, sf_dir, panel, n))
        fitted = fit_year(
            panel.join(closed, "id", "left_semi"), courses, n, ATTRIBUTES, "cond_code", COMPONENTS, max_iter=max_iter
        )
        table, _ = year_table(panel, courses, n, ATTRIBUTES, "cond_code", COMPONENTS, fitted)
        out.append((checkpointed(table), fitted))
    return rows, out


def cascade_data(spark: SparkSession, sf_dir: str, balanced: bool = False, max_iter: int = 100, year_nos=(1, 2, 3)):
    """Stages and their tables for all entities, training rows and open rows."""
    rows, year_tables = years(spark, sf_dir, year_nos, max_iter)
    final, still_open = closed_and_open(rows)
    entry, _ = entry_table(rows, NUMERIC, CATEGORIES, TARGETS)
    entry = checkpointed(entry)
    stages = [Stage("year1", ENTRY_FEATURES, "y_m1", balanced=balanced, params=PARAMS)]
    tables = [entry]
    for n, (table, fitted) in zip([y + 1 for y in year_nos], year_tables):
        names = year_feature_names(n - 1, ATTRIBUTES, "cond_code", fitted)
        stages.append(Stage(f"year{n}", names, f"y_m{n}", balanced=balanced, params=PARAMS))
        tables.append(table.join(rows.select("id", *TARGETS), "id", "left"))
    train = [t.join(final.select("id"), "id", "left_semi") for t in tables]
    active = [t.join(still_open.select("id"), "id", "left_semi") for t in tables]
    return rows, stages, train, active, still_open


def fit_bundle(spark: SparkSession, sf_dir: str, year_nos=(1, 2), max_iter: int = 100) -> Bundle:
    """Everything that is fitted, on the closed entities alone, ready to be stored."""
    closed, _ = closed_and_open(people(spark, sf_dir))
    panel = checkpointed(model_panel(spark, sf_dir).join(closed.select("id"), "id", "left_semi"))
    entry, encoders = entry_table(closed, NUMERIC, CATEGORIES, TARGETS)
    stages, tables, fitted = [Stage("year1", ENTRY_FEATURES, "y_m1", params=PARAMS)], [checkpointed(entry)], []
    hashes = {"entities": schema_hash(closed, RECIPE.inputs()["entities"]), "panel": schema_hash(panel, RECIPE.inputs()["panel"])}
    for n in year_nos:
        courses = checkpointed(year_courses(spark, sf_dir, panel, n))
        hashes["courses"] = schema_hash(courses, RECIPE.inputs()["courses"])
        table, learned = year_table(panel, courses, n, ATTRIBUTES, RECIPE.condition, COMPONENTS, max_iter=max_iter)
        names = year_feature_names(n, ATTRIBUTES, RECIPE.condition, learned)
        stages.append(Stage(f"year{n + 1}", names, f"y_m{n + 1}", params=PARAMS))
        tables.append(checkpointed(table).join(closed.select("id", *TARGETS), "id", "left"))
        fitted.append((n, learned))
    models, _ = fit_cascade(stages, tables)
    return Bundle(RECIPE, stages, models, encoders, fitted, hashes)


def score_open(spark: SparkSession, sf_dir: str, path: str, keep=("age_in", "program_in", "year_in", "trim_in", "sex")) -> DataFrame:
    """The open entities scored by the newest bundle under ``path``; nothing is fitted here."""
    bundle = load_bundle(spark, path)
    _, still_open = closed_and_open(people(spark, sf_dir))
    panel = checkpointed(model_panel(spark, sf_dir).join(still_open.select("id"), "id", "left_semi"))
    courses = {n: checkpointed(year_courses(spark, sf_dir, panel, n)) for n, _ in bundle.years}
    return score_stored(bundle, still_open, panel, courses, [c for c in keep if c != "id"])
