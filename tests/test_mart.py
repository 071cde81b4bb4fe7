"""The whole job from source tables to labelled entities, on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from termloom.operators import checks
from termloom.operators.panel import pivot_terms, with_trim_quant, year_window
from termloom.plans.mart import build_mart, modelling_rows
from termloom.sources.tables import SCHEMAS, read_tables, write_table
from tests.conftest import collect

D = dt.date
T = dt.datetime


def person(i, **changes):
    row = dict(
        id=i, active="NO", grad_date=None, nivel="G1", year_in=2019, trim_in=1, honor=None, age_in=18, age_out=None,
        date_in=T(2019, 1, 10), program="INF ", program_desc="Informatica", program_in="INF", program_in_desc="Informatica",
        admin_type="REGULAR", credit_conv=0.0, cred_recon=0.0, changed="NO",
    )
    return {**row, **changes}


def term(i, year, trim, condition="NORMAL", program="INF", nivel="G1"):
    return dict(id=i, year=year, trim=trim, program=program, nivel=nivel, gpa_trim=3.0, gpa_cum=3.0, acad_condition=condition)


def course(i, year, trim, clave, grade, credits=4.0):
    return dict(
        id=i, clave=clave, sec="1", year=year, trim=trim, teachid=9, select_date_time=T(year, 1, 1), retiro=None,
        retiro_date_time=None, grade=grade, credits=credits,
    )


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    registry = [
        person(1, grad_date=D(2021, 1, 1)), person(2), person(3), person(4), person(5), person(6, program="ADM"),
        person(6, program="INF", date_in=T(2018, 1, 1)), person(7, nivel="G2"), person(8, year_in=2005),
        person(9, changed="SI"), person(10, year_in=2022, trim_in=4), person(11),
    ]
    terms = [
        term(1, 2019, 1), term(1, 2022, 3),  # graduated and enrolled in the current term
        term(2, 2022, 3),  # active
        term(3, 2019, 1), term(3, 2019, 2, "SEPARADO PERMANENCIA"), term(3, 2019, 3, None),
        term(4, 2019, 1), term(4, 2019, 2), term(4, 2019, 4, program="ADM"), term(4, 2021, 1, "SUSPENDIDO"),
        term(5, 2022, 2), term(5, 2022, 1), term(5, 2022, 4),  # out for one term; the incomplete term is dropped
        term(6, 2022, 1, None),  # out for two terms without a condition
        term(3, 2020, 1, nivel="G2"),
    ]
    early = [course(4, 2019, 1, "A1", "A"), course(4, 2019, 1, "A2", "RE"), course(4, 2019, 1, "A3", None)]
    late = [course(4, 2021, 1, "A1", "B+", 3.0), course(4, 2021, 1, "A4", "NS", 2.0)]
    biography = [dict(id=1, dob="2000-01-01", sex="M", nationality=" ", birth_city="", birth_country="DO", address="", city="x", country="y")]
    admission = [{**{c.split()[0]: None for c in SCHEMAS["admission_test"].split(", ")}, "id": 4, "paa_verb": 1595.0, "paa_mat": 500.0}]
    areas = [
        dict(program="INF", program_name="Informatica", nivel="GRADO", area="I", area_name="INGENIERIAS"),
        dict(program="ADM", program_name="Administracion", nivel="GRADO", area="N", area_name="NEGOCIOS"),
    ]
    given = dict(
        registry=registry, biography=biography, enrolment=early, gpa_term=terms, programme_area=areas, admission_test=admission
    )
    folder = str(tmp_path_factory.mktemp("sources"))

    def frame(rows, schema):
        names = [c.split()[0] for c in schema.split(", ")]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)

    for name, rows in given.items():
        write_table(frame(rows, SCHEMAS[name]), f"{folder}/{name}", "csv" if name == "programme_area" else "parquet")
    tables = read_tables(spark, folder, [n for n in given if n != "programme_area"])
    tables |= read_tables(spark, folder, ["programme_area"], "csv")
    tables["enrolment_2"] = frame(late, SCHEMAS["enrolment"])
    return tables


@pytest.fixture(scope="module")
def mart(sources):
    entities, panel = build_mart(sources, (2022, 3), ["2022_3", "2022_4"], {"paa_verb": {4: 595.0}})
    return entities.cache(), panel.cache()


def test_one_row_per_entity_after_the_filters(mart):
    assert [r["id"] for r in mart[0].orderBy("id").collect()] == [1, 2, 3, 4, 5, 6, 11]
    assert checks.unique_key(mart[0], ["id"]).first()["failures"] == 0


def test_labels(mart):
    got = dict(collect(mart[0].select("id", "y"), "id"))
    assert got == {
        1: "graduate", 2: "active", 3: "involuntary desertion", 4: "voluntary desertion", 5: None,
        6: "voluntary desertion", 11: None,
    }


def test_panel(mart):
    four = collect(
        mart[1].filter("id = 4").select(
            "termid", "trim_order_str", "prev_trims_out", "term_program_change", "course_quant", "new"
        ), "trim_order",
    )
    assert four == [
        ("2019_1", "trim01", None, None, 3, 0), ("2019_2", "trim02", 0, 0, None, 1),
        ("2019_4", "trim03", 1, 1, None, 1), ("2021_1", "trim04", 4, 1, 2, 0),
    ]
    first = mart[1].filter("id = 4 AND trim_order = 1").first()
    assert (first["passed_quant"], first["withdrawn_quant"], first["grade_nan_quant"], first["credits_nan"]) == (1, 1, 1, 4.0)
    assert mart[1].filter("termid = '2022_4' OR nivel = 'G2'").count() == 0


def test_entity_features(mart):
    four = mart[0].filter("id = 4").first()
    assert (four["trim_quant"], four["prev_trims_out_sum"], four["program_change_quant"]) == (4, 5, 2)
    assert (four["last_termid"], four["trim_unenroll_quant"], four["last_program"]) == ("2021_1", 6, "INF")
    assert (four["paa_verb_fin"], four["admission_match"], four["last_area_name"]) == (595.0, "both", "INGENIERIAS")
    assert (four["year_order"], four["year_desert"]) == ("1st year", "2nd year")
    three = mart[0].filter("id = 3").first()
    assert three["last_acad_condition"] == "SEPARADO PERMANENCIA"
    six = mart[0].filter("id = 6").first()
    assert (six["program"], six["program_change"], six["admission_match"]) == ("INF", 0, "left_only")
    one = mart[0].filter("id = 1").first()
    assert one["nationality"] is None and one["birth_city"] is None and one["birth_country"] == "DO"


def test_wide_form_and_year_window(mart):
    panel = with_trim_quant(mart[1])
    wide = pivot_terms(panel, ["gpa_trim", "termid"], [1, 2])
    assert wide.columns == ["id", "trim01_gpa_trim", "trim01_termid", "trim02_gpa_trim", "trim02_termid"]
    assert {r["id"] for r in year_window(panel, 1).select("id").distinct().collect()} == {4}


def test_modelling_rows(spark, mart):
    entities = mart[0].withColumn("sex", F.lit("m")).withColumn(
        "admin_type", F.when(F.col("id") == 2, "PROFESIONAL").when(F.col("id") == 3, "OWN").when(F.col("id") > 3, F.col("admin_type"))
    )
    kept = modelling_rows(entities, ["OWN"], mart[1])
    assert [r["id"] for r in kept.orderBy("id").collect()] == [1, 4, 5, 6, 11]


def test_checks(mart):
    entities, panel = mart
    graded = panel.filter("new = 0")
    assert checks.parts_add_up(
        graded, "course_quant", ["passed_quant", "failed_quant", "withdrawn_quant", "other_quant", "grade_nan_quant"]
    ).first()["failures"] == 0
    assert checks.frequency_complete(entities, "y").first()["failures"] == 0
    assert checks.no_rows(entities, F.col("y") == "suspended", "none").first()["failures"] == 0
    assert checks.same_keys(panel.select("id"), entities.select("id"), ["id"]).first()["failures"] == 0
    assert checks.same_keys(entities, panel, ["id"]).first()["failures"] == 1
