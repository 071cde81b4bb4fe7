"""The cases every rebuilt rule has to get right, on hand-made rows."""

import datetime as dt
import unicodedata

import pytest
from pyspark.sql import functions as F

from termloom.functions import text
from termloom.functions.conditions import differs, not_among, row_mean, row_sum
from termloom.functions.dates import terms_since, year_repaired
from termloom.operators import cleaning, grading, outcomes, panel, rows
from termloom.operators.joins import attach_checked, fill_from_groups, map_values
from termloom.operators.models import risk
from termloom.operators.summaries import group_mode
from tests.conftest import collect


def with_gaps(spark, terms):
    df = spark.createDataFrame(terms, "id long, year int, trim int, program string")
    return panel.change_flag(panel.term_gaps(panel.term_order(df)), "program", "program_change")


def test_order_and_gaps(spark):
    terms = [(1, 2019, 1, "A"), (1, 2019, 2, "A"), (1, 2019, 4, "B"), (1, 2021, 1, None), (2, 2020, 2, "A")]
    p = with_gaps(spark, terms)
    assert collect(p.select("id", "trim_order_str", "prev_trims_out", "program_change"), "id", "trim_order") == [
        (1, "trim01", None, None), (1, "trim02", 0, 0), (1, "trim03", 1, 1), (1, "trim04", 4, None),
        (2, "trim01", None, None),
    ]
    s = panel.entity_summary(p, ["program"], (2022, 3))
    assert collect(
        s.select("id", "trim_quant", "prev_trims_out_sum", "program_change_quant", "last_termid", "last_program",
                 "trim_unenroll_quant"), "id",
    ) == [(1, 4, 5, 1, "2021_1", "B", 6), (2, 1, 0, 0, "2020_2", "A", 9)]


def test_change_after_unknown_programme(spark):
    p = with_gaps(spark, [(1, 2019, 1, "A"), (1, 2019, 2, None), (1, 2019, 3, "A")])
    assert [r[0] for r in collect(p.select("program_change", "trim_order"), "trim_order")] == [None, None, 1]


def test_terms_since(spark):
    row = spark.range(1).select(terms_since(F.lit(2021), F.lit(4), 2022, 3)).first()
    assert row[0] == 3


@pytest.mark.parametrize(
    "grad, termid, condition, out, expected",
    [
        (1, "2022_3", "NORMAL", 0, "graduate"),
        (0, "2022_3", "SEPARADO", 0, "active"),
        (0, "2020_1", "SEPARADO DEFINITIVAMENTE", 1, "involuntary desertion"),
        (0, "2020_1", "PROGRESO ACADEMICO NO SATISFAC", 1, "involuntary desertion"),
        (0, "2020_1", "PRIMERA SUSPENSION", 4, "voluntary desertion"),
        (0, "2020_1", "PRIMERA SUSPENSION", 3, "suspended"),
        (0, "2020_1", "NORMAL", 2, "voluntary desertion"),
        (0, "2020_1", None, 2, "voluntary desertion"),
        (0, "2020_1", "NORMAL", 1, None),
        (0, None, None, None, None),
    ],
)
def test_outcome(spark, grad, termid, condition, out, expected):
    df = spark.createDataFrame([(grad, termid, condition, out)], "g int, t string, c string, o int")
    label = outcomes.outcome(F.col("g"), F.col("t"), F.col("c"), F.col("o"), ["2022_3", "2022_4"])
    assert df.select(label).first()[0] == expected


def test_year_buckets_have_different_edges(spark):
    df = spark.createDataFrame([("voluntary desertion", n) for n in (4, 8, 12, 16, 17)] + [("active", 4)], "y string, n int")
    got = collect(
        df.select("n", "y", outcomes.year_reached(F.col("n")).alias("a"), outcomes.year_of_dropout(F.col("y"), F.col("n")).alias("b")),
        "y", "n",
    )
    assert got == [
        (4, "active", "1st year", None), (4, "voluntary desertion", "1st year", "2nd year"),
        (8, "voluntary desertion", "2nd year", "3rd year"), (12, "voluntary desertion", "3rd year", "4th year"),
        (16, "voluntary desertion", "4th year", "5th year +"), (17, "voluntary desertion", "5th year +", "5th year +"),
    ]


def test_fourth_target_takes_fifth_year(spark):
    df = spark.createDataFrame([("active", None), ("voluntary desertion", "5th year +")], "y string, year_desert string")
    assert collect(outcomes.with_targets(df).select("y_num", "y_m1", "y_m4"), "y_num") == [(1, 0, 1), (3, 0, 0)]


def test_null_safe_filters(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    assert df.filter(differs(F.col("v"), "a")).count() == 2
    assert df.filter(not_among(F.col("v"), ["a", "b"])).count() == 1


def test_grades(spark):
    df = spark.createDataFrame([(g, 4.0) for g in ("RE", "CU", "NS", "B+", "F", None, "ZZ")], "grade_orig string, credits double")
    got = {r["grade_orig"]: r for r in grading.with_grade_status(df).collect()}
    assert [got[g]["grade"] for g in ("RE", "CU", "NS", "B+", None, "ZZ")] == ["R", "CO", "OTH", "B+", None, "ZZ"]
    assert [got[g]["grade_status"] for g in ("RE", "CU", "NS", "F", None, "ZZ")] == [
        "withdrawn", "passed", "other", "failed", None, None,
    ]
    assert got[None]["grade_nan"] == 1 and got[None]["credits_nan"] == 4.0 and got[None]["passed"] == 0
    assert got["B+"]["grade_b_plus"] == 1 and got["B+"]["grade_b"] == 0


def test_row_reducers(spark):
    df = spark.createDataFrame([(1, None), (None, None), (2, 4)], "a int, b int")
    cols = [F.col("a"), F.col("b")]
    assert [tuple(r) for r in df.select(row_sum(cols), row_mean(cols)).collect()] == [(1, 1.0), (0, None), (6, 3.0)]


def test_score_limits(spark):
    df = spark.createDataFrame([(810.0, 0.0, -1.0, 4001.0, 500.0)], "paa_verb double, paa_redact double, poma_total double, poma_mat double, paa_mat double")
    assert tuple(cleaning.limit_scores(df).first()) == (None, None, None, None, 500.0)


def test_version_pick(spark):
    names = [c + s for s in ("", "_2") for c in ("paa_verb", "paa_mat", "paa_redact", "elash_total")]
    ddl = ", ".join(f"{n} double" for n in names)
    df = spark.createDataFrame(
        [(500.0, 500.0, 500.0, 1.0, 500.0, 520.0, 540.0, 2.0), (500.0, 500.0, 500.0, 1.0, None, None, None, 2.0),
         (None, None, None, 1.0, 500.0, None, None, 2.0)], ddl,
    )
    scores = ["paa_verb", "paa_mat", "paa_redact", "elash_total"]
    got = [tuple(r[c + "_fin"] for c in scores) for r in cleaning.pick_version(df, scores).collect()]
    assert got == [(500.0, 520.0, 540.0, 2.0), (500.0, 500.0, 500.0, 1.0), (None, None, None, 1.0)]


def test_city(spark):
    raw = ["Santo Domingo, Rep. Dom.", "Bonao/Monseñor", "SD (DN)", "Sto. Dgo.", None, "  San José  "]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, c string")
    got = [r[1] for r in collect(df.select("i", cleaning.clean_city(F.col("c"))), "i")]
    assert got == ["santo domingo", "bonao", None, "santo domingo", None, "san jose"]


def test_places_fill_each_other(spark):
    df = spark.createDataFrame(
        [(1, "X1", None, "do"), (2, None, "DOM", None), (3, "Bonao", "us", "us"), (4, None, None, None)],
        "id long, birth_city string, birth_country string, nationality string",
    )
    city_map = spark.createDataFrame([("bonao", "bonao centro")], "raw string, clean string")
    got = collect(cleaning.clean_places(df, city_map=city_map), "id")
    assert got == [
        (1, "ciudad republica dominicana", "do", "do"), (2, "ciudad republica dominicana", "do", "do"),
        (3, "bonao centro", "us", "us"), (4, None, None, None),
    ]


def test_entry_date_repair(spark):
    d = dt.date
    df = spark.createDataFrame(
        [(1, d(2004, 2, 29), 2007, 1), (2, None, 2010, 1), (3, d(2010, 1, 5), 2010, 1), (4, d(2010, 1, 4), 2010, 1),
         (5, d(2022, 5, 5), 2010, 1), (6, None, None, 1)],
        "id long, date_in date, year_in int, trim_in int",
    )
    got = dict(collect(cleaning.repair_entry_date(df, "date_in", "year_in", "trim_in", 2007, 2022).select("id", "date_in"), "id"))
    assert got[1] == d(2007, 2, 28)
    assert got[2] == d(2010, 1, 4)  # three dates once each: the lowest
    assert got[5] == d(2022, 5, 5) and got[6] is None


def test_mode_ties_take_the_lowest(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (1, None)], "g int, v string")
    assert collect(group_mode(df, ["g"], "v"), "g") == [(1, "a")]


def test_age_bounds(spark):
    df = spark.createDataFrame([(10,), (11,), (69,), (70,), (None,)], "a int")
    assert [r[0] for r in df.select(cleaning.plausible_age(F.col("a"))).collect()] == [None, 11, 69, None, None]


def test_unmatched_panel_row(spark):
    left = spark.createDataFrame([(1, 2020, "k1"), (2, 2020, "k2")], "id long, year int, key string")
    right = spark.createDataFrame([(1, 2020, "k1", 3)], "id long, year int, key string, course_quant int")
    got = collect(attach_checked(left, right, "key", ["id", "year"]).select("id", "course_quant", "new"), "id")
    assert got == [(1, 3, 0), (2, None, 1)]


def test_map_and_fill(spark):
    df = spark.createDataFrame([(1, "a"), (2, "z"), (3, None)], "id long, v string")
    table = spark.createDataFrame([("a", "A")], "raw string, clean string")
    assert collect(map_values(df, "v", table, "raw", "clean", ["id"]), "id") == [(1, "A"), (2, "z"), (3, None)]
    groups = spark.createDataFrame([(1, "x")], "id long, m string")
    assert collect(fill_from_groups(df.withColumn("v", F.lit(None).cast("string")), "v", groups, ["id"], "m", ["id"]), "id") == [
        (1, "x"), (2, None), (3, None),
    ]


def test_risk(spark):
    got = spark.range(1).select(F.round(risk(F.array(F.lit(0.7), F.lit(0.2), F.lit(0.1))), 6), risk(F.array(F.lit(1.0)))).first()
    assert tuple(got) == (0.3, 0.0)


def test_year_repair_of_null(spark):
    row = spark.range(1).select(year_repaired(F.lit(None).cast("date"), F.lit(2010), 2007, 2022)).first()
    assert row[0] is None


def test_padding_keeps_long_numbers(spark):
    got = spark.range(1).select(text.zero_padded(F.lit(7)), text.zero_padded(F.lit(123), 2, "trim"), text.joined_key(F.lit(1), F.lit(None))).first()
    assert tuple(got) == ("07", "trim123", None)


def test_to_ascii_over_all_characters(spark):
    chars = "".join(chr(c) for c in range(0x20, 0x110000) if not 0xD800 <= c <= 0xDFFF)
    pieces = [chars[i : i + 4000] for i in range(0, len(chars), 4000)]
    df = spark.createDataFrame([(p,) for p in pieces], "s string")
    for r in df.select("s", text.to_ascii(F.col("s")).alias("a")).collect():
        assert r["a"] == unicodedata.normalize("NFKD", r["s"]).encode("ascii", "ignore").decode()


def test_tokens_of_blank(spark):
    df = spark.createDataFrame([(" a  b\n",), ("  ",), (None,)], "s string")
    assert [r[0] for r in df.select(text.tokens(F.col("s"))).collect()] == [["a", "b"], [], None]


def test_null_out_and_override(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 9.0)], "id long, v double")
    assert [r[1] for r in collect(rows.override_cells(df, "id", "v", {2: 7.0, 3: 8.0}), "id")] == [5.0, 7.0, 8.0]
    assert [r[0] for r in collect(df.select(rows.null_outside(F.col("v"), 6, 10).alias("v"), "id"), "id")] == [None, None, 9.0]
