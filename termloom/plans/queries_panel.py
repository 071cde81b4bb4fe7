"""Registered queries: panel order, gaps, last values, reshaping, tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.functions.dates import terms_since
from termloom.operators import checks
from termloom.operators.grading import STATUSES, with_grade_status
from termloom.operators.outcomes import two_way, with_targets
from termloom.operators.panel import first_term_check, pivot_terms, term_list, year_window
from termloom.operators.rows import union_tables
from termloom.operators.spread import exploded_copies
from termloom.operators.vocabulary import joined_lists, learned_from, learned_only, list_tokens, text_tokens, token_counts, vocabulary
from termloom.plans import sql
from termloom.plans.mart import build_mart
from termloom.plans.registry import query
from termloom.plans.standin_mart import labelled
from termloom.session import checkpointed
from termloom.sources import standins
from termloom.sources.standin_sheets import sheets
from termloom.sources.standins import table


@query(
    "f_term_order",
    sql.with_(
        sql.PANEL,
        "SELECT id, termid, trim_order, 'trim' || CASE WHEN trim_order < 10 THEN '0' ELSE '' END || trim_order AS trim_order_str FROM panel",
    ),
)
def order_of_terms(spark, sf_dir):
    return standins.panel(spark, sf_dir).select("id", "termid", "trim_order", "trim_order_str")


@query("f_term_gaps", sql.with_(sql.PANEL, "SELECT id, termid, prev_trims_out FROM panel"))
def gaps(spark, sf_dir):
    return standins.panel(spark, sf_dir).select("id", "termid", "prev_trims_out")


@query("f_change_flag", sql.with_(sql.PANEL, "SELECT id, termid, program_n, program_change FROM panel"))
def changes(spark, sf_dir):
    return standins.panel(spark, sf_dir).select("id", "termid", "program_n", "program_change")


@query(
    "f_last_known",
    sql.with_(
        sql.SUMMARY,
        """SELECT id, last_acad_condition, last_program_n, last_status, last_year_enroll, last_trim_enroll, last_termid
           FROM summary""",
    ),
)
def last_values(spark, sf_dir):
    return standins.summary(spark, sf_dir).select(
        "id", "last_acad_condition", "last_program_n", "last_status", "last_year_enroll", "last_trim_enroll", "last_termid"
    )


@query(
    "f_entity_totals",
    sql.with_(sql.SUMMARY, "SELECT id, trim_quant, prev_trims_out_sum, program_change_quant FROM summary"),
)
def totals(spark, sf_dir):
    return standins.summary(spark, sf_dir).select("id", "trim_quant", "prev_trims_out_sum", "program_change_quant")


@query(
    "f_terms_since",
    sql.with_(sql.TERMS, "SELECT id, termid, 2001 * 4 + 3 - t AS terms_since FROM terms"),
)
def since(spark, sf_dir):
    ref = standins.REFERENCE_TERM
    return standins.terms(spark, sf_dir).select(
        "id", "termid", terms_since(F.col("year"), F.col("trim"), *ref).alias("terms_since")
    )


@query("f_terms_out", sql.with_(sql.SUMMARY, "SELECT trim_unenroll_quant, count(*) AS n FROM summary GROUP BY 1"))
def out_now(spark, sf_dir):
    return standins.summary(spark, sf_dir).groupBy("trim_unenroll_quant").agg(F.count(F.lit(1)).alias("n"))


WIDE = ["amount_cents", "program_n", "termid"]


@query(
    "i_pivot_terms",
    sql.with_(
        sql.PANEL,
        """, named AS (SELECT id, 'trim' || lpad(trim_order::VARCHAR, 2, '0') AS name, amount_cents, program_n, termid FROM panel)
           SELECT * FROM (PIVOT named ON name USING max(amount_cents) AS amount_cents, max(program_n) AS program_n,
             max(termid) AS termid GROUP BY id)""",
    ),
)
def wide_terms(spark, sf_dir):
    panel = checkpointed(standins.panel(spark, sf_dir).select("id", "trim_order", *WIDE))
    return pivot_terms(panel, WIDE, term_list(panel))


@query(
    "i_year_window",
    sql.with_(
        sql.PANEL,
        """SELECT id, termid, trim_order, CAST(ceil(trim_order / 4.0) AS INTEGER) AS year_no FROM quant
           WHERE trim_order <= 12 AND trim_quant >= 4 * ceil(trim_order / 4.0)""",
    ),
)
def windows(spark, sf_dir):
    p = standins.panel_with_quant(spark, sf_dir)
    years = [year_window(p, n).select("id", "termid", "trim_order", F.lit(n).alias("year_no")) for n in (1, 2, 3)]
    return years[0].unionByName(years[1]).unionByName(years[2])


COURSES = sql.PANEL + ", " + sql.ENROLMENT.replace(sql.ORD + ", ", "") + """, placed AS (
  SELECT e.id, CAST(ceil(q.trim_order / 4.0) AS INTEGER) AS year_no, q.trim_order, e.clave FROM enrolment e
  JOIN quant q ON e.id = q.id AND e.year = q.year AND e.trim = q.trim
  WHERE q.trim_order <= 12 AND q.trim_quant >= 4 * ceil(q.trim_order / 4.0))"""


def courses_by_year(spark, sf_dir):
    """Enrolments of the study years 1 to 3: the events are reduced to one row per entity,
    term and course before they meet the panel."""
    counted = standins.enrolment(spark, sf_dir).groupBy("id", "year", "trim", "clave").agg(F.count(F.lit(1)).alias("k"))
    p = standins.panel_with_quant(spark, sf_dir)
    years = [year_window(p, n).select("id", "year", "trim", "trim_order", F.lit(n).alias("year_no")) for n in (1, 2, 3)]
    return counted.join(years[0].unionByName(years[1]).unionByName(years[2]), ["id", "year", "trim"])


@query(
    "i_course_counts",
    sql.with_(COURSES, "SELECT id, year_no, CAST(clave AS VARCHAR) AS token, count(*) AS n FROM placed GROUP BY 1, 2, 3"),
)
def course_counts(spark, sf_dir):
    return courses_by_year(spark, sf_dir).groupBy("id", "year_no", F.col("clave").cast("string").alias("token")).agg(
        F.sum("k").alias("n")
    )


@query(
    "i_year_lists",
    sql.with_(
        COURSES,
        "SELECT id, year_no, trim_order, clave, count(*) AS n FROM placed GROUP BY 1, 2, 3, 4",
    ),
)
def year_lists(spark, sf_dir):
    """The course lists of the study years in long form: one row per entity, term and course
    at every size; the list of a year is its rows in the order of (trim_order, clave)."""
    return courses_by_year(spark, sf_dir).select("id", "year_no", "trim_order", "clave", F.col("k").alias("n"))


@query(
    "i_wide_lists",
    sql.with_(
        sql.PANEL,
        """SELECT id, string_agg(program_n, ' ' ORDER BY trim_order) FILTER (WHERE program_n IS NOT NULL) AS programmes
           FROM panel WHERE trim_order <= 4 GROUP BY id HAVING count(program_n) > 0""",
    ),
)
def wide_lists(spark, sf_dir):
    """List columns of the first terms, one per term, joined row by row; null lists add nothing."""
    listed = standins.panel(spark, sf_dir).filter("trim_order <= 4").withColumn(
        "l", F.when(F.col("program_n").isNotNull(), F.array("program_n"))
    )
    wide = pivot_terms(listed, ["l"], range(1, 5))
    joined = joined_lists(wide, [f"trim{n:02d}_l" for n in range(1, 5)], "all_terms")
    return joined.filter(F.size("all_terms") > 0).select("id", F.array_join("all_terms", " ").alias("programmes"))


@query(
    "i_explode_lists",
    sql.with_(COURSES, "SELECT id, year_no, CAST(clave AS VARCHAR) AS token FROM placed"),
)
def exploded(spark, sf_dir):
    single = courses_by_year(spark, sf_dir).withColumn("items", F.array(F.col("clave").cast("string")))
    copies = exploded_copies(single, "k", "_copy").withColumn("entry", F.struct("id", "year_no"))
    return list_tokens(copies, "entry", "items").select("entry.*", "token")


TOKENS = r"""tok AS (SELECT doc_id, token FROM (
  SELECT doc_id, unnest(regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\s+')) AS token FROM documents) WHERE token <> '')"""


@query(
    "i_token_counts",
    sql.with_(
        TOKENS,
        """SELECT doc_id, token, count(*) AS n FROM tok
           WHERE token IN (SELECT token FROM tok WHERE doc_id % 4 <> 0) GROUP BY 1, 2""",
    ),
)
def document_tokens(spark, sf_dir):
    rows = text_tokens(table(spark, sf_dir, "documents"), "doc_id", "text")
    counts = checkpointed(token_counts(rows, "doc_id"))  # texts are split once
    return learned_only(counts, learned_from(counts, F.col("doc_id") % 4 != 0))


@query(
    "k_first_term",
    sql.with_(
        sql.PANEL + ", " + sql.REGISTRY,
        """SELECT r.id, r.year_in, p.year AS trim01_year, p.trim AS trim01_trim,
                  CASE WHEN r.year_in = p.year THEN 0 ELSE 1 END AS check_first_term
           FROM registry r LEFT JOIN panel p ON r.id = p.id AND p.trim_order = 1""",
    ),
)
def first_term(spark, sf_dir):
    return first_term_check(
        standins.registry(spark, sf_dir).select("id", "year_in"), standins.terms(spark, sf_dir)
    )


@query(
    "k_outcome_label",
    sql.with_(sql.LABELLED, "SELECT id, grad, last_termid, last_acad_condition, trim_unenroll_quant, y FROM labelled"),
)
def outcome_label(spark, sf_dir):
    return labelled(spark, sf_dir).select("id", "grad", "last_termid", "last_acad_condition", "trim_unenroll_quant", "y")


@query("k_year_reached", sql.with_(sql.LABELLED, "SELECT id, trim_quant, year_order FROM labelled"))
def reached(spark, sf_dir):
    return labelled(spark, sf_dir).select("id", "trim_quant", "year_order")


@query("k_year_dropout", sql.with_(sql.LABELLED, "SELECT id, y, trim_quant, year_desert FROM labelled"))
def dropout_year(spark, sf_dir):
    return labelled(spark, sf_dir).select("id", "y", "trim_quant", "year_desert")


@query(
    "k_targets",
    sql.with_(
        sql.LABELLED,
        """SELECT id, y_num, CASE WHEN y_num = 2 THEN 1 ELSE y_num END AS y_two,
             CAST(coalesce(year_desert = '1st year', false) AS INTEGER) AS y_m1,
             CAST(coalesce(year_desert = '2nd year', false) AS INTEGER) AS y_m2,
             CAST(coalesce(year_desert = '3rd year', false) AS INTEGER) AS y_m3,
             CAST(coalesce(year_desert IN ('4th year', '5th year +'), false) AS INTEGER) AS y_m4
           FROM (SELECT *, CASE y WHEN 'graduate' THEN 0 WHEN 'voluntary desertion' THEN 1
                   WHEN 'involuntary desertion' THEN 2 WHEN 'active' THEN 3 END AS y_num FROM labelled)""",
    ),
)
def targets(spark, sf_dir):
    out = with_targets(labelled(spark, sf_dir))
    return out.select("id", "y_num", two_way(F.col("y_num")).alias("y_two"), "y_m1", "y_m2", "y_m3", "y_m4")


MART = sql.TERMS + ", " + sql.REGISTRY + ", " + sql.ENROLMENT.replace(sql.ORD + ", ", "") + """,
courses AS (SELECT id, year, trim, count(*) AS course_quant FROM enrolment GROUP BY 1, 2, 3),
kept AS (
  SELECT t.*, c.course_quant, dense_rank() OVER w AS trim_order, t - lag(t) OVER w - 1 AS gap,
    CASE WHEN row_number() OVER w = 1 THEN NULL WHEN program_n = lag(program_n) OVER w THEN 0
         WHEN program_n IS NOT NULL THEN 1 END AS change
  FROM terms t LEFT JOIN courses c ON t.id = c.id AND t.year = c.year AND t.trim = c.trim
  WHERE t.termid <> '2001_3' WINDOW w AS (PARTITION BY t.id ORDER BY t)),
ent AS (
  SELECT id, CAST(max(trim_order) AS INTEGER) AS trim_quant, CAST(coalesce(sum(gap), 0) AS BIGINT) AS prev_trims_out_sum,
    CAST(coalesce(sum(change), 0) AS BIGINT) AS program_change_quant, arg_max(termid, t) AS last_termid,
    2001 * 4 + 2 - max(t) AS trim_unenroll_quant,
    arg_max(acad_condition, t) FILTER (WHERE acad_condition IS NOT NULL) AS cond,
    arg_max('AREA ' || substr(program_n, 1, 1), t) FILTER (WHERE program_n IS NOT NULL) AS last_area_name
  FROM kept GROUP BY id),
people AS (
  SELECT r.*, b.paa_verb, b.paa_verb_2, b.m1, b.m2, b.id IS NOT NULL AS tested FROM registry r LEFT JOIN (
    SELECT id, CASE WHEN v > 800 THEN NULL ELSE v END AS paa_verb, v2 AS paa_verb_2,
      list_avg(list_filter([CASE WHEN v > 800 THEN NULL ELSE v END, a, nullif(b, 0)], lambda x: x IS NOT NULL)) AS m1,
      list_avg(list_filter([v2, a2, b2], lambda x: x IS NOT NULL)) AS m2
    FROM (SELECT id, CAST(balance_cents % 900 AS DOUBLE) AS v, CAST((balance_cents + id * 3) % 800 AS DOUBLE) AS a,
        CAST((balance_cents + id * 5) % 800 AS DOUBLE) AS b,
        CASE WHEN id % 2 = 0 THEN CAST((balance_cents + id * 7) % 800 AS DOUBLE) END AS v2,
        CAST((balance_cents + id * 11) % 800 AS DOUBLE) AS a2, CAST((balance_cents + id * 13) % 800 AS DOUBLE) AS b2
      FROM registry WHERE id % 5 <> 0)) b ON r.id = b.id
  WHERE r.id % 10 <> 0 AND r.id % 11 <> 0 AND r.year_in >= 1996)"""


@query(
    "k_entity_mart",
    sql.with_(
        MART,
        """SELECT p.id, trim_quant, prev_trims_out_sum, program_change_quant, last_termid, last_area_name,
             CASE WHEN tested THEN 'both' ELSE 'left_only' END AS admission_match,
             CASE WHEN coalesce(m2 > m1, false) THEN paa_verb_2 ELSE paa_verb END AS paa_verb_fin,
             CASE WHEN p.id % 4 = 0 THEN NULL ELSE area_in_name END AS nationality,
             CASE WHEN grad_date IS NOT NULL THEN 'graduate' WHEN last_termid = '2001_2' THEN 'active'
               WHEN cond LIKE '%SEPARADO%' THEN 'involuntary desertion'
               WHEN cond LIKE '%SUSPEN%' AND trim_unenroll_quant >= 4 THEN 'voluntary desertion'
               WHEN cond LIKE '%SUSPEN%' AND trim_unenroll_quant < 4 THEN 'suspended'
               WHEN trim_unenroll_quant >= 2 AND (cond IS NULL OR cond NOT LIKE '%SUSPEN%') THEN 'voluntary desertion' END AS y
           FROM people p LEFT JOIN ent ON p.id = ent.id""",
    ),
)
def entity_mart(spark, sf_dir):
    entities, _ = build_mart(
        sheets(spark, sf_dir), (2001, 2), ["2001_2"], first_year=1996, dropped_term="2001_3"
    )
    return entities.select(
        "id", "trim_quant", "prev_trims_out_sum", "program_change_quant", "last_termid", "last_area_name",
        "admission_match", "paa_verb_fin", "nationality", "y",
    )


@query(
    "s_checks",
    sql.with_(
        sql.LABELLED + ", " + sql.GRADED.replace(sql.ORD + ", ", ""),
        """SELECT 'unique_key' AS "check", count(*) - count(DISTINCT id) AS failures FROM labelled
           UNION ALL SELECT 'frequency_complete', count(*) - count(y) - count(*) FILTER (WHERE y IS NULL) FROM labelled
           UNION ALL SELECT 'no_suspended', count(*) FILTER (WHERE y = 'suspended') FROM labelled
           UNION ALL SELECT 'out_one_term', count(*) FILTER (WHERE y IS NULL AND trim_unenroll_quant <> 1) FROM labelled
           UNION ALL SELECT 'same_keys', count(*) FROM (SELECT id FROM registry EXCEPT SELECT id FROM panel)
           UNION ALL SELECT 'no_status_without_grade', count(*) FILTER (WHERE grade IS NULL AND grade_status IS NOT NULL) FROM graded
           UNION ALL SELECT 'terms_with_enrolments', count(*) FROM (SELECT id, year, trim FROM panel EXCEPT SELECT id, year, trim FROM graded)""",
    ),
)
def consistency_checks(spark, sf_dir):
    """The checks the jobs make of their own results, with the number of failures each."""
    people = labelled(spark, sf_dir)
    terms = standins.terms(spark, sf_dir)
    graded = with_grade_status(standins.enrolment(spark, sf_dir))
    status = sum((F.col(s) for s in STATUSES), F.lit(0))
    results = [
        checks.unique_key(people, ["id"]),
        checks.frequency_complete(people, "y"),
        checks.no_rows(people, F.col("y") == "suspended", "no_suspended"),
        checks.no_rows(people, F.col("y").isNull() & (F.col("trim_unenroll_quant") != 1), "out_one_term"),
        checks.same_keys(standins.registry(spark, sf_dir), terms, ["id"]),
        checks.no_rows(graded, (F.col("grade_nan") == 1) & (status != 0), "no_status_without_grade"),
        checks.same_keys(terms, graded, ["id", "year", "trim"], "terms_with_enrolments"),
    ]
    return union_tables(*results)
