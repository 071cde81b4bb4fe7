"""Common table expressions for the reference SQL (plain SQL on the given tables)."""

ORD = """ord AS (
  SELECT o_orderkey, o_custkey AS id, CAST(year(o_orderdate) AS INTEGER) AS year,
         CAST(quarter(o_orderdate) AS INTEGER) AS trim, o_orderstatus AS status,
         o_orderpriority AS program, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderdate
  FROM orders)"""

TERMS = ORD + """, terms0 AS (
  SELECT id, year, trim, min(o_orderkey) AS first_order, arg_min(program, o_orderkey) AS program,
         arg_min(status, o_orderkey) AS status, CAST(sum(cents) AS BIGINT) AS amount_cents,
         count(*) AS n_orders
  FROM ord GROUP BY id, year, trim),
terms AS (
  SELECT *, year * 4 + trim AS t, year || '_' || trim AS termid,
         CASE WHEN status = 'F' AND program = '1-URGENT' THEN 'SEPARADO'
              WHEN status = 'P' AND program = '5-LOW' THEN 'SUSPENDIDO'
              WHEN status = 'P' AND program = '3-MEDIUM' THEN NULL ELSE 'NORMAL' END AS acad_condition,
         CASE WHEN program = '4-NOT SPECIFIED' AND first_order % 5 = 0 THEN NULL ELSE program END AS program_n
  FROM terms0)"""

PANEL = TERMS + """, panel AS (
  SELECT *, CAST(dense_rank() OVER w AS INTEGER) AS trim_order, t - lag(t) OVER w - 1 AS prev_trims_out,
         CASE WHEN row_number() OVER w = 1 THEN NULL WHEN program_n = lag(program_n) OVER w THEN 0
              WHEN program_n IS NOT NULL THEN 1 END AS program_change
  FROM terms WINDOW w AS (PARTITION BY id ORDER BY t)),
quant AS (SELECT *, max(trim_order) OVER (PARTITION BY id) AS trim_quant FROM panel)"""

SUMMARY = PANEL + """, summary AS (
  SELECT id, max(trim_order) AS trim_quant,
         CAST(coalesce(sum(prev_trims_out), 0) AS BIGINT) AS prev_trims_out_sum,
         CAST(coalesce(sum(program_change), 0) AS BIGINT) AS program_change_quant,
         arg_max(year, t) AS last_year_enroll, arg_max(trim, t) AS last_trim_enroll,
         arg_max(termid, t) AS last_termid, 2001 * 4 + 3 - max(t) AS trim_unenroll_quant,
         arg_max(acad_condition, t) FILTER (WHERE acad_condition IS NOT NULL) AS last_acad_condition,
         arg_max(program_n, t) FILTER (WHERE program_n IS NOT NULL) AS last_program_n,
         arg_max(status, t) FILTER (WHERE status IS NOT NULL) AS last_status
  FROM panel GROUP BY id)"""

REGISTRY = """registry AS (
  SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, n_name AS program_in,
         n_regionkey AS area_in, r_name AS area_in_name, c_mktsegment AS admin_type,
         CAST(round(c_acctbal * 100) AS BIGINT) AS balance_cents,
         CASE WHEN round(c_acctbal * 100) >= 800000 THEN DATE '2001-06-30' END AS grad_date,
         CASE WHEN c_custkey % 3 = 0 THEN 'm' WHEN c_custkey % 3 = 1 THEN 'f' END AS sex,
         CAST(15 + c_custkey % 60 AS INTEGER) AS age_in, CAST(1995 + c_custkey % 4 AS INTEGER) AS year_in,
         CAST(1 + c_custkey % 4 AS INTEGER) AS trim_in
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
       LEFT JOIN region ON n_regionkey = r_regionkey)"""

ENROLMENT = ORD + """, enrolment AS (
  SELECT o.id, o.year, o.trim, l_orderkey AS o_orderkey, l_partkey AS clave, l_suppkey AS teachid,
         l_linenumber AS line, l_quantity AS credits, l_shipdate AS select_date_time,
         ['A', 'B', 'B+', 'C', 'C+', 'D', 'F', 'RE', 'CU', 'NS', 'I', NULL]
           [CAST((l_linenumber * 7 + l_partkey) % 12 + 1 AS INTEGER)] AS grade_orig
  FROM lineitem LEFT JOIN ord o ON l_orderkey = o.o_orderkey)"""

GRADED = ENROLMENT + """, graded AS (
  SELECT *, CASE grade WHEN 'D' THEN 'failed' WHEN 'F' THEN 'failed' WHEN 'Q' THEN 'failed'
            WHEN 'R' THEN 'withdrawn' WHEN 'OTH' THEN 'other' ELSE CASE WHEN grade IN
            ('A', 'B', 'B+', 'C', 'C+', 'CO', 'S', 'P') THEN 'passed' END END AS grade_status
  FROM (SELECT *, CASE WHEN grade_orig IN ('R', 'RE', 'RO') THEN 'R' WHEN grade_orig IN ('CU', 'CO') THEN 'CO'
                       WHEN grade_orig IN ('I', 'NA', 'NS') THEN 'OTH' ELSE grade_orig END AS grade
        FROM enrolment))"""

LABELLED = SUMMARY + ", " + REGISTRY + """, labelled AS (
  SELECT *, CASE WHEN y IN ('involuntary desertion', 'voluntary desertion') THEN
              CASE WHEN trim_quant < 4 THEN '1st year' WHEN trim_quant < 8 THEN '2nd year'
                   WHEN trim_quant < 12 THEN '3rd year' WHEN trim_quant < 16 THEN '4th year'
                   WHEN trim_quant >= 16 THEN '5th year +' END END AS year_desert,
            CASE WHEN trim_quant <= 4 THEN '1st year' WHEN trim_quant <= 8 THEN '2nd year'
                 WHEN trim_quant <= 12 THEN '3rd year' WHEN trim_quant <= 16 THEN '4th year'
                 WHEN trim_quant > 16 THEN '5th year +' END AS year_order
  FROM (SELECT r.*, s.* EXCLUDE (id), CASE WHEN r.grad_date IS NULL THEN 0 ELSE 1 END AS grad,
          CASE WHEN r.grad_date IS NOT NULL THEN 'graduate'
               WHEN s.last_termid IN ('2001_2', '2001_3') THEN 'active'
               WHEN s.last_acad_condition LIKE '%SEPARADO%' OR s.last_acad_condition LIKE '%NO SATISF%'
                 THEN 'involuntary desertion'
               WHEN s.last_acad_condition LIKE '%SUSPEN%' AND s.trim_unenroll_quant >= 4 THEN 'voluntary desertion'
               WHEN s.last_acad_condition LIKE '%SUSPEN%' AND s.trim_unenroll_quant < 4 THEN 'suspended'
               WHEN (s.last_acad_condition IS NULL OR s.last_acad_condition NOT LIKE '%SUSPEN%')
                 AND s.trim_unenroll_quant >= 2 THEN 'voluntary desertion' END AS y
        FROM registry r LEFT JOIN summary s ON r.id = s.id))"""


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"
