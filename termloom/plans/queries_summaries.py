"""Registered queries: aggregates and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.functions.conditions import row_max, row_mean, row_sum
from termloom.functions.dates import date_part
from termloom.operators import summaries
from termloom.operators.grading import STATUSES, term_rollup, with_grade_status
from termloom.operators.panel import at_risk, ever_paused, reenrol_probability, survivors
from termloom.operators.reports import outcome_counts, outcome_rates, share_of
from termloom.operators.vocabulary import text_tokens, vocabulary
from termloom.plans import sql
from termloom.plans.registry import query
from termloom.plans.standin_mart import labelled
from termloom.sources import standins
from termloom.sources.standins import table


def rounded(df, digits: int, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(
    "e_programme_summary",
    """SELECT p_brand AS program, p_type AS version, min(p_size) AS trim_min,
              arg_min(p_name, p_partkey) AS description, max(p_size) AS trim_max,
              CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS BIGINT) AS credits
       FROM part GROUP BY 1, 2""",
)
def programme_summary(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("program"), F.col("p_type").alias("version")).agg(
        F.min("p_size").alias("trim_min"), F.min_by("p_name", "p_partkey").alias("description"),
        F.max("p_size").alias("trim_max"), F.sum(F.round(F.col("p_retailprice") * 100).cast("long")).alias("credits"),
    )


DESCRIBE = """count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
  CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS p_25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS p_50,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS p_75"""
PARTS = ["mean", "std", "p_25", "p_50", "p_75"]


@query(
    "e_describe_by",
    f"SELECT l_returnflag AS flag, {DESCRIBE.format(c='l_extendedprice')} FROM lineitem GROUP BY 1",
)
def describe_by(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    return rounded(summaries.describe_by(line, ["flag"], "l_extendedprice"), 4, *PARTS)


@query(
    "e_min_max_flag",
    """SELECT p_brand AS program, p_type AS version, CAST(min(p_size) <> max(p_size) AS INTEGER) AS min_max
       FROM part GROUP BY 1, 2""",
)
def min_max_flag(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("program"), F.col("p_type").alias("version")).agg(
        (F.min("p_size") != F.max("p_size")).cast("int").alias("min_max")
    )


GRADE_SUMS = ",\n".join(
    f"CAST(count(*) FILTER (WHERE grade = '{g}') AS BIGINT) AS grades_{g.lower().replace('+', '_plus')}"
    for g in ["A", "B", "B+", "C", "C+", "D", "F", "CO", "OTH", "R"]
)
STATUS_SUMS = ",\n".join(
    f"""count(*) FILTER (WHERE grade_status = '{s}') AS {s}_quant,
        coalesce(sum(credits) FILTER (WHERE grade_status = '{s}'), 0) AS credits_{s}"""
    for s in STATUSES
)


@query(
    "e_term_rollup",
    sql.with_(
        sql.GRADED,
        f"""SELECT id, year, trim, count(*) AS course_quant, sum(credits) AS credits_total, {STATUS_SUMS},
              count(*) FILTER (WHERE grade IS NULL) AS grade_nan_quant,
              coalesce(sum(credits) FILTER (WHERE grade IS NULL), 0) AS credits_nan, {GRADE_SUMS}
            FROM graded GROUP BY id, year, trim""",
    ),
)
def rollup_terms(spark, sf_dir):
    return term_rollup(with_grade_status(standins.enrolment(spark, sf_dir)))


@query(
    "e_term_lists",
    sql.with_(
        sql.GRADED,
        """, cells AS (
             SELECT id, year, trim, 1 AS l, CAST(clave AS VARCHAR) AS item FROM graded
             UNION ALL SELECT id, year, trim, 2, CAST(teachid AS VARCHAR) FROM graded
             UNION ALL SELECT id, year, trim, 3, grade FROM graded
             UNION ALL SELECT id, year, trim, 4, grade_status FROM graded),
           counts AS (SELECT id, year, trim, l, item, item || CASE WHEN count(*) > 1 THEN '*' || count(*) ELSE '' END AS s
             FROM cells WHERE item IS NOT NULL GROUP BY id, year, trim, l, item)
           SELECT c.id, c.year, c.trim, size,
             coalesce(string_agg(s, ' ' ORDER BY item) FILTER (WHERE l = 1), '') AS course_list,
             coalesce(string_agg(s, ' ' ORDER BY item) FILTER (WHERE l = 2), '') AS teachid_list,
             coalesce(string_agg(s, ' ' ORDER BY item) FILTER (WHERE l = 3), '') AS grades_list,
             coalesce(string_agg(s, ' ' ORDER BY item) FILTER (WHERE l = 4), '') AS grades_status_list
           FROM counts c JOIN (SELECT id, year, trim, count(*) AS size FROM graded GROUP BY 1, 2, 3) g
             ON c.id = g.id AND c.year = g.year AND c.trim = g.trim GROUP BY c.id, c.year, c.trim, size""",
    ),
)
def term_lists(spark, sf_dir):
    graded = with_grade_status(standins.enrolment(spark, sf_dir))
    columns = {
        "course_list": "clave", "teachid_list": "teachid", "grades_list": "grade", "grades_status_list": "grade_status",
    }
    lists = summaries.counted_lists(graded, ["id", "year", "trim"], columns)
    return lists.withColumns({c: summaries.list_text(c) for c in columns})


@query(
    "e_term_dates",
    sql.with_(
        sql.ENROLMENT,
        """SELECT id, year, trim, string_agg(d, ' ' ORDER BY d) AS select_dates, count(*) AS n_dates
           FROM (SELECT DISTINCT id, year, trim, CAST(CAST(select_date_time AS DATE) AS VARCHAR) AS d FROM enrolment)
           GROUP BY id, year, trim""",
    ),
)
def term_dates(spark, sf_dir):
    days = standins.enrolment(spark, sf_dir).select(
        "id", "year", "trim", date_part(F.col("select_date_time")).alias("d")
    ).distinct()
    # one entity, term and day per row: the set is bounded by the calendar
    return days.groupBy("id", "year", "trim").agg(
        F.array_join(F.sort_array(F.collect_list("d")).cast("array<string>"), " ").alias("select_dates"),
        F.count(F.lit(1)).alias("n_dates"),
    )


OUTCOMES = """count(*) AS n, count(*) FILTER (WHERE y = 'active') AS y_active,
  count(*) FILTER (WHERE y = 'graduate') AS y_graduate,
  count(*) FILTER (WHERE y = 'involuntary desertion') AS y_inv_desert,
  count(*) FILTER (WHERE y = 'voluntary desertion') AS y_vol_desert,
  count(*) FILTER (WHERE y IN ('active', 'graduate', 'involuntary desertion', 'voluntary desertion')) AS y_sum,
  count(*) FILTER (WHERE y IS NULL OR y = 'suspended') AS dif"""


@query(
    "e_outcome_by_programme",
    sql.with_(
        sql.LABELLED,
        f"""SELECT program_in, {OUTCOMES}, string_agg(DISTINCT admin_type, '|' ORDER BY admin_type) AS names
            FROM labelled WHERE program_in IS NOT NULL GROUP BY program_in""",
    ),
)
def outcome_by_programme(spark, sf_dir):
    return outcome_counts(labelled(spark, sf_dir), "program_in", name_of="admin_type")


@query(
    "e_rates",
    sql.with_(
        sql.LABELLED,
        f"""SELECT *, CASE WHEN dif = 0 THEN 0 ELSE 1 END AS "check", round(y_graduate / n, 6) AS completion_rate,
              round(y_vol_desert / n * 100, 6) AS dropout_rate
            FROM (SELECT program_in, {OUTCOMES} FROM labelled WHERE program_in IS NOT NULL GROUP BY program_in)""",
    ),
)
def rates(spark, sf_dir):
    return rounded(outcome_rates(outcome_counts(labelled(spark, sf_dir), "program_in")), 6, "completion_rate", "dropout_rate")


@query(
    "e_outcome_by_area",
    sql.with_(
        sql.LABELLED,
        f"""SELECT area_in, {OUTCOMES}, string_agg(DISTINCT area_in_name, '|' ORDER BY area_in_name) AS names
            FROM labelled WHERE area_in IS NOT NULL GROUP BY area_in""",
    ),
)
def outcome_by_area(spark, sf_dir):
    return outcome_counts(labelled(spark, sf_dir), "area_in", name_of="area_in_name")


@query(
    "e_outcome_by_cohort",
    sql.with_(sql.LABELLED, f"SELECT year_in, {OUTCOMES} FROM labelled GROUP BY year_in"),
)
def outcome_by_cohort(spark, sf_dir):
    return outcome_counts(labelled(spark, sf_dir), "year_in")


@query(
    "e_frequency",
    sql.with_(
        sql.TERMS,
        "SELECT acad_condition, count(*) AS n FROM terms WHERE acad_condition IS NOT NULL GROUP BY 1 ORDER BY n DESC",
    ),
)
def frequency(spark, sf_dir):
    return summaries.value_counts(standins.terms(spark, sf_dir), "acad_condition")


@query(
    "e_relative_frequency",
    sql.with_(
        sql.LABELLED,
        """SELECT year_desert, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct
           FROM labelled WHERE year_desert IS NOT NULL GROUP BY 1""",
    ),
)
def relative_frequency(spark, sf_dir):
    return rounded(summaries.value_shares(labelled(spark, sf_dir), "year_desert"), 6, "pct")


LABELS = ["active", "graduate", "involuntary desertion", "voluntary desertion"]


@query(
    "e_crosstab",
    sql.with_(
        sql.LABELLED,
        "SELECT year_order, "
        + ", ".join(f"count(*) FILTER (WHERE y = '{v}') AS \"{v}\"" for v in LABELS)
        + " FROM labelled WHERE y IS NOT NULL AND year_order IS NOT NULL GROUP BY 1",
    ),
)
def crosstab(spark, sf_dir):
    return summaries.contingency(labelled(spark, sf_dir), "year_order", "y", LABELS)


@query(
    "e_crosstab_rate",
    sql.with_(
        sql.LABELLED,
        """SELECT year_order, count(*) FILTER (WHERE y = 'voluntary desertion') AS vol,
             round(count(*) FILTER (WHERE y = 'voluntary desertion') * 100.0
               / count(*) FILTER (WHERE y IN ('active', 'graduate', 'involuntary desertion', 'voluntary desertion')), 6)
               AS dropout_rate
           FROM labelled WHERE y IS NOT NULL AND year_order IS NOT NULL GROUP BY 1""",
    ),
)
def crosstab_rate(spark, sf_dir):
    tab = summaries.contingency(labelled(spark, sf_dir), "year_order", "y", LABELS)
    return tab.select(
        "year_order", F.col("`voluntary desertion`").alias("vol"),
        F.round(share_of("voluntary desertion", LABELS), 6).alias("dropout_rate"),
    )


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "e_summary",
    "\nUNION ALL ".join(f"SELECT '{c}' AS \"column\", {DESCRIBE.format(c=c)} FROM lineitem" for c in MEASURES),
)
def whole_summary(spark, sf_dir):
    return rounded(summaries.describe(table(spark, sf_dir, "lineitem"), MEASURES), 4, *PARTS)


@query(
    "e_null_counts",
    sql.with_(
        sql.LABELLED,
        "SELECT "
        + ", ".join(
            f"count(*) FILTER (WHERE {c} IS NULL) AS {c}"
            for c in ["grad_date", "sex", "trim_quant", "last_acad_condition", "last_program_n", "y", "year_desert"]
        )
        + " FROM labelled",
    ),
)
def count_nulls(spark, sf_dir):
    return summaries.null_counts(
        labelled(spark, sf_dir),
        ["grad_date", "sex", "trim_quant", "last_acad_condition", "last_program_n", "y", "year_desert"],
    )


@query(
    "e_uniqueness",
    """SELECT 'order' AS key, count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys,
              count(*) = count(DISTINCT o_orderkey) AS is_unique FROM orders
       UNION ALL SELECT 'customer', count(*), count(DISTINCT o_custkey), count(*) = count(DISTINCT o_custkey) FROM orders""",
)
def key_uniqueness(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    per_order = summaries.uniqueness(o, ["o_orderkey"]).withColumn("key", F.lit("order"))
    return per_order.unionByName(summaries.uniqueness(o, ["o_custkey"]).withColumn("key", F.lit("customer")))


@query(
    "e_rowwise",
    """SELECT l_orderkey, l_linenumber, l_partkey, coalesce(q, 0) + coalesce(s, 0) + coalesce(x, 0) AS total,
         CASE WHEN q IS NULL AND s IS NULL AND x IS NULL THEN NULL ELSE
           round((coalesce(q, 0) + coalesce(s, 0) + coalesce(x, 0))
           / (CAST(q IS NOT NULL AS INTEGER) + CAST(s IS NOT NULL AS INTEGER) + CAST(x IS NOT NULL AS INTEGER)), 6) END AS mean,
         greatest(q, s, x) AS most
       FROM (SELECT l_orderkey, l_linenumber, l_partkey, nullif(CAST(l_quantity AS INTEGER) % 5, 0) AS q,
               nullif(CAST(l_suppkey AS INTEGER) % 3, 0) AS s, nullif(l_linenumber % 2, 0) AS x FROM lineitem)""",
)
def rowwise(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.nullif(F.col("l_quantity").cast("int") % 5, F.lit(0)).alias("q"),
        F.nullif(F.col("l_suppkey").cast("int") % 3, F.lit(0)).alias("s"),
        F.nullif(F.col("l_linenumber") % 2, F.lit(0)).alias("x"),
    )
    parts = [F.col(c) for c in ("q", "s", "x")]
    return line.select(
        "l_orderkey", "l_linenumber", "l_partkey", row_sum(parts).alias("total"),
        F.round(row_mean(parts), 6).alias("mean"), row_max(parts).alias("most"),
    )


@query(
    "e_mode",
    """SELECT year, trim, d AS mode_date FROM (
         SELECT year, trim, d, row_number() OVER (PARTITION BY year, trim ORDER BY count(*) DESC, d) AS rn
         FROM (SELECT year(o_orderdate) AS year, quarter(o_orderdate) AS trim, CAST(o_orderdate AS DATE) AS d FROM orders)
         GROUP BY year, trim, d) WHERE rn = 1""",
)
def modes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.year("o_orderdate").cast("long").alias("year"), F.quarter("o_orderdate").cast("long").alias("trim"),
        F.to_date("o_orderdate").alias("d"),
    )
    return summaries.group_mode(o, ["year", "trim"], "d", "mode_date")


@query(
    "e_vocabulary",
    r"""SELECT DISTINCT token FROM (SELECT unnest(regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\s+')) AS token
        FROM documents) WHERE token <> ''""",
)
def distinct_tokens(spark, sf_dir):
    return vocabulary(text_tokens(table(spark, sf_dir, "documents"), "doc_id", "text"))


@query(
    "e_gap_frequency",
    sql.with_(
        sql.PANEL,
        "SELECT prev_trims_out, count(*) AS n FROM panel WHERE prev_trims_out IS NOT NULL GROUP BY 1",
    ),
)
def gap_frequency(spark, sf_dir):
    return summaries.value_counts(standins.panel(spark, sf_dir), "prev_trims_out")


@query(
    "e_ever_paused",
    sql.with_(
        sql.SUMMARY,
        "SELECT count(*) AS n_paused FROM summary WHERE prev_trims_out_sum > 0 OR trim_unenroll_quant > 0",
    ),
)
def count_paused(spark, sf_dir):
    return ever_paused(standins.summary(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n_paused"))


@query(
    "e_reenroll_prob",
    sql.with_(
        sql.SUMMARY,
        """SELECT g.trim_out_quant, count(DISTINCT p.id) AS n_entities,
             round(count(DISTINCT p.id) * 100.0
               / (SELECT count(*) FROM summary WHERE prev_trims_out_sum > 0 OR trim_unenroll_quant > 0), 6) AS prob_reenroll
           FROM (SELECT CAST(unnest(range(1, (SELECT max(trim_unenroll_quant) FROM summary) + 1)) AS INTEGER) AS trim_out_quant) g
           LEFT JOIN panel p ON p.prev_trims_out = g.trim_out_quant GROUP BY 1""",
    ),
)
def reenrol(spark, sf_dir):
    prob = reenrol_probability(standins.panel(spark, sf_dir), standins.summary(spark, sf_dir))
    return rounded(prob, 6, "prob_reenroll")


BOX = """SELECT '{c}' AS "column", round(a, 4) AS p_25, round(b, 4) AS p_50, round(d, 4) AS p_75,
  round(a - (d - a) * 1.5, 4) AS low_fence, round(d + (d - a) * 1.5, 4) AS high_fence,
  (SELECT count(*) FROM lineitem WHERE {c} < a - (d - a) * 1.5 OR {c} > d + (d - a) * 1.5) AS n_outside
  FROM (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.5) AS b, quantile_cont({c}, 0.75) AS d FROM lineitem)"""


@query("e_box_summary", "\nUNION ALL ".join(BOX.format(c=c) for c in ("l_extendedprice", "l_quantity")))
def box(spark, sf_dir):
    out = summaries.box_summary(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity"])
    return rounded(out, 4, "p_25", "p_50", "p_75", "low_fence", "high_fence")


@query(
    "e_histogram",
    """SELECT bin, round(lo + (bin - 1) * w, 4) AS left_edge, count(*) AS n FROM (
         SELECT CAST(least(floor((o_totalprice - lo) / w) + 1, 20) AS INTEGER) AS bin, lo, w
         FROM orders, (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 20 AS w FROM orders))
       GROUP BY bin, lo, w""",
)
def price_histogram(spark, sf_dir):
    return rounded(summaries.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 20), 4, "left_edge")


@query(
    "f_survivors",
    sql.with_(
        sql.SUMMARY,
        """SELECT trim_quant, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY trim_quant DESC) AS BIGINT) AS n_at_least
           FROM summary GROUP BY 1""",
    ),
)
def surviving(spark, sf_dir):
    return survivors(standins.summary(spark, sf_dir))


@query(
    "f_at_risk",
    sql.with_(
        sql.LABELLED,
        """SELECT y, count(*) FILTER (WHERE trim_quant >= 0) AS n_ge_0, count(*) FILTER (WHERE trim_quant >= 4) AS n_ge_4,
             count(*) FILTER (WHERE trim_quant >= 8) AS n_ge_8, count(*) FILTER (WHERE trim_quant >= 12) AS n_ge_12
           FROM labelled WHERE y IS NOT NULL GROUP BY y""",
    ),
)
def risk_population(spark, sf_dir):
    return at_risk(labelled(spark, sf_dir), "y")


@query(
    "g_sort",
    sql.with_(
        sql.LABELLED,
        """SELECT program_in, count(*) AS n FROM labelled WHERE program_in IS NOT NULL GROUP BY 1
           HAVING count(*) >= 50 ORDER BY n DESC""",
    ),
)
def sorted_counts(spark, sf_dir):
    counts = summaries.value_counts(labelled(spark, sf_dir), "program_in")
    return counts.filter(F.col("n") >= 50).orderBy(F.desc("n"), "program_in")


@query("g_first_rows", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 10000")
def first_rows(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey").limit(10000)


@query(
    "g_top",
    "SELECT p_partkey AS feature, p_retailprice AS importance FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20",
)
def top_rows(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("feature"), F.col("p_retailprice").alias("importance")).orderBy(
        F.desc("importance"), "feature"
    ).limit(20)


GAPPY = """gappy AS (SELECT event_type, CASE WHEN event_id % 4 <> 0 THEN "value" END AS v FROM events)"""


def with_nan(spark, sf_dir):
    """Events whose every fourth value is NaN."""
    nan = F.lit(float("nan"))
    return table(spark, sf_dir, "events").select(
        "event_id", "event_type", F.when(F.col("event_id") % 4 == 0, nan).otherwise(F.col("value")).alias("v")
    )


@query(
    "e_describe_nan",
    f"""WITH {GAPPY} SELECT event_type, count(v) AS "count", round(avg(v), 8) AS mean, round(stddev_samp(v), 8) AS std,
          min(v) AS min, max(v) AS max, round(quantile_cont(v, 0.25), 8) AS p_25, round(quantile_cont(v, 0.5), 8) AS p_50,
          round(quantile_cont(v, 0.75), 8) AS p_75 FROM gappy GROUP BY event_type""",
)
def describe_nan(spark, sf_dir):
    out = summaries.describe_by(with_nan(spark, sf_dir), ["event_type"], "v")
    return out.withColumns({c: F.round(c, 8) for c in ("mean", "std", "p_25", "p_50", "p_75")})


@query("e_null_counts_nan", f"WITH {GAPPY} SELECT count(*) - count(event_type) AS event_type, count(*) - count(v) AS v FROM gappy")
def null_counts_nan(spark, sf_dir):
    return summaries.null_counts(with_nan(spark, sf_dir), ["event_type", "v"])


@query(
    "e_histogram_nan",
    f"""WITH {GAPPY}, r AS (SELECT min(v) AS lo, (max(v) - min(v)) / 20 AS w FROM gappy)
        SELECT CAST(least(floor((v - lo) / w) + 1, 20) AS INTEGER) AS bin, count(*) AS n
        FROM gappy, r WHERE v IS NOT NULL GROUP BY 1""",
)
def histogram_nan(spark, sf_dir):
    return summaries.histogram(with_nan(spark, sf_dir), "v", 20).select("bin", "n")


@query(
    "e_density",
    """WITH v AS (SELECT CAST(o_totalprice AS DOUBLE) / 1000 AS v FROM orders),
         g AS (SELECT count(*) AS n, stddev_samp(v) * count(*) ** -0.2 AS h, min(v) AS lo, max(v) AS hi FROM v),
         d AS (SELECT n, h, lo - 3 * h AS start, (hi - lo + 6 * h) / 199 AS step FROM g),
         p AS (SELECT (v - start) / step AS place, least(floor((v - start) / step), 198) AS i FROM v, d),
         b AS (SELECT i, sum(w) AS w FROM (SELECT i, 1 - (place - i) AS w FROM p UNION ALL SELECT i + 1, place - i FROM p) GROUP BY i)
       SELECT start + j * step AS x, sum(w * exp(-0.5 * ((j - i) * step / h) ** 2)) / (max(n) * max(h) * sqrt(2 * pi())) AS density
       FROM b, d, (SELECT unnest(range(200)) AS j) GROUP BY j, start, step""",
)
def density_curve(spark, sf_dir):
    """The curve a density chart shows, of order prices in thousands."""
    return summaries.density(table(spark, sf_dir, "orders").select((F.col("o_totalprice").cast("double") / 1000).alias("v")), "v")
