"""Registered queries: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.functions.text import joined_key
from termloom.operators.grading import term_rollup, with_grade_status
from termloom.operators.joins import (
    attach_checked, attach_marked, attach_on, keep_known, map_values,
)
from termloom.operators.panel import year_window
from termloom.operators.spread import left_join_spread
from termloom.plans import sql
from termloom.plans.registry import query
from termloom.sources import standins
from termloom.sources.standins import table


@query(
    "d_left_lookup",
    sql.with_(
        sql.ORD + ", " + sql.REGISTRY,
        "SELECT o_orderkey, ord.id, program_in, area_in_name FROM ord LEFT JOIN registry r ON ord.id = r.id",
    ),
)
def left_lookup(spark, sf_dir):
    o = standins.orders(spark, sf_dir).select("o_orderkey", "id")
    names = standins.registry(spark, sf_dir).select("id", "program_in", "area_in_name")
    return left_join_spread(o, names, ["id"], ["o_orderkey"])


@query(
    "d_left_suffix",
    """SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, s_suppkey AS sponsor,
              s_name AS name_in, s_nationkey AS nation_in
       FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""",
)
def left_suffix(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")
    )
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("sponsor"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")
    )
    return attach_on(c, s, {"id": "sponsor"})


@query(
    "d_left_indicator",
    """SELECT o_orderstatus AS status, CASE WHEN l.k IS NULL THEN 'left_only' ELSE 'both' END AS merge_status,
              count(*) AS n
       FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) l ON o_orderkey = l.k GROUP BY 1, 2""",
)
def left_indicator(spark, sf_dir):
    o = standins.orders(spark, sf_dir).select("o_orderkey", "status")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return attach_marked(o, lines, ["o_orderkey"], "merge_status").groupBy("status", "merge_status").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "d_consistency",
    sql.with_(
        sql.TERMS + ", " + sql.ENROLMENT.replace(sql.ORD + ", ", ""),
        """SELECT t.id, t.termid, e.course_quant, CASE WHEN e.id IS NULL THEN 1 ELSE 0 END AS new
           FROM terms t LEFT JOIN (SELECT id, year, trim, count(*) AS course_quant FROM enrolment
                                   GROUP BY 1, 2, 3) e
             ON t.id = e.id AND t.year = e.year AND t.trim = e.trim""",
    ),
)
def consistency(spark, sf_dir):
    key = joined_key(F.col("id"), F.col("year"), F.col("trim"))
    sums = term_rollup(with_grade_status(standins.enrolment(spark, sf_dir)))
    left = standins.terms(spark, sf_dir).select("id", "year", "trim", "termid").withColumn("id_termid", key)
    right = sums.select("id", "year", "trim", "course_quant").withColumn("id_termid", key)
    checked = attach_checked(left, right, "id_termid", ["id", "year", "trim"])
    return checked.select("id", "termid", "course_quant", "new")


@query(
    "d_semi",
    """SELECT c_custkey AS id, c_mktsegment AS admin_type FROM customer
       WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)""",
)
def semi(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("admin_type"))
    large = table(spark, sf_dir, "orders").filter(F.col("o_totalprice") > 450000).select(F.col("o_custkey").alias("id"))
    return keep_known(c, large, ["id"])


@query(
    "d_map_passthrough",
    sql.with_(
        sql.REGISTRY,
        """SELECT id, CASE WHEN area_in_name IN ('ASIA', 'EUROPE') THEN area_in_name ELSE program_in END AS place
           FROM registry""",
    ),
)
def map_passthrough(spark, sf_dir):
    places = (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .filter(F.col("r_name").isin("ASIA", "EUROPE")).select(F.col("n_name").alias("raw"), F.col("r_name").alias("clean"))
    )
    people = standins.registry(spark, sf_dir).select("id", F.col("program_in").alias("place"))
    return map_values(people, "place", places, "raw", "clean", ["id"])


@query(
    "d_attach_stage",
    sql.with_(
        sql.PANEL,
        """SELECT b.id, b.amount_2, a.amount_1 FROM
             (SELECT id, CAST(sum(amount_cents) AS BIGINT) AS amount_2 FROM quant
              WHERE trim_order BETWEEN 5 AND 8 AND trim_quant >= 8 GROUP BY id) b
             LEFT JOIN (SELECT id, CAST(sum(amount_cents) AS BIGINT) AS amount_1 FROM quant
              WHERE trim_order BETWEEN 1 AND 4 AND trim_quant >= 4 GROUP BY id) a ON a.id = b.id""",
    ),
)
def attach_stage(spark, sf_dir):
    p = standins.panel_with_quant(spark, sf_dir)
    first = year_window(p, 1).groupBy("id").agg(F.sum("amount_cents").alias("amount_1"))
    second = year_window(p, 2).groupBy("id").agg(F.sum("amount_cents").alias("amount_2"))
    return second.join(first, "id", "left")
