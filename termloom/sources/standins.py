"""The given tables read as registry, enrolments and terms.

Entity = customer, term = year and quarter of an order, enrolment = line item, course = part,
programme = order priority or nation, area = region. Every view reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.dates import term_label, term_number
from termloom.operators.panel import (
    change_flag, entity_summary, one_per_term, term_gaps, term_order, with_trim_quant,
)

# fixed values: the last term of the given orders and the terms that count as current
REFERENCE_TERM = (2001, 3)
CURRENT_TERMS = ["2001_2", "2001_3"]

# fixed values: letter for each remainder of (line number * 7 + part) by 12; 11 has no grade
GRADES = ["A", "B", "B+", "C", "C+", "D", "F", "RE", "CU", "NS", "I"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with entity and term."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey"), F.col("o_custkey").alias("id"),
        F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("trim"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("program"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.col("o_orderdate"),
    )


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per entity and term; attributes of the lowest order, amounts summed."""
    per_term = one_per_term(
        orders(spark, sf_dir), "id", "o_orderkey", ["o_orderkey", "program", "status"],
        {"amount_cents": F.sum("cents"), "n_orders": F.count(F.lit(1))},
    )
    status, program = F.col("status"), F.col("program")
    return per_term.withColumnRenamed("o_orderkey", "first_order").withColumns(
        {
            "t": term_number(F.col("year"), F.col("trim")),
            "termid": term_label(F.col("year"), F.col("trim")),
            "acad_condition": F.when((status == "F") & (program == "1-URGENT"), "SEPARADO")
            .when((status == "P") & (program == "5-LOW"), "SUSPENDIDO")
            .when(~((status == "P") & (program == "3-MEDIUM")), "NORMAL"),
            "program_n": F.when(~((program == "4-NOT SPECIFIED") & (F.col("first_order") % 5 == 0)), program),
        }
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms with order, gaps and programme changes; the windows share one shuffle by id."""
    ordered = term_gaps(term_order(terms(spark, sf_dir)))
    return change_flag(ordered, "program_n", "program_change")


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per entity that has terms."""
    return entity_summary(
        panel(spark, sf_dir), ["acad_condition", "program_n", "status"], REFERENCE_TERM
    )


def panel_with_quant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_trim_quant(panel(spark, sf_dir))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer; nation and region come through left joins on small tables whose
    size Spark checks itself."""
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    places = nation.join(
        region.select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("area_in_name")),
        "n_regionkey", "left",
    ).select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("program_in"),
        F.col("n_regionkey").alias("area_in"), "area_in_name",
    )
    cents = F.round(F.col("c_acctbal") * 100).cast("long")
    return customer.join(places, "c_nationkey", "left").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"),
        "program_in", "area_in", "area_in_name", F.col("c_mktsegment").alias("admin_type"),
        cents.alias("balance_cents"),
        F.when(cents >= 800000, F.lit("2001-06-30").cast("date")).alias("grad_date"),
        F.when(F.col("c_custkey") % 3 == 0, "m").when(F.col("c_custkey") % 3 == 1, "f").alias("sex"),
        (F.lit(15) + F.col("c_custkey") % 60).cast("int").alias("age_in"),
        (F.lit(1995) + F.col("c_custkey") % 4).cast("int").alias("year_in"),
        (F.lit(1) + F.col("c_custkey") % 4).cast("int").alias("trim_in"),
    )


def enrolment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the entity and term of their order.

    Both sides are shuffled by order; Spark splits an order that holds very many lines.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("clave"),
        F.col("l_suppkey").alias("teachid"), F.col("l_linenumber").alias("line"),
        F.col("l_quantity").alias("credits"), F.col("l_shipdate").alias("select_date_time"),
    )
    slot = ((F.col("line") * 7 + F.col("clave")) % 12 + 1).cast("int")
    letters = F.array(*[F.lit(g) for g in GRADES], F.lit(None).cast("string"))
    keys = orders(spark, sf_dir).select("o_orderkey", "id", "year", "trim")
    return lines.withColumn("grade_orig", F.try_element_at(letters, slot)).join(keys, "o_orderkey", "left")
