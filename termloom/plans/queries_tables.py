"""Registered queries: sources, sinks, projection, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.functions.columns import (
    dummies, flatten_names, indicator, names_containing, names_of_type, numeric_names, rename,
    rewrite_names, sort_columns, with_prefix,
)
from termloom.functions.conditions import contains_any, differs, not_among
from termloom.operators.rows import first_per_key, flag_repeated, split_population, union_tables
from termloom.plans import sql
from termloom.plans.registry import query
from termloom.plans.standin_mart import labelled
from termloom.session import scratch_path
from termloom.sources import standins
from termloom.sources.standins import table
from termloom.sources.tables import read_table, write_table

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@query(
    "a_read_tables",
    "\nUNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in NAMES),
)
def read_all(spark, sf_dir):
    return union_tables(
        *[
            table(spark, sf_dir, n).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
            for n in NAMES
        ]
    )


@query(
    "a_csv_round_trip",
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
)
def csv_round_trip(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    path = write_table(customer, scratch_path(spark, "customer"), "csv")
    return read_table(spark, path, "csv", customer.schema)


@query(
    "a_csv_cells",
    """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN '  ' || c_name || ' '
         WHEN 3 THEN c_name || chr(10) || '"a", b' WHEN 4 THEN '   ' ELSE c_name END AS cell FROM customer""",
)
def csv_cells(spark, sf_dir):
    """Empty texts, nulls, blanks at the ends, line breaks and quotes survive a CSV file."""
    name, kind = F.col("c_name"), F.col("c_custkey") % 6
    cell = (
        F.when(kind == 0, "").when(kind == 1, None).when(kind == 2, F.concat(F.lit("  "), name, F.lit(" ")))
        .when(kind == 3, F.concat(name, F.lit('\n"a", b'))).when(kind == 4, "   ").otherwise(name)
    )
    rows = table(spark, sf_dir, "customer").select("c_custkey", cell.alias("cell"))
    return read_table(spark, write_table(rows, scratch_path(spark, "cells"), "csv"), "csv", rows.schema)


@query(
    "a_parquet_round_trip",
    "SELECT o_orderkey, o_custkey, year(o_orderdate) AS year, o_orderstatus FROM orders",
)
def parquet_round_trip(spark, sf_dir):
    picked = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.year("o_orderdate").cast("long").alias("year"), "o_orderstatus"
    )
    path = write_table(picked, scratch_path(spark, "orders"), partition_by=["o_orderstatus"])
    return read_table(spark, path).select(picked.columns)


@query(
    "a_write_with_row_number",
    "SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS row_no, s_suppkey, s_nationkey FROM supplier",
)
def write_with_row_number(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    path = write_table(supplier, scratch_path(spark, "supplier"), row_number="row_no")
    return read_table(spark, path)


@query(
    "a_mapping_file",
    """SELECT c_custkey AS id, coalesce(n_name, 'unknown') AS place
       FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def mapping_file(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("raw"), F.col("n_name").alias("clean")
    )
    path = write_table(nation, scratch_path(spark, "mapping"), "csv")
    mapping = read_table(spark, path, "csv", nation.schema)
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("raw"))
    return customer.join(mapping, "raw", "left").select("id", F.coalesce("clean", F.lit("unknown")).alias("place"))


@query(
    "h_union_periods",
    """SELECT o_orderkey, o_custkey, 'early' AS period FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'
       UNION ALL
       SELECT o_orderkey, o_custkey, 'late' FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'""",
)
def union_periods(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    early = o.filter(F.col("o_orderdate") < cut).select("o_orderkey", "o_custkey", F.lit("early").alias("period"))
    late = o.filter(F.col("o_orderdate") >= cut).select(F.lit("late").alias("period"), "o_custkey", "o_orderkey")
    return union_tables(early, late)


@query(
    "b_rename_project",
    """SELECT c_custkey AS id, c_name AS student, c_mktsegment AS admin_type FROM customer""",
)
def rename_project(spark, sf_dir):
    renamed = rename(
        table(spark, sf_dir, "customer"),
        {"c_custkey": "id", "c_name": "student", "c_mktsegment": "admin_type"},
    )
    return renamed.drop("c_acctbal", "c_nationkey").select("id", "student", "admin_type")


@query(
    "b_bulk_names",
    """SELECT o_orderstatus AS status_key,
              CAST(max(o_totalprice) AS DOUBLE) AS price_max, CAST(min(o_totalprice) AS DOUBLE) AS price_min,
              count(*) AS rows_plus
       FROM orders GROUP BY 1""",
)
def bulk_names(spark, sf_dir):
    grouped = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("STATUS_KEY")).agg(
        F.struct(F.min("o_totalprice").alias("MIN"), F.max("o_totalprice").alias("MAX")).alias("PRICE"),
        F.count(F.lit(1)).alias("ROWS+"),
    )
    flat = rewrite_names(flatten_names(grouped), lower=True, replace={"+": "_plus"})
    return sort_columns(flat, first=["status_key"])


@query(
    "b_pick_by_name_and_type",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_discount AS num_l_discount,
              l_extendedprice AS num_l_extendedprice, l_quantity AS num_l_quantity, l_tax AS num_l_tax FROM lineitem""",
)
def pick_by_name(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    keys = names_containing(line, "key")
    texts = names_of_type(line, type(line.schema["l_returnflag"].dataType))
    measures = [c for c in numeric_names(line, exclude=[*keys, "l_linenumber"]) if c not in texts]
    return sort_columns(with_prefix(line.select(*keys, *measures), "num_", keep=keys), first=keys)


@query(
    "b_indicators",
    """SELECT o_orderkey, CAST(coalesce(o_orderstatus = 'F', false) AS INTEGER) AS st_F,
              CAST(coalesce(o_orderstatus = 'O', false) AS INTEGER) AS st_O,
              CAST(coalesce(o_orderstatus = 'P', false) AS INTEGER) AS st_P,
              CAST(o_totalprice > 300000 AS INTEGER) AS is_large,
              CASE WHEN o_totalprice > 300000 THEN o_totalprice ELSE 0 END AS large_price
       FROM orders""",
)
def indicators(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    flagged = o.withColumns(
        dummies("o_orderstatus", ["F", "O", "P"], "st_") | {"is_large": indicator(F.col("o_totalprice") > 300000)}
    ).withColumn("large_price", F.col("is_large") * F.col("o_totalprice"))
    return flagged.select("o_orderkey", "st_F", "st_O", "st_P", "is_large", "large_price")


@query(
    "b_casts",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(trunc(l_extendedprice) AS INTEGER) AS price_int,
              CAST(l_suppkey AS VARCHAR) AS supp_text, CAST(l_linenumber AS SMALLINT) AS line_small
       FROM lineitem""",
)
def casts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").cast("int").alias("price_int"),
        F.col("l_suppkey").cast("string").alias("supp_text"), F.col("l_linenumber").cast("short").alias("line_small"),
    )


@query(
    "c_filters",
    """SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
       WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 AND o_totalprice < 400000
         AND (o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_custkey > 500)""",
)
def filters(spark, sf_dir):
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").filter(
        (F.col("o_orderstatus") == "F") & (price >= 100000) & (price < 400000)
        & (F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") | (F.col("o_custkey") > 500))
    ).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query(
    "c_differs_keep_nulls",
    sql.with_(
        sql.TERMS,
        """SELECT id, termid, acad_condition FROM terms
           WHERE acad_condition IS DISTINCT FROM 'NORMAL'""",
    ),
)
def differs_keep_nulls(spark, sf_dir):
    return standins.terms(spark, sf_dir).filter(differs(F.col("acad_condition"), "NORMAL")).select(
        "id", "termid", "acad_condition"
    )


@query(
    "c_not_among_keep_nulls",
    sql.with_(
        sql.TERMS,
        """SELECT id, termid, program_n FROM terms
           WHERE program_n IS NULL OR program_n NOT IN ('1-URGENT', '5-LOW')""",
    ),
)
def not_among_keep_nulls(spark, sf_dir):
    return standins.terms(spark, sf_dir).filter(not_among(F.col("program_n"), ["1-URGENT", "5-LOW"])).select(
        "id", "termid", "program_n"
    )


@query(
    "c_null_tests",
    sql.with_(
        sql.TERMS,
        """SELECT id, termid, program_n, acad_condition FROM terms
           WHERE program_n IS NOT NULL AND acad_condition IS NOT NULL""",
    ),
)
def null_tests(spark, sf_dir):
    return standins.terms(spark, sf_dir).select("id", "termid", "program_n", "acad_condition").dropna(how="any")


@query(
    "c_drop_null_subset",
    sql.with_(sql.TERMS, "SELECT id, termid, program_n FROM terms WHERE acad_condition IS NOT NULL"),
)
def drop_null_subset(spark, sf_dir):
    return standins.terms(spark, sf_dir).dropna(subset=["acad_condition"]).select("id", "termid", "program_n")


@query(
    "c_first_per_key",
    """SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority FROM (
         SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
       WHERE rn = 1""",
)
def keep_first(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    return first_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "c_flag_repeated",
    sql.with_(
        sql.ORD,
        """SELECT o_orderkey, id, year, trim, count(*) OVER (PARTITION BY id, year, trim) > 1 AS dup_id FROM ord""",
    ),
)
def flag_dups(spark, sf_dir):
    o = standins.orders(spark, sf_dir).select("o_orderkey", "id", "year", "trim")
    return flag_repeated(o, ["id", "year", "trim"], ["o_orderkey"], "dup_id")


@query(
    "c_contains_any",
    sql.with_(
        sql.TERMS,
        """SELECT id, termid, coalesce(acad_condition LIKE '%SEPAR%' OR acad_condition LIKE '%SUSPEN%', false) AS hit
           FROM terms""",
    ),
)
def contains(spark, sf_dir):
    return standins.terms(spark, sf_dir).select(
        "id", "termid", contains_any(F.col("acad_condition"), ["SEPAR", "SUSPEN"]).alias("hit")
    )


@query(
    "c_split_population",
    sql.with_(
        sql.LABELLED,
        """SELECT CASE WHEN y IS NULL OR y = 'active' THEN 'open' ELSE 'final' END AS population,
                  coalesce(y, 'none') AS label, count(*) AS n FROM labelled GROUP BY 1, 2""",
    ),
)
def split_pop(spark, sf_dir):
    open_rows, final_rows = split_population(labelled(spark, sf_dir), "y", ["active"])
    both = union_tables(
        open_rows.select(F.lit("open").alias("population"), "y"),
        final_rows.select(F.lit("final").alias("population"), "y"),
    )
    return both.groupBy("population", F.coalesce("y", F.lit("none")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
