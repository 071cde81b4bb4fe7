"""What the physical plans must and must not contain, with static broadcasts switched off so
that the joins are those of large tables."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from termloom.operators import summaries
from termloom.plans.registry import QUERIES
from termloom.session import checkpointed

FITTED = {n for n in entry.queries() if n.startswith("l_")} - {
    "l_append_prob", "l_confusion", "l_course_counts", "l_evaluate", "l_ordinal", "l_sex_binary", "l_label_encode",
}
PLAIN = sorted(set(QUERIES) - FITTED)  # relational queries: Python is allowed in some training-data operators


@pytest.fixture
def large_tables(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def plan_of(spark, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLAIN)
def test_no_cross_join_and_no_python(spark, sf_dir, large_tables, name):
    plan = plan_of(spark, sf_dir, name)
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert word not in plan


@pytest.mark.parametrize("name", PLAIN)
def test_window_partitions(spark, sf_dir, large_tables, name):
    """Windows without an entity key run only over one row per distinct value."""
    plan = plan_of(spark, sf_dir, name)
    if "SinglePartition" in plan:
        assert name in {
            "e_null_counts_nan", "e_histogram_nan",
            # global one-row aggregates, ordered limits and the survivor table
            "a_read_tables", "e_histogram", "e_box_summary", "e_null_counts", "e_uniqueness", "e_ever_paused",
            "e_reenroll_prob", "e_relative_frequency", "f_survivors", "g_first_rows", "g_best_trial", "l_evaluate",
            # the total of the key counts is one row
            "c_flag_repeated", "d_left_lookup", "d_map_passthrough", "e_term_lists", "i_year_lists",
            # the summary of frequent items and the measures of the grid
            "i_token_counts", "k_city_map", "e_density",
            "k_sponsor_check", "a_write_with_row_number", "k_mode_fill", "l_label_encode", "s_checks",
        }, name


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    df = entry.queries()["c_filters"](spark, sf_dir)
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "PushedFilters" in plan and "EqualTo(o_orderstatus,F)" in plan and "GreaterThanOrEqual(o_totalprice" in plan
    read = re.search(r"ReadSchema: struct<([^>]*)", plan).group(1)
    assert "o_orderdate" not in read
    rollup = plan_of(spark, sf_dir, "e_describe_by")
    given = [r for r in re.findall(r"ReadSchema: struct<([^>]*)", rollup) if r.startswith("l_")]
    assert given and all(r.count(":") == 2 for r in given)


def test_windows_share_one_shuffle(spark, sf_dir, large_tables):
    """Order, gaps and changes of a term: one shuffle for the terms, one by entity."""
    plan = plan_of(spark, sf_dir, "f_change_flag")
    assert plan.count("Exchange hashpartitioning") == 2


def test_quantiles_scan_twice_and_shuffle_no_values(spark, sf_dir, large_tables):
    """One scan for the sketches, one for the counts; only what brackets hold is shuffled by value."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_returnflag").alias("g"), F.col("l_extendedprice").cast("double").alias("_v")
    )
    brackets = summaries._brackets(rows, ["g"], [0.25, 0.5], False)
    plan = brackets._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "kll_sketch_agg_double" in plan
    assert re.findall(r"hashpartitioning\((\w+)#\d+, ", plan) == ["g"]
    counts = summaries._collapsed(rows, checkpointed(brackets), ["g"], 2)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"ReadSchema: struct<l_", plan)) == 1
    many = spark.range(60_000).select((F.col("id") % 3).alias("g"), (F.xxhash64("id") % 100_000).cast("double").alias("_v"))
    counts = summaries._collapsed(many, checkpointed(summaries._brackets(many, ["g"], [0.25, 0.5], False)), ["g"], 2)
    kept = counts.filter("_gap = 0").agg(F.sum("_n")).first()[0]
    assert kept < 0.1 * 60_000 and counts.filter("_gap = 1").count() <= 3 * 3  # the others are a few rows of a group


def test_lists_are_counted_before_they_are_collected(spark, sf_dir, large_tables):
    plan = plan_of(spark, sf_dir, "e_term_lists")
    assert re.search(r"Exchange hashpartitioning\(id#\d+L?, year#\d+, trim#\d+, list#\d+, item#\d+", plan)


def test_texts_are_split_once(spark, sf_dir, large_tables):
    """What is counted is stored; vocabulary and counts read it."""
    plan = plan_of(spark, sf_dir, "i_token_counts")
    assert "split(" not in plan and "Generate" not in plan
