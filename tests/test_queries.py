"""Every registered query with SQL against DuckDB; the others run and are not empty."""

import duckdb
import pytest

import __spark_entry__ as entry
from termloom.plans.queries_tables import NAMES
from tools.check_oracles import compare, rows_of

ORACLES = entry.oracle_sql()
REST = sorted(set(entry.queries()) - set(ORACLES))
LONG = {
    "l_cascade", "l_score_active", "l_feature_sets",  # covered by test_models on one run
    "l_tree_search", "l_forest_search", "l_search_fit", "l_bundle_manifest",  # by test_search and test_bundle
}


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for n in NAMES:
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{sf_dir}/{n}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, sf_dir, name):
    result = compare(spark, con, name, sf_dir)
    assert result.startswith("ok") and "TYPES" not in result, result


@pytest.mark.parametrize("name", [n for n in REST if n not in LONG])
def test_runs(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).count() > 0


def test_sql_belongs_to_queries():
    assert set(ORACLES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["trim_out_quant", "n_entities", "prob_reenroll"]


@pytest.mark.parametrize(
    "name", ["e_describe_by", "e_term_lists", "f_term_gaps", "l_label_encode", "k_mode_fill", "l_smote", "c_first_per_key"]
)
def test_result_does_not_depend_on_partitions(spark, sf_dir, name):
    results = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("3", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(rows_of(entry.queries()[name](spark, sf_dir).toArrow()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
