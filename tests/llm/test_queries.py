"""Registered queries of the subpackage against their SQL, and the pipeline."""

import collections

import duckdb
import pytest

import corpus_pipeline
from termloom.llm.queries import ORACLES, QUERIES
from termloom.plans.queries_tables import NAMES
from tools.check_oracles import compare


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for n in NAMES:
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{sf_dir}/{n}.parquet'")
    for n in ("documents", "benchmark", "labels", "conversations"):
        c.execute(f"CREATE OR REPLACE VIEW {n} AS SELECT * FROM '{sf_dir}/{n}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, sf_dir, name):
    result = compare(spark, con, name, sf_dir)
    assert result.startswith("ok") and "TYPES" not in result, result


def test_dealt_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, left = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == docs.columns
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        left[name] = {r.doc_id for r in kept.select("doc_id").collect()}
    base = {r.doc_id for r in QUERIES["op3_line_frequency"](spark, sf_dir).filter("kept").collect()}
    assert left["quality_rules"] == base
    assert left["near_duplicates"] < base and left["decontamination"] < left["near_duplicates"]
    assert left["personal_data"] == left["decontamination"]
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir).collect()
    assert {r.doc_id for r in packed} == left["personal_data"]
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert collections.Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in whole) == collections.Counter(
        (r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed
    )
