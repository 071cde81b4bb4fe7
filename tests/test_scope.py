"""Scratch tables and their owners."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from termloom import session


@pytest.fixture
def folder(spark):
    """What the shared folder holds besides what it held before."""
    at = session.checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(at))
    return lambda: set(os.listdir(at)) - before


def test_folder_is_empty_after_a_query_is_consumed(spark, sf_dir, folder):
    with session.job_scope(spark):
        rows = entry.queries()["c_first_per_key"](spark, sf_dir).count() + entry.queries()["e_describe_by"](spark, sf_dir).count()
        assert rows and folder()
    assert not folder() and not session.Scope.holders


def test_folder_is_empty_after_an_error(spark, folder):
    with pytest.raises(ZeroDivisionError), session.job_scope(spark):
        session.checkpointed(spark.range(5))
        assert folder()
        1 / 0
    assert not folder() and not session._scopes


def test_kept_tables_pass_to_the_outer_scope(spark, folder):
    with session.job_scope(spark):
        with session.job_scope(spark) as inner:
            kept = session.checkpointed(spark.range(5))
            session.checkpointed(spark.range(6))
            inner.keep(kept.withColumn("x", F.col("id") + 1))
        assert len(folder()) == 1 and kept.count() == 5
    assert not folder()
    with session.job_scope(spark) as alone:
        kept = alone.keep(session.checkpointed(spark.range(4)))
    assert kept.count() == 4 and len(folder()) == 1  # nobody's table stays


def test_shared_tables_go_with_their_last_holder(spark, folder):
    with session.job_scope(spark) as outer:
        with session.job_scope(spark) as inner:
            table = session.checkpointed(spark.range(3))
            for path in list(inner.paths):
                outer.hold(path)
        assert table.count() == 3
    assert not folder()
