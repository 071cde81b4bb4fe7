import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.operators.summaries import box_summary, describe_by, histogram, quantiles
from tests.conftest import collect

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.mark.parametrize(
    "draw",
    [
        lambda r: r.gauss(0, 1),
        lambda r: r.choice([0.0, 1.0, 1.0, 5.0]),
        lambda r: -abs(r.gauss(0, 1e6)),
        lambda r: 1e6 + r.random() * 1e-4,
        lambda r: r.lognormvariate(0, 6),
        lambda r: 42.0,
    ],
)
def test_exact(spark, draw):
    rng = random.Random(3)
    values = [draw(rng) for _ in range(701)]
    df = spark.createDataFrame([("g", v) for v in values] + [("g", None)], "g string, v double")
    got = collect(quantiles(df, ["g"], "v", PROBS), "g")[0][1:]
    assert np.allclose(got, np.quantile(values, PROBS), rtol=1e-12, atol=0)


def test_many_groups_and_hot_group(spark):
    rng = random.Random(4)
    rows = [(0 if i % 3 == 0 else i % 40, rng.random()) for i in range(2000)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r[0]: r[1:] for r in collect(quantiles(df, ["g"], "v", [0.25, 0.5]), "g")}
    for g in {g for g, _ in rows}:
        assert np.allclose(got[g], np.quantile([v for k, v in rows if k == g], [0.25, 0.5]))


def test_describe_single_row_and_nulls(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", None), ("c", 1.0), ("c", 2.0)], "g string, v double")
    got = {r["g"]: r for r in describe_by(df, ["g"], "v").collect()}
    assert got["a"]["std"] is None and got["a"]["p_50"] == 3.0
    assert got["b"]["count"] == 0 and got["b"]["p_50"] is None
    assert got["c"]["p_25"] == 1.25


def test_box_counts_outside(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]], "v double")
    row = box_summary(df, ["v"]).first()
    assert (row["p_25"], row["p_75"], row["n_outside"]) == (2.0, 4.0, 1)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in range(0, 11)] + [(None,)], "v double")
    assert collect(histogram(df, "v", 5).select("bin", "n"), "bin") == [(1, 2), (2, 2), (3, 2), (4, 2), (5, 3)]
    one = histogram(df.filter(F.col("v") == 3), "v", 5)
    assert collect(one.select("bin", "n"), "bin") == [(1, 1)]
