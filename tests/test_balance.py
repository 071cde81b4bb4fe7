"""Neighbours against brute force; balancing by its properties."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.operators import neighbours, resample
from termloom.operators.balance import METHODS, class_distribution, oversample, train_test
from termloom.operators.neighbours import nearest_neighbours, neighbour_slots
from tests.conftest import collect


def brute(vectors, k):
    d = np.sqrt(((vectors[:, None, :] - vectors[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    return [sorted(((d[i, j], j) for j in range(len(d)) if np.isfinite(d[i, j])))[:k] for i in range(len(d))]


def frame(spark, vectors):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "key long, vec array<double>").repartition(5)


@pytest.mark.parametrize("shape", ["even", "clusters", "line", "few"])
def test_neighbours_are_exact(spark, shape):
    rng = np.random.default_rng(5)
    vectors = {
        "even": rng.random((160, 3)),
        "clusters": np.concatenate([rng.normal(c, 0.01, (50, 2)) for c in (0.0, 5.0, 5.1)]),
        "line": np.arange(120, dtype=float)[:, None] ** 2,
        "few": rng.random((3, 2)),
    }[shape]
    got = {r["key"]: r["neighbours"] for r in nearest_neighbours(frame(spark, vectors), "key", "vec", 5, block=20).collect()}
    for i, expected in enumerate(brute(vectors, 5)):
        assert [n["key"] for n in got[i]] == [j for _, j in expected]
        assert np.allclose([n["dist"] for n in got[i]], [d for d, _ in expected])


def test_visits_stay_few_where_there_is_structure(spark):
    rng = np.random.default_rng(6)
    clustered = np.concatenate([rng.normal(c * 10, 0.3, (40, 3)) for c in range(20)])
    even = rng.normal(size=(400, 24))  # nothing to rule out: every row may visit every block
    counts = {}
    for name, vectors in (("clustered", clustered), ("even", even)):
        visits: list[int] = []
        got = {r["key"]: r["neighbours"] for r in nearest_neighbours(frame(spark, vectors), "key", "vec", 4, block=20, visits=visits).collect()}
        assert all([n["key"] for n in got[i]] == [j for _, j in e] for i, e in enumerate(brute(vectors, 4)))
        counts[name] = sum(visits) / len(vectors) / (len(vectors) / 20)  # share of all blocks a row compares with
    assert counts["clustered"] < 0.2 and counts["even"] <= 2.5, counts


def test_small_blocks_are_taken_together(spark, monkeypatch):
    """Blocks of ten rows: one comparison for a batch of them, the same neighbours."""
    calls = spark.sparkContext.accumulator(0)
    nearest = neighbours._nearest

    def counted(*args):
        calls.add(1)
        return nearest(*args)

    monkeypatch.setattr(neighbours, "_nearest", counted)
    vectors = np.random.default_rng(7).normal(size=(400, 12))
    got = {r["key"]: r["neighbours"] for r in neighbours.nearest_neighbours(frame(spark, vectors), "key", "vec", 3, block=10).collect()}
    assert all([n["key"] for n in got[i]] == [j for _, j in e] for i, e in enumerate(brute(vectors, 3)))
    assert calls.value < 100  # 40 blocks were compared with each other


def test_comparisons_are_exact_far_from_the_origin():
    rng = np.random.default_rng(9)
    for shift, scale in ((1e6, 1.0), (0.0, 1e200), (1e9, 1e-3)):
        vectors = rng.normal(size=(60, 4)) * scale + shift
        names = rng.permutation(60)
        ids, gaps = neighbours._nearest(vectors, vectors, names, names, 4)
        d = neighbours._distances(vectors, vectors)
        np.fill_diagonal(d, np.inf)
        for i in range(60):
            want = sorted((x, n) for x, n in zip(d[i], names) if np.isfinite(x))[:4]
            assert list(zip(gaps[i], ids[i])) == want


def test_rows_without_distances_hide_no_others(spark):
    vectors = np.random.default_rng(10).normal(size=(200, 3))
    vectors[::40, 1] = np.nan
    vectors[7, 0] = np.inf
    rows = [(i, [None if np.isnan(x) else float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "key long, vec array<double>")
    got = {r["key"]: r["neighbours"] for r in neighbours.nearest_neighbours(df, "key", "vec", 3, block=10).collect()}
    for i, expected in enumerate(brute(vectors, 3)):
        assert [n["key"] for n in got[i]] == [j for _, j in expected]
    only = neighbours.nearest_neighbours(df.filter("key = 0"), "key", "vec", 3)
    assert [r["neighbours"] for r in only.collect()] == [[]]


def test_vectors_are_not_broadcast(spark):
    df = spark.range(40).selectExpr("id", "id % 2 as y", "cast(id as double) as a", "cast(id % 7 as double) as b")
    for plan in (resample.enn_removed(df, "y", ["a", "b"]), resample.tomek_links(df, "y", ["a", "b"])):
        assert "BroadcastHashJoin" not in plan._jdf.queryExecution().executedPlan().toString()


def test_one_row_has_no_neighbours(spark):
    got = nearest_neighbours(frame(spark, np.ones((1, 2))), "key", "vec", 3).collect()
    assert got[0]["neighbours"] == []


def test_slots_count_copies(spark):
    near = spark.createDataFrame(
        [(1, [(1.0, 2), (2.0, 3)]), (2, [(1.0, 1), (1.5, 3)]), (3, [])],
        "key long, neighbours array<struct<dist:double,key:bigint>>",
    )
    copies = spark.createDataFrame([(1, 2), (2, 1), (3, 9)], "key long, n long")
    got = dict(collect(neighbour_slots(near, copies, 4), "key"))
    assert got == {1: [1, 2, 3, 3], 2: [1, 1, 3, 3], 3: [3, 3, 3, 3]}


def imbalanced(spark, copies=0):
    rng = np.random.default_rng(9)
    rows = [(i, 0, *map(float, rng.random(2))) for i in range(150)]
    rows += [(200 + i, 1, *map(float, rng.random(2) + 3)) for i in range(40)]
    rows += [(300 + i, 1, 3.5, 3.5) for i in range(copies)]
    rows += [(400, 2, 9.0, 9.0)]
    return spark.createDataFrame(rows, "id long, y int, a double, b double").repartition(3)


@pytest.mark.parametrize("copies", [0, 30])
def test_balanced_and_between_neighbours(spark, copies):
    df = imbalanced(spark, copies)
    out = oversample(df, "y", ["a", "b"], block=15)
    sizes = dict(collect(class_distribution(out, "y"), "y"))
    assert sizes == {0: 150, 1: 150, 2: 150}
    assert out.filter("synthetic = 0").count() == df.count()
    held = {r["id"]: np.array([r["a"], r["b"]]) for r in df.filter("y = 1").collect()}
    ids = sorted(held)
    vectors = np.array([held[i] for i in ids])
    gaps = np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(axis=2))
    np.fill_diagonal(gaps, np.inf)
    reach = {i: np.sort(gaps[n])[4] for n, i in enumerate(ids)}
    used = {}
    for r in out.filter("synthetic = 1 AND y = 1").collect():
        base, new = held[r["id"]], np.array([r["a"], r["b"]])
        used[r["id"]] = used.get(r["id"], 0) + 1
        ends = [v for v in held.values() if np.linalg.norm(v - base) <= reach[r["id"]] + 1e-12]
        off = [
            np.linalg.norm(base - new) + np.linalg.norm(new - v) - np.linalg.norm(base - v) for v in ends
        ]
        assert min(off) < 1e-9
    assert max(used.values()) - min(used.get(i, 0) for i in ids) <= 1
    lone = out.filter("synthetic = 1 AND y = 2").collect()
    assert {(r["a"], r["b"]) for r in lone} == {(9.0, 9.0)}


def test_same_result_from_other_input_order(spark):
    df = imbalanced(spark)
    a = oversample(df, "y", ["a", "b"], block=15)
    b = oversample(df.orderBy(F.desc("id")).repartition(7), "y", ["a", "b"], block=15)
    assert collect(a, "id", "a", "b") == collect(b, "id", "a", "b")


def test_variants_equal_the_plain_method(spark):
    df = imbalanced(spark)
    results = [collect(oversample(df, "y", ["a", "b"], method=m), "id", "a", "b") for m in METHODS]
    assert results[0] == results[1] == results[2]
    with pytest.raises(ValueError):
        oversample(df, "y", ["a", "b"], method="other")


def test_split_is_by_key(spark):
    df = spark.range(4000).withColumn("y", F.lit(1))
    train, test = train_test(df)
    assert train.count() + test.count() == 4000
    assert 900 < test.count() < 1100
    again = train_test(df.orderBy(F.desc("id")).repartition(9))[1]
    assert collect(test, "id") == collect(again, "id")


def test_rows_that_take_turns_find_the_same(spark, monkeypatch):
    """What visits move at a time is bounded, and the tables of a round go."""
    from termloom.operators import neighbours
    from termloom.session import checkpoint_dir

    rng = np.random.default_rng(21)
    vectors = rng.normal(size=(300, 24))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, vec array<double>")
    turns, kept = [], neighbours._turns
    monkeypatch.setattr(neighbours, "_turns", lambda *a: turns.append(kept(*a)) or turns[-1])
    monkeypatch.setattr(neighbours, "BATCH_ROWS", 40)
    monkeypatch.setattr(neighbours, "WAVE_BYTES", 300 * 24 * 8 * 4)
    at = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(at))
    near = neighbours.nearest_neighbours(df, "id", "vec", 3, block=20)
    assert max(turns) > 1
    assert len(set(os.listdir(at)) - before) <= 1 + max(turns)  # the rows and what was found last
    d = np.sqrt(((vectors[:, None, :] - vectors[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    want = {i: [int(j) for j in np.argsort(r, kind="stable")[:3]] for i, r in enumerate(d)}
    assert {r["key"]: [x["key"] for x in r["neighbours"]] for r in near.collect()} == want
