"""Embedding whitening: secular equations, combined spectra, the whole query against numpy's decomposition."""

import numpy as np
import pytest

from termloom.llm import whitening
from termloom.llm.queries import QUERIES

VEC = "vec_id long, embedding array<float>, label int"


def by_hand(vectors, components=4):
    """The distinct grid vectors' covariance in numpy, and the exact deviations."""
    x = np.floor(256 * np.array(vectors, float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    off = fit - sums / n
    values, axes = np.linalg.eigh(off.T @ off / n)
    values, axes = values[::-1], axes[:, ::-1]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums)) for r in x]
    k = min(components, x.shape[1])
    return n, deviation, ((x - sums / n) @ axes)[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def same_up_to_sign(got, want):
    return np.abs(got @ np.sign((got * want).sum()) - want).max() if got.ndim == 0 else np.abs(got * np.sign((got * want).sum(axis=0)) - want).max()


def check(rows, vectors, components=4):
    n, deviation, white, explained = by_hand(vectors, components)
    k = white.shape[1]
    rows = sorted(rows, key=lambda r: (r.vec_id, r.component))
    assert [r.component for r in rows] == list(range(1, k + 1)) * len(vectors)
    assert {r.n for r in rows} == {n}
    assert [r.deviation for r in rows[::k]] == deviation
    got = np.array([r.whitened for r in rows]).reshape(-1, k)
    assert same_up_to_sign(got, white) < 1e-8
    assert np.allclose([r.explained for r in rows[:k]], explained, rtol=1e-10)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


@pytest.mark.parametrize("seed", range(6))
def test_rank_one_updates_keep_the_decomposition(seed):
    rng = np.random.default_rng(seed)
    d = 12
    spectrum, seen = whitening.Spectrum(d), []
    for i in range(80):
        x = rng.integers(-40, 40, d).astype(float) * (rng.random(d) < (0.2 if seed % 2 else 1)) * 10.0 ** rng.integers(-3, 4)
        if i % 7 == 3:
            x = seen[rng.integers(len(seen))]  # repeated directions are deflated
        if i == 5:
            x = spectrum.mean.copy()
        seen.append(x)
        spectrum.add(x)
        off = np.array(seen) - np.mean(seen, axis=0)
        scatter = off.T @ off
        size = np.abs(scatter).max() + 1
        q = spectrum.vectors
        assert np.abs(q.T @ q - np.eye(d)).max() < 1e-11
        assert np.abs(q * spectrum.values @ q.T - scatter).max() < 1e-11 * size
        assert np.abs(spectrum.values - np.linalg.eigvalsh(scatter)).max() < 1e-11 * size


def test_secular_roots_interlace_and_solve():
    rng = np.random.default_rng(0)
    for k in (1, 2, 3, 30):
        poles = np.sort(rng.random(k) * 10.0 ** rng.integers(-6, 6, k)) + np.arange(k) * 1e-9
        z = rng.normal(size=k) * 10.0 ** rng.integers(-5, 3, k)
        near, x = whitening.secular_roots(poles, z * z)
        want = np.linalg.eigvalsh(np.diag(poles) + np.outer(z, z))
        assert np.allclose(poles[near] + x, want, atol=1e-13 * (poles[-1] + z @ z))
        assert (x[:-1] + poles[near][:-1] <= poles[1:]).all() and (x + poles[near] >= poles).all()


def test_merging_equals_adding():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 9)) @ np.diag(np.arange(9) ** 3) + 100
    one, parts = whitening.Spectrum(9), []
    for v in x:
        one.add(v)
    for part in np.split(x, [1, 2, 50, 290]):
        s = whitening.Spectrum(9)
        for v in part:
            s.add(v)
        parts.append(s.row())
    row = whitening._combined(9)(np.array(parts))
    whole = whitening.Spectrum.of_row(row, 9)
    assert whole.n == 300 and np.allclose(whole.mean, one.mean)
    assert np.allclose(whole.values, one.values, atol=1e-9 * one.values[-1])


def test_query_on_given_vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    got = QUERIES["op12_embedding_whitening"](spark, sf_dir).collect()
    check(got, [r.embedding for r in rows])


def test_copies_odd_rows_and_many_parts(spark):
    rng = np.random.default_rng(8)
    base = (rng.normal(size=(240, 5)) * [3, 2, 1, 0.5, 0.1]).astype("f4").tolist()
    vectors = base + [base[0]] * 150 + [base[1]] * 3
    rows = [(i, v, 0) for i, v in enumerate(vectors)]
    bad = [
        (900, None, 0), (901, [], 0), (902, [1.0, None, 1.0, 1.0, 1.0], 0), (903, [1.0, float("nan"), 1.0, 1.0, 1.0], 0),
        (904, [float("inf"), 1.0, 1.0, 1.0, 1.0], 0), (905, [1.0, 2.0], 0),
    ]
    df = spark.createDataFrame(rows + bad, VEC).selectExpr("*", "1 AS x", "2 AS c").repartition(40)
    check(whitening.whitened(df).collect(), vectors)


def test_exact_beyond_64_bits_and_flat_tables(spark):
    assert whitening.whitened(spark.createDataFrame([], VEC)).collect() == []
    same = whitening.whitened(spark.createDataFrame([(1, [0.5, 0.5], 0), (None, [0.5, 0.5], 0)], VEC)).collect()
    assert len(same) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(1, 0, None, None, None)}
    line = whitening.whitened(spark.createDataFrame([(i, [float(i), 2.0 * i], 0) for i in range(9)], VEC)).collect()
    assert {r.component: r.whitened is None for r in line} == {1: False, 2: True} and max(r.identity_error for r in line) < 1e-9
    off = whitening.centred(np.array([[1 << 61, -5]]), 9, [3, 4])
    assert off.tolist() == [[9 * (1 << 61) - 3, -49]] and whitening.deviations(off) == [None]
    assert whitening.deviations(whitening.centred(np.array([[1 << 30, 1]]), 3, [0, 0])) == [None]
    assert whitening.deviations(whitening.centred(np.array([[1 << 29, 1]]), 3, [0, 0])) == [9 * (1 << 58) + 9]
