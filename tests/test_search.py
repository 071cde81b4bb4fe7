"""Adaptive search: proposals without repetition, quality against the whole grid, the search-fit-store job."""

import itertools
import math
import random

import numpy as np
import pytest

from termloom.operators import models, search
from termloom.plans.training import search_fit_store


def test_whole_grid_once_and_unreached_settings_are_named():
    seen = []

    def run(points):
        seen.extend(tuple(p.values()) for p in points)
        return [{"params": p, "mean_test_score": 0.5} for p in points]

    trials = search.adaptive_search(run, models.TREE_GRID, 150)
    assert len(trials) == len(set(seen)) == 128 == math.prod(len(v) for v in models.TREE_GRID.values())
    assert set(seen) == set(itertools.product(*models.TREE_GRID.values()))
    assert set(search.UNREACHED) == {"min_samples_split", "ccp_alpha"}
    assert len(search.adaptive_search(run, models.TREE_GRID, 10)) == 10


@pytest.mark.parametrize("seed", range(5))
def test_best_point_is_within_one_standard_error_of_the_whole_grid(seed):
    rng = np.random.default_rng(seed)
    effect = {n: rng.normal(0, 0.03, len(v)) for n, v in models.TREE_GRID.items()}
    error = 0.01

    def truth(p):
        return 0.8 + sum(effect[n][models.TREE_GRID[n].index(v)] for n, v in p.items())

    noise = np.random.default_rng(100 + seed)

    def run(points):
        return [{"params": p, "mean_test_score": truth(p) + noise.normal(0, error / 4)} for p in points]

    best = max(truth(p) for p in models.grid(models.TREE_GRID))
    trials = search.adaptive_search(run, models.TREE_GRID, 48, seed=seed)
    assert len({str(t["params"]) for t in trials}) == 48
    assert max(truth(t["params"]) for t in trials) >= best - error
    later = [truth(t["params"]) for t in trials if t["round"] > 0]
    first = [truth(t["params"]) for t in trials if t["round"] == 0]
    assert np.mean(later) > np.mean(first)  # it learns where to look


def test_grids_too_large_to_list_are_drawn_from():
    rng = random.Random(1)
    sizes = [50] * 6
    scores = {tuple(rng.randrange(50) for _ in sizes): 0.0 for _ in range(12)}
    good = (7,) * 6
    scores[good] = 1.0
    points = search.propose(sizes, scores, 20, rng, good_share=0.05, most=500)
    assert len(set(points)) == 20 and good not in points
    assert sum(v == 7 for p in points for v in p) > 6 * 20 / 50 * 2


def rows(spark, n=300):
    rng = np.random.default_rng(8)
    return spark.createDataFrame(
        [(i, float(a), float(b), int(a + 0.3 * b > 0.8)) for i, (a, b) in enumerate(rng.random((n, 2)))],
        "id long, a double, b double, y int",
    )


def test_search_against_every_point(spark):
    df = rows(spark)
    space = {"maxDepth": [1, 2, 6], "impurity": ["gini", "entropy"], "minInstancesPerNode": [1, 60]}
    every = models.cross_validate(df, ["a", "b"], "y", "tree", models.grid(space), 2, ["id"], parallelism=8)
    some = search.search_adaptive(df, ["a", "b"], "y", space=space, n_iter=8, start=4, batch=2)
    best = max(every, key=lambda t: t["mean_test_score"])
    assert len({str(t["params"]) for t in some}) == 8
    assert max(t["mean_test_score"] for t in some) >= best["mean_test_score"] - max(best["std_error"], 1e-9)
    scores = {str(t["params"]): t["mean_test_score"] for t in every}
    assert all(t["mean_test_score"] == pytest.approx(scores[str(t["params"])]) for t in some)


def test_settings_that_mean_the_same_are_fitted_once(spark, monkeypatch):
    df = rows(spark)
    space = {"maxDepth": [3], "minInstancesPerNode": [1, 2, 5], "minWeightFractionPerNode": [0.0, 0.2]}
    points = models.grid(space)
    data = models.fold_rows(df, ["a", "b"], "y", 2, ["id"])
    alone = [models.score_points(data, ["a", "b"], "y", "tree", [p], 2)[0]["mean_test_score"] for p in points]
    fits, fit = [], models.fit_classifier
    monkeypatch.setattr(models, "fit_classifier", lambda *a, **k: fits.append(k) or fit(*a, **k))
    trials = search.search_adaptive(df, ["a", "b"], "y", space=space, n_iter=6, start=2, batch=2)
    assert len(trials) == 6 and len(fits) == 2 * (3 + 1)  # a fifth of the rows is more than five rows
    assert {str(t["params"]): t["mean_test_score"] for t in trials} == {str(p): a for p, a in zip(points, alone)}
    few = [models._same_fit(p, "tree", 10) for p in points]
    assert len(set(few)) == 3 and few[3] == few[2] and few[5] == few[4]  # two of ten rows: the number decides from two on
    assert len({models._same_fit(p, "forest", 10) for p in points}) == 6


@pytest.mark.parametrize("kind, space", [("tree", {"maxDepth": [1, 4]}), ("forest", {"numTrees": [2, 4], "maxDepth": [1, 4]})])
def test_job_stores_the_best_model(spark, tmp_path, kind, space):
    df = rows(spark)
    train, test = df.filter("id % 4 > 0"), df.filter("id % 4 = 0")
    job = search_fit_store(
        train, test, ["a", "b"], "y", str(tmp_path / "m"), kind, balanced=kind == "tree", space=space, folds=2
    )
    assert job.params["maxDepth"] == 4
    stored = models.learner_params(models.load_model(job.path))
    assert all(stored[k] == v for k, v in job.params.items())
    row = job.row().first()
    assert row["n_trials"] == len(job.trials) and '"maxDepth": 4' in row["params"] and row["accuracy"] > 0.85
