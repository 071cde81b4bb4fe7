"""Adaptive search over a grid of settings: a tree-structured Parzen estimator in batches.

Trials so far are split into good and bad ones by score. For every setting, one histogram of its values
among the good trials and one among the bad ones, both with one count for each value in advance, say how
promising a value is; the points not tried yet with the greatest ratio over all settings are tried next. A batch
of points is fitted at the same time, so the cluster is not left waiting for one model. No point is
tried twice, and a search with as many trials as the grid has points covers it all.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame

from termloom.operators.models import TREE_GRID, fold_rows, score_points

#: Searched settings that Spark's trees do not have, with their values.
UNREACHED = {"min_samples_split": [2, 3, 4, 5], "ccp_alpha": [0.02, 0.03]}
START = 16
BATCH = 8
GOOD_SHARE = 0.25
#: Points compared for one batch, where the grid has more.
MOST_CANDIDATES = 20_000

Point = tuple[int, ...]


def _histograms(points: Sequence[Point], sizes: Sequence[int]) -> list[list[float]]:
    """Share of every value of every setting, one count for each in advance."""
    counts = [[1.0] * n for n in sizes]
    for point in points:
        for d, v in enumerate(point):
            counts[d][v] += 1
    return [[c / sum(row) for c in row] for row in counts]


def _candidates(sizes: Sequence[int], tried: set[Point], good: list[list[float]], rng: random.Random, most: int) -> list[Point]:
    """All points not tried yet; of a grid with more than ``most`` points, so many drawn by the good histograms."""
    if math.prod(sizes) <= most:
        return [p for p in itertools.product(*map(range, sizes)) if p not in tried]
    drawn: dict[Point, None] = {}
    for _ in range(2 * most):
        p = tuple(rng.choices(range(n), row)[0] for n, row in zip(sizes, good))
        if p not in tried:
            drawn[p] = None
        if len(drawn) == most:
            break
    return list(drawn)


def propose(
    sizes: Sequence[int], scores: Mapping[Point, float], n: int, rng: random.Random,
    good_share: float = GOOD_SHARE, most: int = MOST_CANDIDATES,
) -> list[Point]:
    """The next ``n`` points (fewer if the grid is used up), the most promising first."""
    order = sorted(scores, key=lambda p: (-scores[p], p))
    n_good = math.ceil(good_share * len(order))
    good, bad = _histograms(order[:n_good], sizes), _histograms(order[n_good:], sizes)
    ratio = [[math.log(a / b) for a, b in zip(x, y)] for x, y in zip(good, bad)]
    left = _candidates(sizes, set(scores), good, rng, most)
    ranked = sorted(left, key=lambda p: (-sum(row[v] for row, v in zip(ratio, p)), rng.random()))
    return ranked[:n]


def adaptive_search(
    run: Callable[[list[dict]], list[dict]], space: Mapping[str, Sequence], n_iter: int,
    start: int = START, batch: int = BATCH, seed: int = 42,
) -> list[dict]:
    """Trials of up to ``n_iter`` points. ``run`` gives points their ``mean_test_score``, all of a batch at once."""
    names, values = list(space), list(space.values())
    sizes = [len(v) for v in values]
    rng = random.Random(seed)
    scores: dict[Point, float] = {}
    trials: list[dict] = []
    while len(scores) < n_iter:
        size = min(n_iter - len(scores), batch if scores else start)
        points = propose(sizes, scores, size, rng)
        if not points:
            break
        done = run([{name: v[i] for name, v, i in zip(names, values, p)} for p in points])
        number = 1 + trials[-1]["round"] if trials else 0
        for point, trial in zip(points, done):
            scores[point] = trial["mean_test_score"]
            trials.append({**trial, "round": number})
    return trials


def search_adaptive(
    df: DataFrame, features: Sequence[str], label: str, kind: str = "tree", key: Sequence[str] = ("id",),
    space: Mapping[str, Sequence] = TREE_GRID, n_iter: int = 150, folds: int = 2,
    seed: int = 42, parallelism: int = 8, start: int = START, batch: int = BATCH,
) -> list[dict]:
    """Cross-validated trials by accuracy. All points see the same folds, which are stored once. Settings that
    mean the same are fitted once."""
    data = fold_rows(df, features, label, folds, key, seed)
    fitted: dict = {}

    def run(points: list[dict]) -> list[dict]:
        return score_points(data, features, label, kind, points, folds, seed, parallelism, fitted)

    return adaptive_search(run, space, n_iter, start, batch, seed)
