"""Model tables: entry features, and the terms of one study year in wide form with filled
conditions and course components."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators import models
from termloom.operators.balance import oversample
from termloom.operators.components import CountComponents, fit_count_components
from termloom.operators.encode import encode_labels, fit_labels
from termloom.operators.impute import Chain, fit_class_chain
from termloom.operators.panel import pivot_terms, year_window
from termloom.operators.search import search_adaptive
from termloom.session import checkpointed


def term_orders(year_no: int) -> list[int]:
    return list(range(4 * year_no - 3, 4 * year_no + 1))


def term_names(year_no: int, attributes: Sequence[str]) -> list[str]:
    return [f"trim{n:02d}_{a}" for n in term_orders(year_no) for a in attributes]


def entry_table(
    entities: DataFrame, numeric: Sequence[str], categories: Sequence[str], labels: Sequence[str],
    tables: dict[str, DataFrame] | None = None, key: str = "id",
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """What is known at entry: numbers and encoded categories. Encoders are fitted where no
    ``tables`` from training are given."""
    fitted = dict(tables or {})
    df = entities.select(key, *numeric, *categories, *labels)
    for column in categories:
        if column not in fitted:
            fitted[column] = fit_labels(df, column)
        df = encode_labels(df, column, fitted[column], f"{column}_code", [key])
    return df.select(key, *numeric, *[f"{c}_code" for c in categories], *labels), fitted


@dataclass
class YearModels:
    """What a year's table needs from training: condition chain and course components."""

    chain: Chain
    components: CountComponents

    def save(self, path: str) -> None:
        self.chain.save(f"{path}/conditions", self.components.loadings.sparkSession)
        self.components.save(f"{path}/components")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> "YearModels":
        return cls(Chain.load(f"{path}/conditions", spark), CountComponents.load(f"{path}/components", spark))


def year_table(
    panel: DataFrame,
    courses: DataFrame,
    year_no: int,
    attributes: Sequence[str],
    condition: str,
    components: int,
    fitted: YearModels | None = None,
    key: str = "id",
    max_iter: int = 100,
) -> tuple[DataFrame, YearModels]:
    """One row per entity that completed the year.

    ``panel`` has term order, ``trim_quant``, numeric attributes and the coded condition (null
    where unknown); ``courses`` has ``key, token, n`` for the year. Missing attributes count
    as 0. The models come from training (``fitted``) or are learned here.
    """
    wide = _wide_year(panel, year_no, attributes, condition, key)
    if fitted is None:
        fitted = _fit_wide(wide, courses, year_no, attributes, condition, components, key, max_iter)
    scored = fitted.components.transform(fitted.chain.apply(wide), courses, key)
    return scored.select(key, *year_feature_names(year_no, attributes, condition, fitted)), fitted


def _wide_year(panel: DataFrame, year_no: int, attributes: Sequence[str], condition: str, key: str) -> DataFrame:
    wide = pivot_terms(year_window(panel, year_no), [*attributes, condition], term_orders(year_no), key)
    return checkpointed(wide.fillna(0, subset=term_names(year_no, attributes)))


def _fit_wide(
    wide: DataFrame, courses: DataFrame, year_no: int, attributes: Sequence[str], condition: str, components: int, key: str, max_iter: int,
) -> YearModels:
    steps = [[f"trim{n:02d}_{a}" for a in attributes] for n in term_orders(year_no)]
    return YearModels(
        fit_class_chain(wide, condition_names(year_no, condition), steps, max_iter=max_iter),
        fit_count_components(wide.select(key), courses, components, key),
    )


def fit_year(
    panel: DataFrame, courses: DataFrame, year_no: int, attributes: Sequence[str], condition: str, components: int,
    key: str = "id", max_iter: int = 100,
) -> YearModels:
    """What ``year_table`` learns, without its table."""
    wide = _wide_year(panel, year_no, attributes, condition, key)
    return _fit_wide(wide, courses, year_no, attributes, condition, components, key, max_iter)


def condition_names(year_no: int, condition: str) -> list[str]:
    return [f"trim{n:02d}_{condition}" for n in term_orders(year_no)]


def year_feature_names(year_no: int, attributes: Sequence[str], condition: str, fitted: YearModels) -> list[str]:
    return [
        *term_names(year_no, attributes), *condition_names(year_no, condition), *fitted.components.names()
    ]


@dataclass
class Searched:
    """What a search job gives: the stored model, its settings, all trials and the held-out metrics."""

    path: str
    params: dict
    trials: list[dict]
    model: PipelineModel
    metrics: DataFrame

    def row(self) -> DataFrame:
        """One row: how many points were tried, the best one, its score in the search and on held-out rows."""
        score = max(t["mean_test_score"] for t in self.trials)
        return self.metrics.select(
            F.lit(len(self.trials)).cast("long").alias("n_trials"), F.lit(json.dumps(self.params, sort_keys=True)).alias("params"),
            F.lit(float(score)).alias("mean_test_score"), "*",
        )


def search_fit_store(
    train: DataFrame, test: DataFrame, features: Sequence[str], label: str, path: str, kind: str = "tree",
    balanced: bool = False, key: str = "id", space: Mapping[str, Sequence] | None = None,
    n_iter: int = 150, folds: int | None = None, seed: int = 42, parallelism: int = 8,
) -> Searched:
    """One job: search the settings on the training rows, fit the best, store it, load it, and judge it on ``test``.

    Trees are searched adaptively over the grid, forests by successive halving; ``balanced`` raises the smaller classes first.
    """
    fitted_on = checkpointed(train.select(key, label, *features))
    if balanced:
        fitted_on = checkpointed(oversample(fitted_on, label, features, key, seed=seed))
    if kind == "tree":
        trials = search_adaptive(
            fitted_on, features, label, kind, [key], space or models.TREE_GRID, n_iter, folds or 2, seed, parallelism
        )
        last = trials
    else:
        trials = models.search_forest(
            fitted_on, features, label, [key], space or models.FOREST_GRID, folds=folds or 7, seed=seed, parallelism=parallelism
        )
        last = models.final_round(trials)
    params = models.best_params(last)
    models.save_model(models.fit_classifier(fitted_on, features, label, kind, seed, **params), path)
    stored = models.load_model(path)
    metrics = models.evaluate(models.score(stored, test, "_pred", "_prob"), label, "_pred")
    return Searched(path, params, last, stored, metrics)
