"""Tree models: fitting, search, evaluation, importance and risk scores.

Models are Spark ML pipelines (assembler + classifier), so the feature names are stored with
the model and a model can be fitted again from its own parameters.
"""

from __future__ import annotations

import itertools
import json
import math
import random
import time
from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.operators.balance import hash_share
from termloom.session import checkpointed

DEEPEST = 30  # the depth limit of Spark's trees; "no limit" and larger values map to it

# fixed values: the searched settings, in Spark's parameter names
TREE_GRID = {
    "impurity": ["gini", "entropy"],
    "minInstancesPerNode": [2, 3, 4, 5],
    "minWeightFractionPerNode": [0.0, 0.01, 0.02, 0.03],
    "minInfoGain": [0.0, 0.01, 0.02, 0.04],
    "maxDepth": [DEEPEST],
}
FOREST_GRID = {
    "numTrees": [200, 300],
    "impurity": ["gini"],
    "maxDepth": [DEEPEST],
    "minInstancesPerNode": [1],
    "featureSubsetStrategy": ["0.35"],
}

LEARNERS = {"tree": DecisionTreeClassifier, "forest": RandomForestClassifier}
_FEATURES = "_features"
#: Rows of one task of a forest's fit. Each row is drawn for every tree, so few bytes are much work.
FOREST_ROWS = 10_000


def _dealt(df: DataFrame) -> DataFrame:
    """The rows in parts of about ``FOREST_ROWS``; fewer rows stay as they are."""
    parts = -(-df.count() // FOREST_ROWS)
    return df.repartition(parts) if parts > 1 else df


def fit_classifier(
    df: DataFrame, features: Sequence[str], label: str, kind: str = "tree", seed: int = 42, **params
) -> PipelineModel:
    """Fit a tree or a forest on numeric columns; ``params`` are Spark parameter names.

    For a forest, the node of every row is kept with the row, so the trees grown so far are not sent to the tasks of every round.
    """
    learner = LEARNERS[kind](featuresCol=_FEATURES, labelCol="_label", seed=seed, cacheNodeIds=kind == "forest")
    learner = learner.setParams(**params)
    assembler = VectorAssembler(inputCols=list(features), outputCol=_FEATURES, handleInvalid="keep")
    rows = df.withColumn("_label", F.col(label).cast("double"))
    if kind == "forest":
        rows = _dealt(rows.select(*features, "_label"))
    return Pipeline(stages=[assembler, learner]).fit(rows)


def feature_names(model: PipelineModel) -> list[str]:
    return list(model.stages[0].getInputCols())


def learner_params(model: PipelineModel) -> dict:
    """The settings a stored model was fitted with, ready to be passed to ``fit_classifier``."""
    fitted = model.stages[-1]
    leave = {"featuresCol", "labelCol", "predictionCol", "probabilityCol", "rawPredictionCol", "seed", "leafCol", "cacheNodeIds"}
    return {p.name: fitted.getOrDefault(p) for p in fitted.params if fitted.isSet(p) and p.name not in leave}


def refit(
    model: PipelineModel, df: DataFrame, label: str, renamed: Mapping[str, str] | None = None, seed: int = 42
) -> PipelineModel:
    """Fit again with the parameters and (optionally renamed) features of ``model``."""
    kind = "forest" if "RandomForest" in type(model.stages[-1]).__name__ else "tree"
    names = [(renamed or {}).get(f, f) for f in feature_names(model)]
    return fit_classifier(df, names, label, kind, seed, **learner_params(model))


def risk(probabilities: Column) -> Column:
    """The probability of every class but the first."""
    others = F.slice(probabilities, 2, F.greatest(F.size(probabilities) - 1, F.lit(0)))
    return F.aggregate(others, F.lit(0.0), lambda a, b: a + b)


def score(model: PipelineModel, df: DataFrame, pred: str, prob: str) -> DataFrame:
    """Add the class and the risk to each row."""
    scored = model.transform(df)
    return scored.select(
        *df.columns, F.col("prediction").cast("int").alias(pred),
        risk(vector_to_array(F.col("probability"))).alias(prob),
    )


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return (
        df.groupBy(F.col(label).cast("double").alias("label"), F.col(prediction).cast("double").alias("prediction"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def evaluate(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: accuracy and weighted F1, precision and recall, all from one count."""
    cells = confusion(df, label, prediction)
    right = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("label").alias("c"), F.col("n").alias("real"), F.lit(0).cast("long").alias("said"), right.cast("long").alias("hit")),
                F.struct(F.col("prediction").alias("c"), F.lit(0).cast("long").alias("real"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")),
            )
        ).alias("s")
    ).select("s.*")
    per_class = sides.groupBy("c").agg(F.sum("real").alias("real"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    precision = F.coalesce(F.try_divide("hit", "said"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hit", "real"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("hit"), F.col("real") + F.col("said")), F.lit(0.0))

    def weighted(c):
        return F.try_divide(F.sum(F.col("real") * c), F.sum("real"))

    return per_class.agg(
        F.try_divide(F.sum("hit"), F.sum("real")).alias("accuracy"),
        weighted(f1).alias("f1_score"),
        weighted(precision).alias("precision"),
        weighted(recall).alias("recall"),
    )


def importances(model: PipelineModel, df: DataFrame, top: int = 20) -> DataFrame:
    """The ``top`` features by importance; the table is as long as the feature list."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(feature_names(model), values)]
    table = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature").limit(top)


def grid(space: Mapping[str, Sequence]) -> list[dict]:
    return [dict(zip(space, point)) for point in itertools.product(*space.values())]


def _sampled(points: list[dict], n: int, seed: int) -> list[dict]:
    """A seeded choice without repetition; the whole grid when it has no more than n points."""
    return points if len(points) <= n else random.Random(seed).sample(points, n)


def fold_rows(
    df: DataFrame, features: Sequence[str], label: str, folds: int, key: Sequence[str], seed: int = 42
) -> DataFrame:
    """What a search reads, stored, with the fold of each row. Folds come from the key, so every point
    sees the same ones and rows that share a key stay together."""
    return checkpointed(df.select(*key, label, *features).withColumn("_fold", hash_share(key, seed, folds)))


def _same_fit(point: Mapping, kind: str, n_rows: int) -> str:
    """Equal for settings that give the same model of ``n_rows`` rows.

    A split of a tree needs a least number of rows on both sides and a least share of all rows. Rows of a tree have no
    weights, so the greater of the two numbers decides, and the other one changes nothing.
    """
    settings = dict(point)
    if kind == "tree":
        least, share = settings.pop("minInstancesPerNode", 1), settings.pop("minWeightFractionPerNode", 0.0)
        settings["_least"] = max(least, math.ceil(share * n_rows))
    return json.dumps(settings, sort_keys=True)


def score_points(
    data: DataFrame, features: Sequence[str], label: str, kind: str, points: Sequence[dict],
    folds: int, seed: int = 42, parallelism: int = 4, fitted: dict | None = None,
) -> list[dict]:
    """Mean accuracy, its standard error and the mean fit time of each point. Fits of all points and folds are
    submitted ``parallelism`` at a time.

    Points whose settings mean the same on the rows of a fold share one fit. ``fitted`` keeps what was found for later
    calls with the same arguments.
    """
    fitted = {} if fitted is None else fitted
    if "_rows" not in fitted:
        held = {r["_fold"]: r["count"] for r in data.groupBy("_fold").count().collect()}  # one row a fold
        fitted["_rows"] = [sum(held.values()) - held.get(f, 0) for f in range(folds)]
    names = [(_same_fit(p, kind, fitted["_rows"][f]), f) for p in points for f in range(folds)]

    def one(job: tuple[dict, int]) -> tuple[float | None, float]:
        point, fold = job
        train, test = data.filter(F.col("_fold") != fold), data.filter(F.col("_fold") == fold)
        start = time.monotonic()
        model = fit_classifier(train, features, label, kind, seed, **point)
        took = time.monotonic() - start
        hit = F.avg((F.col("prediction") == F.col(label).cast("double")).cast("double"))
        return model.transform(test).agg(hit.alias("a")).first()["a"], took

    jobs = dict(zip(reversed(names), reversed([(p, f) for p in points for f in range(folds)])))  # the first of equal ones
    new = [n for n in dict.fromkeys(names) if n not in fitted]
    with ThreadPool(parallelism) as pool:
        fitted.update(zip(new, pool.map(one, [jobs[n] for n in new], chunksize=1)))
    done = [fitted[n] for n in names]
    trials = []
    for i, point in enumerate(points):
        part = done[i * folds : (i + 1) * folds]
        scores = [s for s, _ in part if s is not None]
        mean = sum(scores) / len(scores) if scores else 0.0
        spread = sum((s - mean) ** 2 for s in scores) / (len(scores) - 1) if len(scores) > 1 else 0.0
        trials.append({
            "params": point, "mean_test_score": mean, "std_error": math.sqrt(spread / len(scores)) if scores else 0.0,
            "mean_fit_time": sum(t for _, t in part) / len(part),
        })
    return trials


def cross_validate(
    df: DataFrame, features: Sequence[str], label: str, kind: str, points: Sequence[dict],
    folds: int, key: Sequence[str], seed: int = 42, parallelism: int = 4,
) -> list[dict]:
    """The trials of the given points."""
    data = fold_rows(df, features, label, folds, key, seed)
    return score_points(data, features, label, kind, points, folds, seed, parallelism)


def trial_table(trials: Sequence[dict], df: DataFrame) -> DataFrame:
    rows = [
        (json.dumps(t["params"], sort_keys=True), float(t["mean_test_score"]), float(t["mean_fit_time"]))
        for t in trials
    ]
    return df.sparkSession.createDataFrame(rows, "params string, mean_test_score double, mean_fit_time double")


def best_trial(trials: DataFrame) -> DataFrame:
    """The trial with the best score, the fastest one on ties."""
    return (
        trials.withColumn("mean_test_score", F.abs("mean_test_score"))
        .orderBy(F.desc("mean_test_score"), "mean_fit_time", "params").limit(1)
    )


def best_params(trials: Sequence[dict]) -> dict:
    return min(trials, key=lambda t: (-abs(t["mean_test_score"]), t["mean_fit_time"]))["params"]


def search_tree(
    df: DataFrame, features: Sequence[str], label: str, key: Sequence[str] = ("id",),
    space: Mapping[str, Sequence] = TREE_GRID, n_iter: int = 150, folds: int = 2,
    seed: int = 42, parallelism: int = 4,
) -> list[dict]:
    """Up to ``n_iter`` points of the grid, cross-validated by accuracy."""
    points = _sampled(grid(space), n_iter, seed)
    return cross_validate(df, features, label, "tree", points, folds, key, seed, parallelism)


def search_forest(
    df: DataFrame, features: Sequence[str], label: str, key: Sequence[str] = ("id",),
    space: Mapping[str, Sequence] = FOREST_GRID, factor: int = 2, folds: int = 7,
    seed: int = 42, parallelism: int = 2,
) -> list[dict]:
    """Successive halving: each round keeps the best 1/``factor`` of the points and gives them
    ``factor`` times the rows, the last round all of them. Samples are drawn by key hash."""
    points = grid(space)
    rounds = 1 + int(math.log(len(points), factor)) if len(points) > 1 else 1
    trials: list[dict] = []
    for r in range(rounds):
        share = round(10_000 / factor ** (rounds - 1 - r))
        sample = df.filter(hash_share(key, seed + 1) < share)
        done = cross_validate(sample, features, label, "forest", points, folds, key, seed, parallelism)
        trials += [{**t, "round": r} for t in done]
        done.sort(key=lambda t: -t["mean_test_score"])
        points = [t["params"] for t in done[: max(1, math.ceil(len(done) / factor))]]
    return trials


def final_round(trials: Sequence[dict]) -> list[dict]:
    last = max(t["round"] for t in trials)
    return [t for t in trials if t["round"] == last]


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
