"""Components, imputation, trees, search, cascade."""

import os

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from termloom.operators import components, models
from termloom.operators.cascade import Stage, fit_cascade, load_cascade, save_cascade, score_cascade
from termloom.operators.components import (
    Components, CountComponents, fit_components, fit_count_components,
)
from termloom.operators.encode import encode_labels, fit_labels
from termloom.operators.impute import Chain, fit_class_chain, fit_linear_chain
from termloom.session import checkpoint_dir
from tests.conftest import collect


def test_components_match_svd(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5)) @ np.diag([5, 3, 1, 0.5, 0.1]) + 7
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    df = df.withColumn("f", array_to_vector("v"))
    fitted = fit_components(df, "f", 3)
    fitted.save(str(tmp_path / "c"), df)
    out = Components.load(str(tmp_path / "c"), df).transform(df).orderBy("id").collect()
    scores = np.array([[r[f"pca_{i}"] for i in range(3)] for r in out])
    centred = x - x.mean(axis=0)
    u, s, vt = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(np.abs(scores), np.abs(centred @ vt[:3].T))
    assert np.allclose(scores.mean(axis=0), 0, atol=1e-9)
    assert np.allclose(fitted.explained, (s**2 / (s**2).sum())[:3])


def test_more_components_than_dimensions(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 1.0],), ([0.0, 0.0],)], "v array<double>")
    assert fit_components(df.withColumn("f", array_to_vector("v")), "f", 125).size == 2


def test_count_components_match_svd(spark, tmp_path):
    rng = np.random.default_rng(4)
    matrix = rng.poisson(0.6, (50, 12))
    matrix[7] = 0  # an entity without any course is a row of zeros
    rows = [(i, f"c{j}", int(n)) for i, r in enumerate(matrix) for j, n in enumerate(r) if n]
    counts = spark.createDataFrame([*rows, (999, "other", 5)], "id long, token string, n long")
    keys = spark.range(50)
    fitted = fit_count_components(keys, counts, 4)
    fitted.save(str(tmp_path / "cc"))
    extra = counts.union(spark.createDataFrame([(3, "never seen", 2)], "id long, token string, n long"))
    out = CountComponents.load(str(tmp_path / "cc"), spark).transform(keys, extra).orderBy("id").collect()
    scores = np.array([[r[n] for n in fitted.names()] for r in out])
    centred = matrix - matrix.mean(axis=0)
    s = np.linalg.svd(centred, compute_uv=False)
    vt = np.linalg.svd(centred, full_matrices=False)[2]
    assert np.allclose(np.abs(scores), np.abs(centred @ vt[:4].T))
    assert np.allclose(fitted.explained, (s**2 / (s**2).sum())[:4])


def test_more_tokens_than_the_basis_has_columns(spark):
    rng = np.random.default_rng(4)
    rates = np.outer(rng.random(80) * 8, rng.random(60)) + np.outer(rng.random(80) * 4, rng.random(60))
    matrix = rng.poisson(rates)
    cells = [(i, f"t{j}", int(n)) for (i, j), n in np.ndenumerate(matrix) if n]
    keys = spark.range(80)
    fitted = fit_count_components(keys, spark.createDataFrame(cells, "id long, token string, n long"), 3, tol=1e-6, rounds=12)
    s = np.linalg.svd(matrix - matrix.mean(axis=0), compute_uv=False)
    assert np.allclose(fitted.explained, (s**2 / (s**2).sum())[:3], rtol=1e-3)
    nothing = fit_count_components(keys, spark.createDataFrame([], "id long, token string, n long"), 3)
    assert nothing.names() == []


def test_components_on_a_slowly_falling_spectrum(spark):
    rng = np.random.default_rng(7)
    rates = sum(np.outer(rng.random(150), rng.random(110)) * 3 / (1 + 0.15 * i) for i in range(30))
    matrix = rng.poisson(rates / 6)
    cells = [(i, f"t{j}", int(n)) for (i, j), n in np.ndenumerate(matrix) if n]
    counts = spark.createDataFrame(cells, "id long, token string, n long")
    off = matrix - matrix.mean(axis=0)
    s = np.linalg.svd(off, compute_uv=False) ** 2
    for blocks in (4, 2):  # without and with starting again
        fitted = fit_count_components(spark.range(150), counts, 4, extra=4, rounds=30, tol=1e-4, blocks=blocks, strict=True)
        assert fitted.converged and max(fitted.residuals) <= 1e-4
        assert np.allclose(fitted.explained, (s / s.sum())[:4], rtol=1e-6)
        loads = {r["token"]: r["weights"] for r in fitted.loadings.collect()}
        v = np.array([loads.get(f"t{j}", [0.0] * 4) for j in range(110)])
        c = off.T @ off / 149
        found = np.linalg.norm(c @ v - v * (s[:4] / 149), axis=0) / (s[0] / 149)
        assert found.max() < 3e-4  # the residuals it reports are real
    short = fit_count_components(spark.range(150), counts, 4, extra=4, rounds=1)
    assert not short.converged and max(short.residuals) > 1e-3
    with pytest.raises(RuntimeError, match="not converged"):
        fit_count_components(spark.range(150), counts, 4, extra=4, rounds=1, strict=True)


def test_components_in_groups_leave_one_table(spark, monkeypatch):
    rng = np.random.default_rng(5)
    matrix = rng.poisson(np.outer(rng.random(50) * 4, rng.random(40)))
    cells = [(i, f"t{j}", int(n)) for (i, j), n in np.ndenumerate(matrix) if n]
    counts = spark.createDataFrame([*cells, (None, "t1", 1)], "id long, token string, n long")
    for name, size in (("GROUP_ROWS", 16), ("LEAST_ROWS", 1), ("CELLS", 70), ("LAYERS", 2)):
        monkeypatch.setattr(components, name, size)
    rows = components._group_rows(50)
    by_token = components._cells(
        spark.createDataFrame(cells, "e long, token string, n long")
        .select("e", F.substring("token", 2, 9).cast("long").alias("t"), F.col("n").cast("double").alias("n")), "t", "e", rows
    )
    assert by_token.count() == len({(t, e // rows) for e, t, _ in cells}) < len(cells)  # vectors that travel
    at = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(at))
    fitted = fit_count_components(spark.range(50), counts, 3, extra=17, rounds=8, tol=1e-6)
    assert len(set(os.listdir(at)) - before) == 1  # the loadings; the tables of the rounds have gone
    s = np.linalg.svd(matrix - matrix.mean(axis=0), compute_uv=False) ** 2
    assert np.allclose(fitted.explained, (s / s.sum())[:3], rtol=1e-6)
    v = {r["token"]: r["weights"] for r in fitted.loadings.collect()}
    v = np.array([v.get(f"t{j}", [0.0] * 3) for j in range(40)])
    assert np.allclose(np.linalg.norm(v, axis=0), 1, atol=1e-8)


def test_encoder_gives_unseen_and_null_the_next_code(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c")], "id long, v string")
    table = fit_labels(df, "v")
    more = spark.createDataFrame([(1, "b"), (2, None), (3, "zz")], "id long, v string")
    assert collect(encode_labels(more, "v", table, "code").select("id", "code"), "id") == [(1, 1), (2, 3), (3, 3)]
    assert collect(encode_labels(more, "v", table, "code", offset=1).select("id", "code"), "id") == [(1, 2), (2, 4), (3, 4)]


def test_linear_chain(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.random((80, 2))
    a = 100 + 50 * x[:, 0] + 20 * x[:, 1] + rng.normal(0, 3, 80)
    b = 3 * a + 10 * x[:, 1] + rng.normal(0, 3, 80)
    rows = [
        (i, *map(float, x[i]), None if i % 4 == 0 else float(a[i]), None if i % 5 == 0 else float(b[i])) for i in range(80)
    ]
    df = spark.createDataFrame(rows, "id long, x1 double, x2 double, a double, b double")
    chain = fit_linear_chain(df, ["a", "b"], ["x1", "x2"])
    chain.save(str(tmp_path / "lin"), spark)
    got = collect(Chain.load(str(tmp_path / "lin"), spark).apply(df).select("id", "a", "b"), "id")

    def fill(target, features):
        known = ~np.isnan(target)
        design = np.column_stack([np.ones(len(target)), *features])
        coef = np.linalg.lstsq(design[known], target[known], rcond=None)[0]
        return np.trunc(np.where(known, target, design @ coef))

    gap_a = np.array([np.nan if r[3] is None else r[3] for r in rows])
    gap_b = np.array([np.nan if r[4] is None else r[4] for r in rows])
    full_a = fill(gap_a, [x[:, 0], x[:, 1]])
    full_b = fill(gap_b, [x[:, 0], x[:, 1], full_a])
    assert [g[1:] for g in got] == [(int(p), int(q)) for p, q in zip(full_a, full_b)]


def test_class_chain(spark, tmp_path):
    rows = [(i, float(i % 2), None if i % 7 == 0 else (3 if i % 2 else 12), 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x double, c1 int, c2 int")
    fit_class_chain(df.withColumn("c3", F.lit(None).cast("int")), ["c1", "c3", "c2"], [["x"]] * 3).save(str(tmp_path / "c"), spark)
    chain = Chain.load(str(tmp_path / "c"), spark)
    assert chain.targets == ["c1", "c3", "c2"] and chain.models[1] is None
    # complete in training, with gaps in the scored rows
    gappy = df.withColumns({"c2": F.when(F.col("id") > 9, F.col("c2")), "c3": F.lit(None).cast("int")})
    got = chain.apply(gappy, only_where_null=True).collect()
    assert all(r["c1"] == (3 if r["id"] % 2 else 12) and r["c2"] == 3 and r["c3"] is None for r in got)
    single = fit_class_chain(df.withColumn("c2", F.when(F.col("id") > 5, F.col("c2"))), ["c2"], [["x"]])
    assert {r["c2"] for r in single.apply(df.withColumn("c2", F.lit(None).cast("int"))).collect()} == {3}


def test_evaluation_with_a_class_never_predicted(spark):
    y, p = [0, 0, 1, 1, 2, 2], [0, 0, 1, 0, 1, 1]
    df = spark.createDataFrame(list(zip(y, p)), "y int, p int")
    row = models.evaluate(df, "y", "p").first()
    precision = [2 / 3, 1 / 3, 0]
    recall = [1, 1 / 2, 0]
    f1 = [0.8, 0.4, 0]
    assert row["accuracy"] == pytest.approx(0.5)
    assert row["precision"] == pytest.approx(np.mean(precision))
    assert row["recall"] == pytest.approx(np.mean(recall))
    assert row["f1_score"] == pytest.approx(np.mean(f1))


def people(spark, n=400):
    rng = np.random.default_rng(8)
    rows = [(i, float(a), float(b), int(a > 0.6), int(b > 0.5), int(a + b > 1)) for i, (a, b) in enumerate(rng.random((n, 2)))]
    return spark.createDataFrame(rows, "id long, a double, b double, y1 int, y2 int, y3 int")


def test_fit_save_refit(spark, tmp_path):
    df = people(spark)
    model = models.fit_classifier(df, ["a", "b"], "y1", "tree", maxDepth=3, minInstancesPerNode=4, impurity="entropy")
    path = models.save_model(model, str(tmp_path / "m"))
    loaded = models.load_model(path)
    params = models.learner_params(loaded)
    assert (params["maxDepth"], params["minInstancesPerNode"], params["impurity"]) == (3, 4, "entropy")
    again = models.refit(loaded, df.withColumnRenamed("a", "score"), "y1", {"a": "score"})
    assert models.feature_names(again) == ["score", "b"]
    one = collect(models.score(model, df, "p", "r").select("id", "p", "r"), "id")
    two = collect(models.score(again, df.withColumnRenamed("a", "score"), "p", "r").select("id", "p", "r"), "id")
    assert one == two
    top = models.importances(model, df, 1).first()
    assert top["feature"] == "a" and top["importance"] > 0.9


def test_forests_keep_node_ids_and_use_several_tasks(spark):
    df = people(spark)
    for kind in ("tree", "forest"):
        model = models.fit_classifier(df, ["a", "b"], "y1", kind, maxDepth=2)
        assert model.stages[-1].getCacheNodeIds() == (kind == "forest") and "cacheNodeIds" not in models.learner_params(model)
    many = spark.range(0, 2 * models.FOREST_ROWS + 1, 1, 1)
    assert models._dealt(many).rdd.getNumPartitions() == 3 and models._dealt(many).count() == many.count()
    assert models._dealt(many.limit(10)).rdd.getNumPartitions() == 1


def test_searches(spark):
    df = people(spark)
    space = {"maxDepth": [1, 4], "impurity": ["gini"]}
    trials = models.search_tree(df, ["a", "b"], "y3", space=space)
    assert models.best_params(trials)["maxDepth"] == 4
    best = models.best_trial(models.trial_table(trials, df)).first()
    assert '"maxDepth": 4' in best["params"]
    halved = models.search_forest(df, ["a", "b"], "y3", space={"numTrees": [3, 5], "maxDepth": [1, 4]}, folds=2)
    assert [sum(t["round"] == r for t in halved) for r in range(3)] == [4, 2, 1]
    assert models.best_params(models.final_round(halved))["maxDepth"] == 4


def test_grid_is_sampled_without_repetition():
    points = models._sampled(models.grid(models.TREE_GRID), 150, 1)
    assert len(points) == 128
    few = models._sampled(models.grid(models.TREE_GRID), 10, 1)
    assert len({str(p) for p in few}) == 10


def test_cascade_is_keyed_by_id(spark, tmp_path):
    df = people(spark)
    params = {"maxDepth": 3}
    stages = [
        Stage("year1", ["a"], "y1", params=params), Stage("year2", ["b"], "y2", balanced=True, params=params),
        Stage("year3", ["a", "b"], "y3", params=params),
    ]
    data = [df, df.filter("id % 2 = 0"), df.filter("id % 4 = 0")]
    fitted, metrics = fit_cascade(stages, data)
    assert models.feature_names(fitted[1]) == ["b", "prob_year1"]
    accuracy = [m.first()["accuracy"] for m in metrics]
    assert min(accuracy[:2]) > 0.9, accuracy  # one-threshold targets
    assert accuracy[2] > 0.6, accuracy  # a slanted border from about 75 rows
    save_cascade(fitted, stages, str(tmp_path / "c"))
    loaded = load_cascade(stages, str(tmp_path / "c"))
    entities = df.select("id")
    out = score_cascade(loaded, stages, data, entities)
    mixed = score_cascade(loaded, stages, [d.orderBy(F.rand(3)).repartition(6) for d in data], entities.orderBy(F.rand(4)))
    assert collect(out, "id") == collect(mixed, "id")
    assert out.count() == 400
    assert out.filter("prob_year3 IS NOT NULL").count() == 100
    assert out.filter("id % 2 = 1 AND prob_year2 IS NOT NULL").count() == 0


def test_cascade_query(spark, sf_dir):
    import __spark_entry__ as entry

    scored = entry.queries()["l_score_active"](spark, sf_dir).collect()
    assert scored and all(0 <= r["prob_year1"] <= 1 for r in scored)
    assert len({r["id"] for r in scored}) == len(scored)
