import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from areapanel.operators import metrics as M
from areapanel.operators import models as ML
from areapanel.operators.neighbours import knn_score
from areapanel.plans import scoring

PREDICTORS = ["x1", "x2", "x3"]


@pytest.fixture(scope="module")
def separable(spark):
    rng = random.Random(2)
    rows = []
    for i in range(240):
        y = int(i % 4 == 0)
        rows.append((i, y, float(y ^ (rng.random() < 0.1)), rng.random() + y * 0.3, float(rng.randint(0, 1)), "train" if i % 3 else "test"))
    df = spark.createDataFrame(rows, "id int, label int, x1 double, x2 double, x3 double, role string").cache()
    return df.where("role = 'train'"), df.where("role = 'test'")


@pytest.mark.parametrize("name,params", [
    ("LR", {"C": 10, "penalty": "l2"}), ("RF", {"n_estimators": 10, "max_depth": 50}), ("DT", {"max_features": "sqrt", "max_depth": 5}),
    ("GB", {"n_estimators": 3, "max_depth": 2}), ("SVM", {"C": 1.0}), ("B", {"n_estimators": 5}), ("KNN", {"n_neighbors": 7})])
def test_models_beat_chance(separable, name, params):
    train, test = separable
    out = ML.run_model(train, test, name, params, PREDICTORS, ["id"])
    assert out.count() == test.count()
    assert M.roc_auc(out, "score", "label").first().auc_roc > 0.75
    if name != "SVM":
        assert out.where("score < 0 or score > 1").count() == 0


def test_grids_and_unknown_size():
    defaults, grid = ML.model_grid("test")
    assert set(grid) == set(defaults) and all(len(list(ML.grid_points(g))) == 1 for g in grid.values())
    points = list(ML.grid_points(ML.GRIDS["large"]["RF"]))
    # forests in batches are fitted as MLlib's deepest, once and under that name; others as deep as asked for
    assert len(points) == (3 * 6 + 2 * 5) * 2 * 3
    assert max(p["max_depth"] for p in points if p["n_estimators"] > ML.BATCH_TREES) == ML.MAX_TREE_DEPTH
    assert max(p["max_depth"] for p in points if p["n_estimators"] <= ML.BATCH_TREES) == 100
    with pytest.raises(KeyError):
        ML.model_grid("huge")


def test_importance_is_positive_and_ordered(separable):
    train, _ = separable
    for name, params in (("LR", {"C": 10, "penalty": "l2"}), ("RF", {"n_estimators": 5, "max_depth": 3})):
        model = ML.fit_model(train, name, params, PREDICTORS)
        got = [r.importance for r in ML.feature_importance(name, model, train, PREDICTORS).collect()]
        assert got == sorted(got, reverse=True) and all(v > 0 for v in got)
        if name == "LR":
            assert got[0] == 1.0
    assert ML.feature_importance("KNN", None, train, PREDICTORS).count() == 0


@pytest.mark.parametrize("weights", ["uniform", "distance"])
@pytest.mark.parametrize("blocks", [{}, {"broadcast_bytes": 0, "block_bytes": 16 * 24, "matrix_cells": 64}])
def test_neighbours_match_brute_force(spark, weights, blocks):
    """Whole-number vectors give many equal distances and duplicate rows."""
    rng = np.random.default_rng(4)
    train_x, train_y = rng.integers(0, 3, (90, 3)).astype(float), rng.integers(0, 2, 90)
    test_x = rng.integers(0, 4, (40, 3)).astype(float)
    train = spark.createDataFrame([(x.tolist(), int(y)) for x, y in zip(train_x, train_y)], "f array<double>, y int")
    test = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(test_x)], "id int, f array<double>")
    got = {r.id: r.score for r in knn_score(train, test, ["id"], "f", "y", k=5, weights=weights, **blocks).collect()}
    assert len(got) == 40
    for i, x in enumerate(test_x):
        d = np.sqrt(((train_x - x) ** 2).sum(axis=1))
        kth = np.sort(d)[4]
        near, tied = d < kth, d == kth
        share = np.where(near, 1.0, np.where(tied, (5 - near.sum()) / tied.sum(), 0.0))
        if weights == "distance":
            w = (d == 0).astype(float) if (share[d == 0] > 0).any() else 1 / np.where(d == 0, 1, d)
            share = share * w
        assert got[i] == pytest.approx((share * train_y).sum() / share.sum())


def test_grid_results_end_to_end(values):
    rng = random.Random(9)
    rows = [(f"t{i}", y, int(i % 5 == 0), float(i % 5 == 0) if rng.random() < 0.9 else 0.0, rng.random())
            for i in range(40) for y in (2010, 2011, 2012)]
    df = values(rows, "tract string, year int, label int, x1 double, x2 double")
    train = df.where("year < 2012").withColumn("role", F.lit("train"))
    test = df.where("year = 2012").withColumn("role", F.lit("test"))
    splits = train.unionByName(test).withColumn("split_date", F.lit("2012-01-01").cast("date"))
    grid = {"LR": {"C": [0.1, 10], "penalty": ["l2"]}, "KNN": {"n_neighbors": [3]}}
    scores = scoring.grid_scores(splits, ["LR", "KNN"], grid, ["x1", "x2"])
    assert scores.count() == 3 * 40
    results = scoring.grid_results(scores, splits)
    assert results.count() == 3
    row = results.first()
    assert (row.min_year_in_train, row.max_year_in_train, row.min_year_in_test) == (2010, 2011, 2012)
    assert results.where("auc_roc > 0.6 and random_baseline between 0.19 and 0.21").count() == 3


def test_production_flags_the_top_share(values):
    rng = random.Random(1)
    rows = [(f"t{i:03d}", y, rng.random() * 50, int(i % 10 == 0)) for i in range(60) for y in (2015, 2016, 2017)]
    df = values(rows, "tract string, year int, rate double, label int")
    light = {"LR": scoring.PRODUCTION["LR"], "RF": {"n_estimators": 3, "max_depth": 3}}
    out = scoring.production_score(df, 2017, models=light)
    sums = out.agg(F.count("*").alias("n"), F.sum("prediction_lr").alias("lr"), F.sum("prediction_rf").alias("rf")).first()
    assert (sums.n, sums.lr, sums.rf) == (60, 6, 6)


@pytest.mark.parametrize("name,params", [
    ("RF", {"n_estimators": 10, "max_depth": 4}), ("B", {"n_estimators": 5}), ("DT", {"max_depth": 4}),
    ("DT", {"max_depth": 4, "criterion": "entropy"}), ("DT", {"max_depth": 4, "criterion": "entropy", "max_features": "sqrt"})])
def test_trees_score_rare_labels(values, name, params):
    """No cell of the predictors has a majority of positives, and the scores still tell the cells apart."""
    rows = [(i, float(i // 400 % 2), float(i // 800 % 2), int(i % 400 < (10, 30, 50, 70)[i // 400 % 4])) for i in range(1600)]
    df = values(rows, "id int, x1 double, x2 double, label int")
    out = ML.run_model(df, df, name, params, ["x1", "x2"], ["id"])
    shares = {r.c: r.s for r in out.groupBy(F.concat("x1", "x2").alias("c")).agg(F.round(F.avg("score"), 2).alias("s")).collect()}
    assert len(set(shares.values())) > 1
    if name == "DT" and "max_features" not in params:
        # by entropy, leaves on the same side of the overall share are one
        expected = [0.05, 0.05, 0.15, 0.15] if "criterion" in params else [0.03, 0.08, 0.13, 0.18]
        assert sorted(shares.values()) == pytest.approx(expected, abs=0.01)
    model = ML.fit_model(df, name, params, ["x1", "x2"])
    assert ML.feature_importance(name, model, df, ["x1", "x2"]).count() > 0


def test_neighbours_of_equal_real_vectors_take_all(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(50, 64)) * 10
    train = spark.createDataFrame([(v.tolist(), i % 2) for i, v in enumerate(x)], "f array<double>, y int")
    test = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, f array<double>")
    whole, parts = ({r.id: r.score for r in knn_score(train, test, ["id"], "f", "y", k=3, weights="distance", **o).collect()}
                    for o in ({}, {"broadcast_bytes": 0, "block_bytes": 64 * 8 * 7}))
    assert whole == parts == {i: float(i % 2) for i in range(50)}


def test_large_forests_are_fitted_in_batches(separable, monkeypatch):
    """No fit has more than a batch of trees, and the score is the mean over all of them."""
    train, test = separable
    fits, whole = [], ML.estimator

    def kept(name, params, n, label="label", seed=ML.SEED):
        fits.append((seed, params["n_estimators"]))
        return whole(name, params, n, label, seed)
    monkeypatch.setattr(ML, "estimator", kept)
    params = {"n_estimators": 230, "max_depth": 4, "max_features": "log2"}
    got = {r.id: r.score for r in ML.run_model(train, test, "RF", params, PREDICTORS, ["id"]).collect()}
    assert sorted(n for _, n in fits) == [30, 100, 100] and len({s for s, _ in fits}) == 3
    sums = dict.fromkeys(got, 0.0)
    packed = ML.assemble(train.withColumn("label", F.col("label").cast("double")), PREDICTORS).coalesce(1)
    for seed, trees in sorted(fits):
        model = whole("RF", {**params, "n_estimators": trees}, train.count(), seed=seed).fit(packed)
        for r in ML.scored("RF", model, ML.assemble(test, PREDICTORS)).collect():
            sums[r.id] += r.score * trees
    assert got == pytest.approx({i: v / 230 for i, v in sums.items()})
    by_cell = {}
    for r in ML.run_model(train, test, "RF", params, PREDICTORS[:1], ["id"]).collect():
        by_cell.setdefault(r.x1, set()).add(r.score)
    assert all(len(v) == 1 for v in by_cell.values())


def test_production_query_fits_the_production_models(monkeypatch, values):
    from areapanel.catalog import learning
    calls = []
    monkeypatch.setattr(learning, "labelled_panel", lambda spark, folder: values([("a", 2000, 1)], "tract string, year int, label_prev_year int"))
    monkeypatch.setattr(learning.scoring, "production_score", lambda df, year, **other: calls.append((year, other)))
    learning.production_score(None, "")
    assert calls == [(learning.TEST_YEAR, {})]
    assert scoring.PRODUCTION["RF"]["n_estimators"] == 10000


@pytest.mark.parametrize("name", ["RF", "B"])
def test_entropy_forests_have_all_their_trees(separable, name):
    train, test = separable
    params = {"n_estimators": 7, "max_depth": 4, "criterion": "entropy"}
    assert ML.fit_model(train, name, params, PREDICTORS).getNumTrees == 7
    fit = ML.estimator(name, params, 10)
    assert fit.getBootstrap() and fit.getFeatureSubsetStrategy() == ("all" if name == "B" else "sqrt")
    out = ML.run_model(train, test, name, params, PREDICTORS, ["id"])
    assert M.roc_auc(out, "score", "label").first().auc_roc > 0.75


def test_large_forests_over_few_vectors_follow_the_law_of_mllib(values, monkeypatch):
    """Eight vectors of many rows: no fit over the rows, and the scores are those of MLlib's batches but for the draws."""
    rng = random.Random(3)
    rows = [(i, *[float(v) for v in x], int(rng.random() < 0.1 + 0.2 * x[0] + 0.3 * x[1] * x[2])) for i in range(1200) for x in [(i % 2, i // 2 % 2, i // 4 % 3 % 2)]]
    df = values(rows, "id int, x1 double, x2 double, x3 double, label int")
    params = {"n_estimators": 300, "max_depth": 50, "max_features": "log2", "min_samples_split": 10}
    slow = ML.score_in_batches(df, df, "RF", params, PREDICTORS)
    expected = {r[:3]: r[3] for r in slow.select(*PREDICTORS, "score").distinct().collect()}
    monkeypatch.setattr(ML, "score_in_batches", None)
    got = {r[:3]: r[3] for r in ML.run_model(df, df, "RF", params, PREDICTORS, ["id"]).select(*PREDICTORS, "score").distinct().collect()}
    assert got.keys() == expected.keys() and len(got) == 8
    assert all(abs(got[x] - expected[x]) < 0.01 for x in got)
    mixed = df.withColumn("x1", F.col("x1") * 2)
    assert ML.score_few_vectors(mixed, mixed, "RF", params, PREDICTORS) is None
