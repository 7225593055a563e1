"""The table of a grid's models: every kind of model, hot labels, and importances against those computed from the models themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from areapanel.operators import trees as T
from areapanel.operators.linear import fit_linear
from areapanel.plans import grid_models as G

GRID = {"LR": {"C": [1.0], "penalty": ["l2"]}, "SVM": {"C": [0.1], "penalty": ["l2"]}, "DT": {"max_depth": [3], "criterion": ["entropy"]},
        "GB": {"n_estimators": [2], "max_depth": [2]}, "KNN": {"n_neighbors": [3]}}
NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def featured(spark):
    rng = np.random.default_rng(4)
    rows = []
    for day in ("2001-01-01", "2002-01-01"):
        for i in range(300):
            a, b, c = (int(v) for v in rng.integers(0, 2, 3))
            rows.append((day, "train" if i % 4 else "test", i, 2000, a, b, c, int(a and (b or rng.random() < 0.2))))
    return spark.createDataFrame(rows, "split_date string, role string, tract int, year int, a int, b int, c int, label int").cache()


@pytest.fixture(scope="module")
def models(featured):
    return G.grid_models(featured, GRID, NAMES).cache()


def test_every_point_of_every_split_is_in_the_table(models):
    kinds = {(r.model_type, r.split_date): r.kinds for r in models.groupBy("model_type", "split_date").agg(F.collect_set("kind").alias("kinds")).collect()}
    assert {m for m, _ in kinds} == {"LR", "SVM", "DT", "GB"} and len(kinds) == 8
    assert kinds["DT", "2001-01-01"] == ["node"] and kinds["LR", "2002-01-01"] == ["weight"]


def test_importances_equal_those_of_the_models(featured, models):
    got = {(r.model_type, r.split_date, r.feature): r.importance for r in G.grid_importance(models).collect()}
    train = featured.where("role = 'train' and split_date = '2001-01-01'")
    tree = T.grow(train, NAMES, keys=["tract", "year"], criterion="entropy", max_depth=3)
    for r in T.importances(tree).collect():
        assert got["DT", "2001-01-01", r.feature] == pytest.approx(r.importance)
    line = fit_linear(train, NAMES, "label", "logistic", "l2", 1.0)
    x = np.array(train.select(*NAMES).collect(), dtype=float)
    size = np.abs(line.weights[:3]) * x.std(axis=0)
    for name, v in zip(NAMES, size / size.max()):
        assert got["LR", "2001-01-01", name] == pytest.approx(v)
    assert sum(v for (m, d, _), v in got.items() if m == "GB" and d == "2002-01-01") == pytest.approx(1)


def test_top_keeps_the_largest_and_ties_go_to_the_first_name(spark):
    rows = [("SVM", "{}", "d", "weight", f, w, 1.0) for f, w in (("z", 2.0), ("y", -2.0), ("x", 1.0), ("none", 0.0))]
    df = spark.createDataFrame(rows, "model_type string, parameters string, split_date string, kind string, feature string, weight double, deviation double")
    blank = df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (p.split() for p in G.ROW.split(", ")) if c not in df.columns])
    assert [(r.feature, r.importance) for r in G.grid_importance(blank, 2).orderBy("feature").collect()] == [("y", 2.0), ("z", 2.0)]
    assert {r.feature for r in G.grid_importance(blank).collect()} == {"x", "y", "z"}


def test_without_training_rows_there_is_no_model(featured):
    assert G.model_rows(featured.limit(0), "DT", {}, NAMES, ["tract", "year"]).count() == 0
    with pytest.raises(ValueError):
        G.model_rows(featured, "XX", {}, NAMES, ["tract", "year"])


def test_all_trees_of_a_grid_grow_from_rows_collapsed_once(featured, monkeypatch):
    """Sums are taken once with draws and once without, whatever the points and splits; each tree is the one `grow` gives alone."""
    wide = featured.withColumn("d", F.expr("pmod(tract * 7, 11) + if(split_date = '2002-01-01', 100, 0)"))
    grid = {"DT": {"max_depth": [2, 3], "criterion": ["gini", "entropy"]}, "B": {"n_estimators": [2], "criterion": ["entropy"], "max_depth": [2]},
            "RF": {"n_estimators": [3, 9], "max_features": ["log2"], "max_depth": [3]}}
    names, calls, collapsed = [*NAMES, "d"], [], T.collapsed
    monkeypatch.setattr(T, "collapsed", lambda *args, **how: calls.append(1) or collapsed(*args, **how))
    models = G.grid_models(wide, grid, names).cache()
    assert models.select(*G.POINT).distinct().count() == 14
    assert len(calls) == 2
    for day, name, params in (("2001-01-01", "RF", {"n_estimators": 9, "max_features": "log2", "max_depth": 3}),
                              ("2002-01-01", "RF", {"n_estimators": 3, "max_features": "log2", "max_depth": 3}),
                              ("2002-01-01", "DT", {"max_depth": 3, "criterion": "entropy"})):
        train = wide.where((F.col("role") == "train") & (F.col("split_date") == day))
        alone = G.model_rows(train, name, params, names, ["tract", "year"])
        own = models.where((F.col("split_date") == day) & (F.col("model_type") == name) & (F.col("parameters") == G.ML.params_text(params)))
        columns = ["tree", "path", "depth", "n", "w", "p", "feature", "gain"]
        assert sorted(map(str, own.select(columns).collect())) == sorted(map(str, alone.select(columns).collect()))
