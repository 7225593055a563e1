import random

import pytest
from pyspark.sql import functions as F

from areapanel.operators import metrics as M


@pytest.fixture(scope="module")
def runs(spark):
    rng = random.Random(11)
    rows = [(m, i, round(rng.random(), 1), int(rng.random() < 0.3)) for m in ("a", "b") for i in range(137)]
    return spark.createDataFrame(rows, "model string, id int, score double, label int"), rows


def by_hand(rows, model, k):
    own = sorted([r for r in rows if r[0] == model], key=lambda r: (-r[2], r[1]))
    m = int(len(own) * (k / 100.0))
    tp, pos = sum(r[3] for r in own[:m]), sum(r[3] for r in own)
    p = tp / m if m else 0.0
    r = tp / pos if pos else 0.0
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def test_metrics_at_every_k(runs):
    df, rows = runs
    for r in M.at_k(df, "score", "label", ["id"], ["model"], ks=(0.5, 1, 10, 50, 100)).collect():
        assert (r.precision, r.recall, r.f1) == pytest.approx(by_hand(rows, r.model, r.k))


def test_grid_has_one_row_per_run(runs):
    df, rows = runs
    grid = M.metrics_grid(df, "score", "label", ["id"], ["model"])
    assert grid.count() == 2 and {"p_at_1", "f1_at_50", "recall_at_10", "auc_roc", "random_baseline"} <= set(grid.columns)
    base = {r.model: r.random_baseline for r in grid.collect()}
    full = {r.model: r.precision for r in M.at_k(df, "score", "label", ["id"], ["model"], ks=(100,)).collect()}
    assert base == pytest.approx(full)


def test_auc_counts_pairs_and_mirrors(runs):
    df, rows = runs
    got = {r.model: r.auc_roc for r in M.roc_auc(df, "score", "label", ["model"]).collect()}
    for model, value in got.items():
        pos = [r[2] for r in rows if r[0] == model and r[3]]
        neg = [r[2] for r in rows if r[0] == model and not r[3]]
        wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
        assert value == pytest.approx(wins / (len(pos) * len(neg)))
    flipped = {r.model: r.auc_roc for r in M.roc_auc(df.withColumn("score", -F.col("score")), "score", "label", ["model"]).collect()}
    assert all(got[m] + flipped[m] == pytest.approx(1.0) for m in got)
    assert M.roc_auc(df.where("label = 1"), "score", "label", ["model"]).first().auc_roc is None


def test_curve_stops_at_full_recall(values):
    df = values([(4.0, 1), (3.0, 0), (2.0, 1), (1.0, 0)], "s double, y int")
    got = sorted((r.threshold, r.precision, r.recall, r.pct_population) for r in M.pr_curve(df, "s", "y").collect())
    assert got == [(2.0, pytest.approx(2 / 3), 1.0, 0.75), (3.0, 0.5, 0.5, 0.5), (4.0, 1.0, 0.5, 0.25)]


def test_bias_rates_and_minimum_size(values):
    df = values([("x", 1, 1), ("x", 1, 0), ("x", 0, 1), ("x", 0, 0), ("y", 0, 0), (None, 1, 1)], "a string, f int, y int")
    got = {r.attribute_value: r for r in M.bias_crosstab(df, "f", "y", ["a"]).collect()}
    assert (got["x"].fnr, got["x"]["for"], got["x"].fdr, got["x"].tpr, got["x"].tnr) == (0.5,) * 5
    assert got["y"].fnr is None and got["y"].tnr == 1.0 and len(got) == 2
    assert M.bias_crosstab(df, "f", "y", ["a"], min_group_size=2).count() == 1


def test_persistence_baseline_denominator(values):
    df = values([(2010, 1, 1), (2010, 1, 0), (2010, 1, 1), (2011, 0, 1)], "year int, label int, label_prev_year int")
    got = {r.year: r.correct_with_baseline for r in M.persistence_baseline(df, 804).collect()}
    assert got == {2010: 2 / 80, 2011: 0.0}


def test_leaderboard_adds_both_baselines(values):
    results = values([("RF", "2013-01-01", 0.5, 0.1), ("RF", "2013-01-01", 0.7, 0.1), ("LR", "2014-01-01", None, 0.2)],
                     "model_type string, split_date string, p_at_10 double, random_baseline double")
    base = values([("2013-01-01", 0.4), ("2017-01-01", 0.9)], "split_date string, p_at_10 double")
    got = {(r.model_type, r.split_date): r.p_at_10 for r in M.leaderboard(results, base, split_dates=["2013-01-01"]).collect()}
    assert got == pytest.approx({("RF", "2013-01-01"): 0.7, ("LR", "2014-01-01"): 0.0, ("Baseline", "2013-01-01"): 0.4,
                                 ("Random Baseline", "2013-01-01"): 0.1, ("Random Baseline", "2014-01-01"): 0.2})


def test_histogram_bounds_hold_and_shrink(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("run"), F.rand(4).alias("s"), "id") \
        .select("run", "s", (F.col("s") + F.rand(9) > 1).cast("int").alias("y"))
    df = df.union(df.sparkSession.createDataFrame([("hot", None, 1), ("cold", float("nan"), 0)], "run string, s double, y int")).cache()
    exact = {r.run: r.auc_roc for r in M.roc_auc(df.where("s is not null and not isnan(s)"), "s", "y", ["run"]).collect()}
    gap = []
    for bins in (4, 50, 1000):
        histogram = M.score_histogram(df, "s", "y", ["run"], bins)
        assert histogram.groupBy("run").count().agg(F.max("count")).first()[0] <= bins
        for r in M.auc_bounds(histogram, ["run"]).collect():
            assert r.auc_low - 1e-12 <= exact[r.run] <= r.auc_high + 1e-12
            gap.append(r.auc_high - r.auc_low)
    assert gap[0] > gap[2] > gap[4] and gap[4] < 0.002
    points = M.bounded_curve(M.score_histogram(df, "s", "y", ["run"], 50), ["run"]).collect()
    rows = [r for r in df.where("s is not null and not isnan(s)").collect()]
    for p in points:
        above = [r.y for r in rows if r.run == p.run and r.s >= p.threshold - 1e-12]
        assert p.precision == pytest.approx(sum(above) / len(above))


def test_histogram_of_one_score_infinite_scores_and_no_rows(values):
    same = M.score_histogram(values([(2.0, 1), (2.0, 0)], "s double, y int"), "s", "y", bins=10)
    assert [(r.bin, r.n, r.pos) for r in same.collect()] == [(9, 2, 1)]
    far = M.score_histogram(values([(float("inf"), 1), (float("-inf"), 0), (0.0, 1), (1.0, 1)], "s double, y int"), "s", "y", bins=4)
    assert {(r.bin, r.n) for r in far.collect()} == {(0, 2), (3, 2)}
    assert M.auc_bounds(M.score_histogram(values([], "s double, y int"), "s", "y"), []).where("auc_low is not null").count() == 0


def test_best_points_keep_ties_and_skip_missing(values):
    df = values([("a", "p1", 0.5, None), ("b", "p2", 0.5, 0.2), ("c", "p3", 0.1, 0.9)], "model string, parameters string, f1 double, auc double")
    got = {tuple(r) for r in M.best_points(df, ["f1", "auc"], ["model", "parameters"]).collect()}
    assert got == {("f1", 0.5, "a", "p1"), ("f1", 0.5, "b", "p2"), ("auc", 0.9, "c", "p3")}
