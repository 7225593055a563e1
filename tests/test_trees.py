"""Table trees against a small recursive version."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from areapanel.operators import models as ML
from areapanel.operators import trees as T


def impurity(p, w, criterion):
    q = p / w
    if criterion == "gini":
        return 2 * q * (1 - q)
    return 0.0 if q in (0, 1) else -(q * math.log2(q) + (1 - q) * math.log2(1 - q))


def brute(bins, y, criterion, max_depth=None, min_split=2, depth=0, path=""):
    """{path: (n, p, feature, bin)} by plain recursion."""
    n, p = len(y), int(y.sum())
    best = None
    if (max_depth is None or depth < max_depth) and n >= min_split and 0 < p < n:
        for f in range(bins.shape[1]):
            for b in sorted(set(bins[:, f]))[:-1]:
                left = bins[:, f] <= b
                gain = impurity(p, n, criterion) - sum(m.sum() / n * impurity(y[m].sum(), m.sum(), criterion) for m in (left, ~left))
                if best is None or round(gain, 9) > best[0]:
                    best = (round(gain, 9), f, b)
    out = {path: (n, p, *(best[1:] if best else (None, None)))}
    if best:
        left = bins[:, best[1]] <= best[2]
        for side, m in (("L", left), ("R", ~left)):
            out |= brute(bins[m], y[m], criterion, max_depth, min_split, depth + 1, path + side)
    return out


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.integers(0, 2, 300), rng.integers(0, 6, 300), rng.integers(0, 2, 300)])
    y = ((x[:, 0] + (x[:, 1] > 3) + rng.random(300)) > 1.6).astype(int)
    df = spark.createDataFrame([(i, int(t), *map(float, v)) for i, (t, v) in enumerate(zip(y, x))], "id int, label int, a double, b double, c double")
    return df, x, y


@pytest.mark.parametrize("how", [{"criterion": "entropy"}, {"criterion": "gini", "max_depth": 3}, {"criterion": "entropy", "min_samples_split": 40}])
def test_tree_equals_recursion(rows, how):
    df, x, y = rows
    model = T.grow(df, ["a", "b", "c"], **how)
    got = {r.path: (r.n, r.p, r.feature, r.bin) for r in model.nodes.collect()}
    assert got == brute(x, y, how["criterion"], how.get("max_depth"), how.get("min_samples_split", 2))
    scored = {r.id: r.score for r in T.score(model, df).collect()}
    for i, v in enumerate(x):
        path = ""
        while got[path][2] is not None:
            path += "L" if v[got[path][2]] <= got[path][3] else "R"
        assert scored[i] == pytest.approx(got[path][1] / got[path][0])


def test_depth_is_not_bounded(spark):
    """Each value of one column has its own label by turns, so a tree of two-way splits on 33 columns of a staircase goes 33 deep."""
    n = 33
    data = [(i, i % 2, *[float(i > j) for j in range(n)]) for i in range(n + 1)]
    df = spark.createDataFrame(data, "id int, label int, " + ", ".join(f"x{j} double" for j in range(n)))
    columns = [f"x{j}" for j in range(n)]
    nodes = T.grow(df, columns).nodes.where("feature is null").collect()
    assert len(nodes) == n + 1 and {r.share for r in nodes} == {0.0, 1.0}
    assert ML.run_model(df, df, "DT", {"max_depth": 100}, columns, ["id"]).where("abs(score - label) > 1e-12").count() == 0


def test_forest_draws_do_not_depend_on_partitions(rows):
    df, _, _ = rows
    how = {"trees": 3, "max_features": "sqrt", "bootstrap": True, "keys": ["id"]}
    models = [T.grow(d, ["a", "b", "c"], **how) for d in (df, df.repartition(3))]
    a, b = (sorted(map(str, m.nodes.collect())) for m in models)
    assert a == b
    weights = models[0].nodes.where("depth = 0").collect()
    assert all(200 < r.w < 400 and 150 < r.n < 230 for r in weights)
    shares = T.importances(models[0]).collect()
    assert sum(r.importance for r in shares) == pytest.approx(1.0) and max(shares, key=lambda r: r.importance).feature in ("a", "b")


def test_edges_of_trees(spark, rows):
    df, _, _ = rows
    none = T.grow(df.where("label > 5"), ["a", "b"])
    assert none.nodes.count() == 0 and {r.score for r in T.score(none, df.limit(3)).collect()} == {None}
    one = T.grow(df.where("label = 1"), ["a", "b"])
    assert [(r.share, r.feature) for r in one.nodes.collect()] == [(1.0, None)]
    odd = spark.createDataFrame([(1, None, 1.0), (2, 1, None), (3, 0, 2.0), (3, 0, 2.0), (4, 1, 1.0)], "id int, label int, a double")
    assert sorted((r.n, r.p) for r in T.grow(odd, ["a"]).nodes.collect()) == [(2, 0), (2, 2), (4, 2)]
    with pytest.raises(ValueError):
        T.grow(df, ["a"], bootstrap=True)
    with pytest.raises(ValueError):
        T.grow(df, ["a"], criterion="other")


def test_draws_are_hashed_once_and_follow_the_poisson_chances(spark):
    """A row's digest is worked out once, outside any function over an array, and counts as the chances at most its number."""
    df = spark.range(500).withColumn("key", F.col("id").cast("string"))
    weight = T.bootstrap_weight(7, F.lit(3), F.col("key"))
    drawn = df.select("key", weight.alias("w"))
    assert "lambda" not in drawn._jdf.queryExecution().optimizedPlan().toString()
    for r in drawn.collect():
        u = int(hashlib.md5(f"7:3:{r.key}".encode()).hexdigest()[:8], 16) / 2 ** 32
        assert r.w == sum(u >= c for c in T.POISSON)


def test_collapsed_rows_of_many_trees(rows, monkeypatch):
    """Trees drawn side by side and in several slices get the weights of trees drawn one at a time; 0/1 columns need no quantiles."""
    df, x, y = rows
    cuts = T.split_points(df, ["a", "b", "c"])
    assert cuts == [[0.5], [0.5, 1.5, 2.5, 3.5, 4.5], [0.5]]
    got = {(r.tree, tuple(r.bins)): (r.n, r.w, r.p) for r in T.collapsed(df, T.bins_of(["a", "b", "c"], cuts), "label", ["id"], 11, True, 5).collect()}
    want = {}
    for tree in range(11):
        for i, (v, label) in enumerate(zip(x, y)):
            u = int(hashlib.md5(f"5:{tree}:{i}".encode()).hexdigest()[:8], 16) / 2 ** 32
            w = sum(u >= c for c in T.POISSON)
            if w:
                n, all_w, p = want.get((tree, tuple(map(int, v))), (0, 0, 0))
                want[tree, tuple(map(int, v))] = (n + 1, all_w + w, p + w * int(label))
    assert got == want
    monkeypatch.setattr(T.F, "percentile_approx", None)
    assert T.split_points(df, ["a", "c"]) == [[0.5], [0.5]]
    assert T.split_points(df.where("label > 5"), ["a"]) == [[]]
