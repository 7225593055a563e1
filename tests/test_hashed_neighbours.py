"""Similarity-hash neighbours: recall against every pair, hot buckets in pieces, rows that meet too few, unusable vectors."""

import numpy as np
import pytest

from areapanel.operators import hashed_neighbours as H
from areapanel.operators.neighbours import knn_score

SCHEMA = "id long, x array<double>, y int"


def clustered(seed: int, rows: int, width: int = 16):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(1).normal(0, 1, (20, width))
    which = rng.integers(0, 20, rows)
    x = centres[which] + rng.normal(0, 0.15, (rows, width))
    return [(i, [float(v) for v in x[i]], int(which[i] % 3 == 0)) for i in range(rows)]


@pytest.fixture(scope="module")
def sides(spark):
    return spark.createDataFrame(clustered(2, 2000), SCHEMA).cache(), spark.createDataFrame(clustered(3, 150), SCHEMA).cache()


def test_recall_reaches_the_target_with_the_tables_found(sides):
    train, test = sides
    found = H.enough_tables(train, test, "x", 5, 0.9, start=2, bucket_rows=100)
    assert H.recall(train, test, "x", 5, found, bucket_rows=100) >= 0.9
    with pytest.raises(ValueError):
        H.enough_tables(train, test, "x", 5, 1.01, start=1, most=1, bucket_rows=100)


def scores(df):
    return {r.id: r.score for r in df.collect()}


def test_one_bucket_of_all_equals_the_exact_way_in_any_pieces(sides):
    train, test = sides
    exact = scores(knn_score(train, test, ["id"], "x", "y", 5))
    for block_rows in (10_000, 300):
        got = scores(H.hashed_knn_score(train, test, ["id"], "x", "y", 5, tables=3, bucket_rows=10_000, block_rows=block_rows))
        assert got == pytest.approx(exact)


def test_rows_that_meet_too_few_go_the_exact_way(spark, sides):
    train, test = sides
    far = spark.createDataFrame([(900, [50.0] * 16, 0)], SCHEMA)
    got = scores(H.hashed_knn_score(train, far, ["id"], "x", "y", 5, tables=1, radius=0, bucket_rows=1))
    assert got == pytest.approx(scores(knn_score(train, far, ["id"], "x", "y", 5)))


def test_hot_equal_vectors_nulls_and_repeated_keys(spark):
    train = spark.createDataFrame([(i, [1.0, 0.0], 1) for i in range(40)] + [(50, [0.0, 1.0], 0), (51, None, 1), (52, [float("nan"), 1.0], 1), (53, [None, 1.0], 1)], SCHEMA)
    test = spark.createDataFrame([(1, [1.0, 0.1], 0), (1, [1.0, 0.2], 0), (None, [0.9, 0.0], 0), (3, None, 0), (4, [float("inf"), 0.0], 0)], SCHEMA)
    got = [(r.id, r.score) for r in H.hashed_knn_score(train, test, ["id"], "x", "y", 5).collect()]
    assert sorted(got, key=repr) == [(1, 1.0), (1, 1.0), (3, None), (4, None), (None, 1.0)]
    none = H.hashed_knn_score(train.limit(0), test, ["id"], "x", "y").collect()
    assert len(none) == 5 and all(r.score is None for r in none)
    assert H.hashed_knn_score(train, test.limit(0), ["id"], "x", "y").count() == 0


def test_clashing_names(spark):
    rows = [(i, [float(i % 7), 1.0], i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "_row long, _t array<double>, _n int")
    assert H.hashed_knn_score(df, df, ["_row"], "_t", "_n", 3).count() == 30
