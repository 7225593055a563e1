"""Linear fits against their optimality conditions, computed apart."""

import numpy as np
import pytest

from areapanel.operators.linear import fit_linear


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 2, (200, 2)), rng.normal(size=200)])
    x = np.column_stack([x, 1 - x[:, 0]])  # collinear with the first column and the constant
    y = (x[:, 0] + x[:, 2] + rng.normal(size=200) > 0.8).astype(int)
    rows = [(int(t), *map(float, v)) for t, v in zip(y, x)]
    return spark.createDataFrame([*rows, (None, 1.0, 1.0, 1.0, 1.0), (1, None, 1.0, 1.0, 1.0)], "label int, a double, b double, c double, d double"), x, y


@pytest.mark.parametrize("loss,penalty,cost", [("logistic", "l2", 10.0), ("logistic", "l1", 0.5), ("squared_hinge", "l2", 1.0), ("squared_hinge", "l1", 0.1)])
def test_weights_are_optimal(data, loss, penalty, cost):
    df, x, y = data
    w = np.array(fit_linear(df, ["a", "b", "c", "d"], loss=loss, penalty=penalty, cost=cost).weights)
    x1, sign = np.column_stack([x, np.ones(len(x))]), 2 * y - 1
    m = sign * (x1 @ w)
    slope = cost * x1.T @ (sign * (-1 / (1 + np.exp(m)) if loss == "logistic" else -2 * np.maximum(0, 1 - m)))
    bare = np.abs(w + slope) if penalty == "l2" else np.where(w != 0, np.abs(slope + np.sign(w)), np.maximum(0, np.abs(slope) - 1))
    assert bare.max() < 1e-6


def test_strong_absolute_penalty_leaves_nothing(data):
    assert set(fit_linear(data[0], ["a", "b"], penalty="l1", cost=1e-5).weights) == {0.0}


def test_no_rows_and_unknown_names(data):
    df, _, _ = data
    assert fit_linear(df.where("label > 3"), ["a"]).weights == [0.0, 0.0]
    with pytest.raises(ValueError):
        fit_linear(df, ["a"], loss="other")
