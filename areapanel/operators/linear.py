"""Linear models to their exact optimum: logistic or squared-hinge loss, with a squared or an absolute penalty.

Minimises penalty(w) + C * sum of losses, the constant being penalised like any other weight. Equal rows collapse first. A Newton step is one pass: tasks add up gradient and
curvature over numpy blocks, and the sums of a few numbers per pair of columns reach the driver, whatever the number of rows. With the absolute penalty the step
minimises the quadratic model by coordinate descent. A second pass tries all step lengths at once. The end is where the optimality conditions hold
within `tolerance`; a fit that does not get there raises. Rows with a missing label or predictor are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areapanel.session import stage

TOLERANCE = 1e-7
STEPS = 100
LENGTHS = [0.5 ** k for k in range(25)]


@dataclass
class LinearModel:
    predictors: list[str]
    weights: list[float]  # the last one is the constant
    loss: str
    penalty: str
    cost: float

    def margin(self) -> Column:
        out = F.lit(self.weights[-1])
        for c, w in zip(self.predictors, self.weights):
            if w:
                out = out + F.col(c).cast("double") * F.lit(w)
        return out

    def score(self) -> Column:
        """Chance of the positive class for the logistic loss, else the margin."""
        return 1 / (1 + F.exp(-self.margin())) if self.loss == "logistic" else self.margin()


def _losses(m: np.ndarray, loss: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss at margin m, its slope and curvature."""
    if loss == "logistic":
        s = 1 / (1 + np.exp(np.clip(m, -700, 700)))
        return np.logaddexp(0, -m), -s, s * (1 - s)
    short = np.maximum(0, 1 - m)
    return short ** 2, -2 * short, 2.0 * (m < 1)


def _blocks(batch: pa.RecordBatch, width: int):
    x = batch.column(0).flatten().to_numpy().reshape(-1, width)
    x = np.column_stack([x, np.ones(len(x))])
    for sign, n in ((1.0, batch.column(1).to_numpy().astype(float)), (-1.0, batch.column(2).to_numpy().astype(float))):
        yield x, sign, n


def _added(rows: DataFrame, run) -> np.ndarray:
    """Sum of the arrays that the tasks return, entry by entry."""
    parts = rows.mapInArrow(run, "part array<double>").select(F.posexplode("part").alias("at", "v"))
    found = parts.groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").toArrow()
    return found["v"].to_numpy()


def _slope_and_curvature(rows: DataFrame, w: np.ndarray, loss: str) -> tuple[np.ndarray, np.ndarray]:
    width = len(w) - 1

    def run(batches):
        g, h = np.zeros(width + 1), np.zeros((width + 1, width + 1))
        for batch in batches:
            for x, sign, n in _blocks(batch, width):
                _, d, c = _losses(sign * (x @ w), loss)
                g += x.T @ (n * sign * d)
                h += (x * (n * c)[:, None]).T @ x
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([g, h.ravel()])], pa.list_(pa.float64()))], ["part"])
    total = _added(rows, run)
    return total[:width + 1], total[width + 1:].reshape(width + 1, width + 1)


def _loss_along(rows: DataFrame, w: np.ndarray, step: np.ndarray, loss: str) -> np.ndarray:
    """Summed loss at w and at w + t * step for every length t."""
    width, lengths = len(w) - 1, np.array([0.0, *LENGTHS])

    def run(batches):
        out = np.zeros(len(lengths))
        for batch in batches:
            for x, sign, n in _blocks(batch, width):
                base, move = sign * (x @ w), sign * (x @ step)
                out += [n @ _losses(base + t * move, loss)[0] for t in lengths]
        yield pa.RecordBatch.from_arrays([pa.array([out], pa.list_(pa.float64()))], ["part"])
    return _added(rows, run)


def _absolute_step(w: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Minimiser of g d + d h d / 2 + |w + d| by coordinate descent."""
    d, hd = np.zeros(len(w)), np.zeros(len(w))
    curve = np.maximum(np.diag(h), 1e-12)
    for _ in range(5000):
        most = 0.0
        for j in range(len(w)):
            z = w[j] + d[j] - (g[j] + hd[j]) / curve[j]
            move = np.sign(z) * max(0.0, abs(z) - 1 / curve[j]) - w[j] - d[j]
            if move:
                d[j] += move
                hd += h[:, j] * move
                most = max(most, abs(move) * np.sqrt(curve[j]))
        if most < 1e-11:
            break
    return d


def violations(w: np.ndarray, slope: np.ndarray, penalty: str) -> np.ndarray:
    """How far each weight is from its optimality condition; `slope` is that of the weighted losses."""
    if penalty == "l2":
        return np.abs(w + slope)
    return np.where(w != 0, np.abs(slope + np.sign(w)), np.maximum(0, np.abs(slope) - 1))


def fit_linear(train: DataFrame, predictors: Sequence[str], label: str = "label", loss: str = "logistic", penalty: str = "l2", cost: float = 1.0,
               tolerance: float = TOLERANCE) -> LinearModel:
    if loss not in ("logistic", "squared_hinge") or penalty not in ("l1", "l2"):
        raise ValueError("loss is 'logistic' or 'squared_hinge', penalty 'l1' or 'l2'")
    predictors = list(predictors)
    vector = F.array(*[F.col(c).cast("double") for c in predictors])
    rows = train.select(vector.alias("x"), F.col(label).cast("long").alias("y")).where("y is not null and not exists(x, v -> v is null)")
    rows = stage(rows.groupBy("x").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")), "distinct-rows")
    w = np.zeros(len(predictors) + 1)
    n = rows.agg(F.sum(F.col("pos") + F.col("neg"))).first()[0]
    # sums over very many or very heavy rows are not exact to more digits than these
    tolerance = max(tolerance, 1e-13 * cost * (n or 0))
    if not n:
        return LinearModel(predictors, w.tolist(), loss, penalty, cost)
    for _ in range(STEPS):
        slope, curvature = (cost * v for v in _slope_and_curvature(rows, w, loss))
        if violations(w, slope, penalty).max() <= tolerance:
            return LinearModel(predictors, w.tolist(), loss, penalty, cost)
        if penalty == "l2":
            step = np.linalg.solve(curvature + np.eye(len(w)), -(w + slope))
            size, fall = (lambda v: v @ v / 2), (w + slope) @ step
        else:
            step = _absolute_step(w, slope, curvature)
            size, fall = (lambda v: np.abs(v).sum()), slope @ step + np.abs(w + step).sum() - np.abs(w).sum()
        along = cost * _loss_along(rows, w, step, loss)
        start = along[0] + size(w)
        # near the end the gain drowns in rounding; the full step is right there
        lengths = [t for t, f in zip(LENGTHS, along[1:]) if f + size(w + t * step) <= start + 0.01 * t * fall + 1e-13 * abs(start)]
        if not lengths:
            break
        w = w + lengths[0] * step
        w[np.abs(w) < 1e-15] = 0.0
    raise RuntimeError(f"the {loss} fit did not reach its optimum")
