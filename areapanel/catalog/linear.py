"""Optimality of linear fits: slopes added up by built-in functions, held against the conditions of the optimum."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from areapanel.catalog.base import query
from areapanel.catalog.trees import COLUMNS, lines
from areapanel.operators import linear as L

FITS = {"logistic_l2": ("logistic", "l2", 10.0), "logistic_l1": ("logistic", "l1", 0.05), "hinge_l2": ("squared_hinge", "l2", 0.1), "hinge_l1": ("squared_hinge", "l1", 0.01)}
_MODELS = ", ".join(f"('{m}')" for m in FITS)
_COLUMNS = ", ".join(f"('{c}')" for c in [*COLUMNS, "constant"])


@query("linear_optimality", f"SELECT model, column_name, 0.0::DOUBLE AS violation FROM (VALUES {_MODELS}) m(model), (VALUES {_COLUMNS}) c(column_name)")
def linear_optimality(spark, folder):
    """How far every weight of every fit is from its condition, to six digits: nothing."""
    df, out = lines(spark, folder), []
    for name, (loss, penalty, cost) in FITS.items():
        model = L.fit_linear(df, list(COLUMNS), "label", loss, penalty, cost)
        sign = F.when(F.col("label") == 1, 1.0).otherwise(-1.0)
        m = sign * model.margin()
        slope = -1 / (1 + F.exp(m)) if loss == "logistic" else -2 * F.greatest(F.lit(0.0), 1 - m)
        sums = df.agg(*[F.sum(cost * sign * slope * x).alias(c) for c, x in [*((c, F.col(c)) for c in COLUMNS), ("constant", F.lit(1.0))]])
        long = sums.unpivot([], [*COLUMNS, "constant"], "column_name", "slope")
        weight = F.create_map(*[F.lit(v) for pair in zip([*COLUMNS, "constant"], map(float, model.weights)) for v in pair])[F.col("column_name")]
        bare = F.abs(F.col("slope") + weight) if penalty == "l2" else F.when(weight != 0, F.abs(F.col("slope") + F.signum(weight))).otherwise(
            F.greatest(F.lit(0.0), F.abs("slope") - 1))
        out.append(long.select(F.lit(name).alias("model"), "column_name", F.round(bare, 6).alias("violation")))
    return reduce(lambda a, b: a.unionByName(b), out)
