"""Every fitted model of a grid in one long table, and importances from that table by aggregation.

A tree is its nodes, a linear model its weights; nothing of a model stays on the driver but the weights while they are fitted. Decision trees, forests
and bagged trees are grown by `operators.trees`, logistic and squared-hinge models are fitted by `operators.linear`. Boosted trees give the importances
they report, one row a column; a neighbour model has nothing to store.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areapanel.operators import models as ML
from areapanel.operators import trees as T
from areapanel.operators.linear import fit_linear
from areapanel.session import scratch_path, stage

POINT = ["model_type", "parameters", "split_date"]
#: What a row holds of a model: a node of a tree, a weight with its column's deviation, or a ready importance.
ROW = "kind string, tree int, path string, depth int, n long, w long, p long, feature string, gain double, weight double, deviation double"
#: Models whose trees grow as tables.
TREES = ("DT", "RF", "B")
COLUMNS = [part.split()[0] for part in ROW.split(", ")]


def _filled(df: DataFrame, kind: str) -> DataFrame:
    types = dict(part.split() for part in ROW.split(", "))
    known = {c: F.col(c) for c in df.columns} | {"kind": F.lit(kind)}
    return df.select(*[known.get(c, F.lit(None)).cast(types[c]).alias(c) for c in COLUMNS])


def tree_params(name: str, params: Mapping) -> dict:
    return T.fit_params(name, {**ML.DEFAULTS.get(name, {}), **params})


def _node_rows(model: T.TreeModel) -> DataFrame:
    names = F.array(*[F.lit(c) for c in model.predictors])
    return _filled(model.nodes.withColumn("feature", F.get(names, F.col("feature"))), "node")


def model_rows(train: DataFrame, name: str, params: Mapping, predictors: Sequence[str], keys: Sequence[str], label: str = "label") -> DataFrame:
    """Fit one model and return its rows."""
    spark, p = train.sparkSession, {**ML.DEFAULTS.get(name, {}), **params}
    if name in TREES:
        return _node_rows(T.grow(train, predictors, label, keys, seed=ML.SEED, **tree_params(name, params)))
    if name in ("LR", "SVM"):
        model = fit_linear(train, predictors, label, "logistic" if name == "LR" else "squared_hinge", p.get("penalty", "l2"), p.get("C", 1.0))
        weights = spark.createDataFrame(list(zip(predictors, map(float, model.weights))), "feature string, weight double")
        spread = train.agg(*[F.stddev_pop(c).alias(c) for c in predictors]).unpivot([], list(predictors), "feature", "deviation")
        return _filled(weights.join(spread, "feature"), "weight")
    if name == "GB":
        fitted = ML.fit_model(train, name, params, predictors, label)
        reported = list(zip(predictors, map(float, fitted.featureImportances.toArray())))
        return _filled(spark.createDataFrame(reported, "feature string, weight double"), "importance")
    if name == "KNN":
        return spark.createDataFrame([], ROW)
    raise ValueError(f"unknown model {name!r}")


def grid_models(featured: DataFrame, grid: Mapping[str, Mapping], predictors: Sequence[str], keys: Sequence[str] = ("tract", "year"), label: str = "label",
                parallelism: int = 4) -> DataFrame:
    """Rows of every model, parameter point and split; `featured` has split_date and role. The fits are separate jobs, a few side by side.

    All trees of all points and splits grow from one table of collapsed rows; the training rows are not read again for each of them.
    """
    spark = featured.sparkSession
    path = scratch_path(spark, "grid-models")
    narrow = stage(featured.where(F.col("role") == "train").select("split_date", *keys, label, *predictors), "grid-rows")
    dates = [r.split_date for r in narrow.select("split_date").distinct().orderBy("split_date").collect()]
    points = [(d, name, params) for d in dates for name in grid for params in ML.grid_points(grid[name])]
    grown = [tree_params(name, params) for _, name, params in points if name in TREES]
    if grown:
        largest = max((p["trees"] for p in grown if p.get("bootstrap")), default=0)
        vectors = T.collapse_parts(narrow, "split_date", predictors, label, keys, largest, not all(p.get("bootstrap") for p in grown), ML.SEED)

    @inheritable_thread_target(spark)
    def fit(at: int) -> None:
        day, name, params = points[at]
        if name in TREES:
            rows = _node_rows(vectors.grow(day, seed=ML.SEED, **tree_params(name, params)))
        else:
            rows = model_rows(narrow.where(F.col("split_date") == F.lit(day)), name, params, predictors, keys, label)
        rows.select(F.lit(name).alias("model_type"), F.lit(ML.params_text(params)).alias("parameters"), F.lit(day).alias("split_date"),
                    *COLUMNS).write.parquet(f"{path}/point={at}")

    with ThreadPool(parallelism) as pool:
        pool.map(fit, range(len(points)))
    return spark.read.parquet(path).drop("point")


def grid_importance(models: DataFrame, top: int = 10) -> DataFrame:
    """(point, feature, importance): the `top` largest of every grid point, only above 0, ties to the first name.

    Trees: each column's part of a tree's impurity decrease, averaged over the trees that split at all. Linear models: |weight| x deviation of the
    column, for the logistic one over its largest.
    """
    nodes = models.where("kind = 'node'")
    root = nodes.where("depth = 0").select(*POINT, "tree", F.col("w").alias("all_w"))
    won = nodes.where("feature is not null").join(root, [*POINT, "tree"]).groupBy(*POINT, "tree", "feature").agg(
        F.sum(F.col("gain") * F.col("w") / F.col("all_w")).alias("won"))
    part = won.withColumn("part", F.try_divide(F.col("won"), F.sum("won").over(Window.partitionBy(*POINT, "tree"))))
    grown = nodes.where("depth = 0 and feature is not null").groupBy(*POINT).agg(F.count("*").alias("grown"))
    of_trees = part.groupBy(*POINT, "feature").agg(F.sum("part").alias("s")).join(grown, POINT).select(
        *POINT, "feature", (F.col("s") / F.col("grown")).alias("importance"))
    size = F.abs("weight") * F.coalesce("deviation", F.lit(0.0))
    lines = models.where("kind = 'weight'").select(*POINT, "feature", size.alias("size"))
    largest = F.max("size").over(Window.partitionBy(*POINT))
    of_lines = lines.withColumn("largest", largest).select(
        *POINT, "feature", F.when(F.col("model_type") == "LR", F.try_divide("size", "largest")).otherwise(F.col("size")).alias("importance"))
    reported = models.where("kind = 'importance'").select(*POINT, "feature", F.col("weight").alias("importance"))
    every = of_trees.unionByName(of_lines).unionByName(reported).where("importance > 0")
    # compared to twelve digits, so that equal importances are ties whatever the order of the sums
    place = F.row_number().over(Window.partitionBy(*POINT).orderBy(F.desc(F.round("importance", 12)), "feature"))
    return every.withColumn("place", place).where(F.col("place") <= top).drop("place")
