"""MLlib models under the panel's model names, grids and importances.

Trees and forests are regression trees on the 0/1 label. Variance of such a label is half its gini impurity, so the
splits are the gini splits, and every leaf keeps its share of positives. MLlib's tree classifiers merge leaves with the
same majority class, which leaves one node when positives are rare.

`run_model` grows single trees, trees by entropy and trees deeper than MLlib allows as tables instead (`operators.trees`), so
their depth is what was asked for and their leaves keep their shares. `estimator` still offers MLlib's entropy trees.

A forest of more than `BATCH_TREES` trees is fitted and scored by `run_model` in batches, so the driver holds the trees
of a few batches at a time; its score is the mean over all trees. Where all predictors are 0 or 1 and the rows share few
vectors, it is grown from the distinct vectors by the same law (`score_few_vectors`), whose work does not grow with the rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areapanel.operators import trees
from areapanel.operators.linear import fit_linear
from areapanel.operators.neighbours import knn_score
from areapanel.session import scratch_path, stage

SEED = 100
# MLlib draws a partition's rows by seed + partition, so the seeds of batches lie further apart than partitions do.
SEED_STEP = 1_000_003
BATCH_TREES = 100
BATCHES_AT_ONCE = 4
ROWS_A_VECTOR = 10
MAX_DRAWS = 50_000_000
MAX_TREE_DEPTH = 30  # MLlib accepts no deeper tree.
ROWS_PER_PARTITION = 50_000
TOLERANCE = 1e-4

# Default parameters per model.
DEFAULTS = {
    "RF": {"n_estimators": 50},
    "B": {"n_estimators": 10},
    "LR": {"penalty": "l1", "C": 1e5},
    "SVM": {"C": 1.0},
    "GB": {"learning_rate": 0.05, "subsample": 0.5, "max_depth": 6, "n_estimators": 10},
    "DT": {},
    "KNN": {"n_neighbors": 3},
}

# Parameter grids.
_COSTS = [0.00001, 0.0001, 0.001, 0.01, 0.1, 1, 10]
_COSTS_SHORT = [0.00001, 0.001, 0.1, 1, 10]
_TREE = {"criterion": ["gini", "entropy"], "max_depth": [1, 5, 10, 20, 50, 100],
         "max_features": [None, "sqrt", "log2"], "min_samples_split": [2, 5, 10]}
GRIDS = {
    "large": {
        "RF": {"n_estimators": [1, 10, 100, 1000, 10000], "max_depth": [1, 5, 10, 20, 50, 100],
               "max_features": ["sqrt", "log2"], "min_samples_split": [2, 5, 10]},
        "B": {"n_estimators": [1, 10, 100, 1000, 10000]},
        "LR": {"penalty": ["l1", "l2"], "C": _COSTS},
        "SVM": {"C": _COSTS},
        "GB": {"n_estimators": [1, 10, 100, 1000, 10000], "learning_rate": [0.001, 0.01, 0.05, 0.1, 0.5],
               "subsample": [0.1, 0.5, 1.0], "max_depth": [1, 3, 5, 10, 20, 50, 100]},
        "DT": _TREE,
        "KNN": {"n_neighbors": [1, 5, 10, 25, 50, 100], "weights": ["uniform", "distance"]},
    },
    "small": {
        "RF": {"n_estimators": [100, 10000], "max_depth": [5, 50], "max_features": ["sqrt", "log2"],
               "min_samples_split": [2, 10]},
        "B": {"n_estimators": [1, 10, 100, 1000, 10000]},
        "LR": {"penalty": ["l1", "l2"], "C": _COSTS_SHORT},
        "SVM": {"C": _COSTS},
        "GB": {"n_estimators": [100, 1000], "learning_rate": [0.001, 0.1, 0.5], "subsample": [0.1, 1.0],
               "max_depth": [5, 50]},
        "DT": _TREE,
        "KNN": {"n_neighbors": [5, 10], "weights": ["uniform"]},
    },
    "test": {
        "RF": {"n_estimators": [1], "max_depth": [1], "max_features": ["sqrt"], "min_samples_split": [10]},
        "B": {"n_estimators": [1]},
        "LR": {"penalty": ["l1"], "C": [0.01]},
        "SVM": {"C": [0.01]},
        "GB": {"n_estimators": [1], "learning_rate": [0.1], "subsample": [0.5], "max_depth": [1]},
        "DT": {"criterion": ["gini"], "max_depth": [1], "max_features": [None], "min_samples_split": [10]},
        "KNN": {"n_neighbors": [5], "weights": ["uniform"]},
    },
    "med": {
        "RF": {"n_estimators": [1, 10, 100, 1000], "max_depth": [5, 50], "max_features": ["sqrt", "log2"],
               "min_samples_split": [2, 10]},
        "B": {"n_estimators": [1, 10, 100, 1000]},
        "LR": {"penalty": ["l1", "l2"], "C": _COSTS_SHORT},
        "SVM": {"C": _COSTS},
        "GB": {"n_estimators": [1, 50], "learning_rate": [0.1, 0.5], "subsample": [0.1, 1.0],
               "max_depth": [1, 5, 10]},
        "DT": _TREE,
        "KNN": {"n_neighbors": [5], "weights": ["uniform"]},
    },
}


def model_grid(size: str) -> tuple[dict, dict]:
    """Default parameters and the parameter grid of the given size."""
    if size not in GRIDS:
        raise KeyError(f"grid size is one of {sorted(GRIDS)}, not {size!r}")
    return DEFAULTS, GRIDS[size]


def effective(params: Mapping) -> dict:
    """The parameters as they are fitted: boosted trees and those of forests fitted in batches are no deeper than MLlib allows."""
    out = dict(params)
    if out.get("max_depth") and ("learning_rate" in out or out.get("n_estimators", 1) > BATCH_TREES):
        out["max_depth"] = min(out["max_depth"], MAX_TREE_DEPTH)
    return out


def grid_points(grid: Mapping[str, Sequence]) -> Iterator[dict]:
    """Every combination of the listed values, as fitted; those that come out equal count once."""
    names, seen = sorted(grid), set()
    for values in product(*[grid[n] for n in names]):
        point = effective(dict(zip(names, values)))
        if params_text(point) not in seen:
            seen.add(params_text(point))
            yield point


def _depth(params: Mapping, default: int | None = None) -> int:
    return min(params.get("max_depth") or default or MAX_TREE_DEPTH, MAX_TREE_DEPTH)


def _leaf_size(params: Mapping) -> int:
    # A node of fewer than min_samples_split rows stays whole if each child needs half of that.
    return max(1, int(params.get("min_samples_split", 2)) // 2)


def by_entropy(name: str, params: Mapping) -> bool:
    return name in ("RF", "B", "DT") and params.get("criterion") == "entropy"


def grown_as_tables(name: str, params: Mapping) -> bool:
    """Whether a model's trees are grown by `operators.trees`."""
    if name not in ("DT", "RF", "B"):
        return False
    deep = (params.get("max_depth") or MAX_TREE_DEPTH + 1) > MAX_TREE_DEPTH
    return name == "DT" or by_entropy(name, params) or (deep and {**DEFAULTS[name], **params}["n_estimators"] <= BATCH_TREES)


def estimator(name: str, params: Mapping, n_train: int, label: str = "label", seed: int = SEED):
    """MLlib estimator for a model name and its parameters over `n_train` rows."""
    p = {**DEFAULTS[name], **params}
    io = {"featuresCol": "features", "labelCol": label}
    # The cost weighs the summed loss, regParam weighs the penalty against the mean loss.
    strength = 1.0 / (p.get("C", 1.0) * max(n_train, 1))
    if name == "LR":
        return LogisticRegression(elasticNetParam=1.0 if p["penalty"] == "l1" else 0.0, regParam=strength,
                                  standardization=False, maxIter=100, tol=TOLERANCE, **io)
    if name == "SVM":
        return LinearSVC(regParam=strength, standardization=False, maxIter=100, tol=TOLERANCE, **io)
    if name == "GB":
        return GBTClassifier(maxIter=p["n_estimators"], stepSize=p["learning_rate"], subsamplingRate=p["subsample"],
                             maxDepth=_depth(p), seed=seed, **io)
    tree = {"maxDepth": _depth(p), "minInstancesPerNode": _leaf_size(p), "seed": seed, **io}
    if by_entropy(name, p):
        tree |= {"impurity": "entropy", "weightCol": "weight"}
    if name == "DT" and not p.get("max_features"):
        return (DecisionTreeClassifier if by_entropy(name, p) else DecisionTreeRegressor)(**tree)
    if name in ("RF", "B", "DT"):
        strategy = "all" if name == "B" else p.get("max_features") or "sqrt"
        forest = RandomForestClassifier if by_entropy(name, p) else RandomForestRegressor
        return forest(numTrees=1 if name == "DT" else p["n_estimators"], featureSubsetStrategy=strategy,
                      bootstrap=name != "DT", **tree)
    raise KeyError(f"no estimator named {name!r}")


def assemble(df: DataFrame, predictors: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(predictors), outputCol="features", handleInvalid="error").transform(df)


def _unbalanced(score: Column, positives: float | None) -> Column:
    """A score turned back to the share of positives its model was balanced from (None: the score itself)."""
    if positives is None:
        return score
    yes, no = score * F.lit(positives), (F.lit(1.0) - score) * F.lit(1.0 - positives)
    return yes / (yes + no)


def scored(name: str, model, df: DataFrame, positives: float | None = None) -> DataFrame:
    """`score`: chance of the positive class, or the margin for the SVM.

    `positives` is the share of positives a model was balanced from; its scores are turned back to that share.
    """
    out = model.transform(df)
    if "probability" not in out.columns and name != "SVM":
        score = F.col("prediction")
    else:
        raw = "rawPrediction" if name == "SVM" else "probability"
        # A training set of one class yields a one-element vector: nothing is positive.
        score = F.coalesce(F.get(vector_to_array(F.col(raw)), F.lit(1)), F.lit(0.0))
    return out.withColumn("score", _unbalanced(score, positives)).drop("rawPrediction", "probability", "prediction", "features")


@contextmanager
def _training_rows(train: DataFrame, name: str, params: Mapping, predictors: Sequence[str], label: str):
    """The kept rows to fit on, their number, and the share of positives they are balanced from (None if they weigh the same)."""
    rows = assemble(train.select(*predictors, F.col(label).cast("double").alias(label)), predictors) \
        .select("features", label).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, share = rows.agg(F.count("*"), F.avg(label)).first()
        # Few rows in many partitions only add task overhead to every iteration.
        packed = rows.coalesce(max(1, min(rows.rdd.getNumPartitions(), -(-n // ROWS_PER_PARTITION))))
        balanced = by_entropy(name, params)
        mixed = balanced and bool(share) and share < 1
        if balanced:
            weight = F.when(F.col(label) == 1, 0.5 / share).otherwise(0.5 / (1 - share)) if mixed else F.lit(1.0)
            packed = packed.withColumn("weight", weight)
        yield packed, n, share if mixed else None
    finally:
        rows.unpersist()


def fit_balanced(train: DataFrame, name: str, params: Mapping, predictors: Sequence[str], label: str = "label"):
    """A fitted model, and the share of positives it was balanced from (None if its rows weigh the same)."""
    with _training_rows(train, name, params, predictors, label) as (rows, n, positives):
        return estimator(name, params, n, label).fit(rows), positives


def tree_batches(name: str, params: Mapping) -> list[tuple[int, int]]:
    """(seed, number of trees) of the fits that make up a forest; one for any other model."""
    trees = {**DEFAULTS[name], **params}.get("n_estimators", 1) if name in ("RF", "B") else 1
    return [(SEED + k * SEED_STEP, min(BATCH_TREES, trees - at)) for k, at in enumerate(range(0, trees, BATCH_TREES))]


def score_in_batches(train: DataFrame, test: DataFrame, name: str, params: Mapping, predictors: Sequence[str],
                     label: str = "label") -> DataFrame:
    """The test rows with the mean score of all trees; each batch of trees is let go once its scores are stored."""
    spark, batches = train.sparkSession, tree_batches(name, params)
    rows = stage(test.withColumn("_row", F.monotonically_increasing_id()), "to-score")
    vectors = assemble(rows, predictors).select("_row", "features")
    path = scratch_path(spark, "batch-scores")
    with _training_rows(train, name, params, predictors, label) as (packed, n, positives):
        @inheritable_thread_target(spark)
        def fit_and_score(k: int) -> None:
            seed, trees = batches[k]
            model = estimator(name, {**params, "n_estimators": trees}, n, label, seed).fit(packed)
            scored(name, model, vectors).select("_row", (F.col("score") * F.lit(trees)).alias("sum")).write.parquet(f"{path}/batch={k}")

        with ThreadPool(BATCHES_AT_ONCE) as pool:
            pool.map(fit_and_score, range(len(batches)), chunksize=1)
    # Summed in the order of the batches: rows with equal predictors get equal scores, to the last bit.
    sums = F.transform(F.array_sort(F.collect_list(F.struct("batch", "sum"))), lambda b: b["sum"])
    total = F.aggregate(sums, F.lit(0.0), lambda a, b: a + b)
    means = spark.read.parquet(path).groupBy("_row").agg((total / F.lit(sum(t for _, t in batches))).alias("score"))
    return rows.join(means.withColumn("score", _unbalanced(F.col("score"), positives)), "_row").drop("_row")


def score_few_vectors(train: DataFrame, test: DataFrame, name: str, params: Mapping, predictors: Sequence[str],
                      label: str = "label") -> DataFrame | None:
    """The test rows with the mean score of all trees, grown from the distinct vectors of 0/1 predictors; None if they are other or many.

    Draws, splits and leaves follow the law of MLlib's forest over single rows.
    """
    p = {**DEFAULTS[name], **params}
    vector = F.array(*[F.col(c).cast("double") for c in predictors])
    rows = train.select(vector.alias("v"), F.col(label).cast("long").alias("y"))
    groups = stage(rows.groupBy("v").agg(F.count("*").alias("m"), F.sum("y").alias("q"), F.count("y").alias("labelled")), "vectors")
    found = groups.agg(F.count("*").alias("vectors"), F.sum("m").alias("rows"), F.count_if(F.col("m") != F.col("labelled")).alias("unlabelled"),
                       F.count_if(~F.forall("v", lambda x: F.coalesce(x.isin(0.0, 1.0), F.lit(False)))).alias("other")).first()
    if not found.vectors or found.other or found.unlabelled or found.vectors * ROWS_A_VECTOR > found.rows or found.vectors * p["n_estimators"] > MAX_DRAWS:
        return None
    n = len(predictors)
    strategy = "all" if name == "B" else p.get("max_features") or "sqrt"
    roots = {"all": n, "sqrt": math.ceil(math.sqrt(n)), "log2": max(1, math.ceil(math.log2(n)))}
    if strategy not in roots:
        return None
    bins = F.transform("v", lambda x: x.cast("int"))
    model = trees.grow_like_mllib(groups.select(bins.alias("bins"), "m", "q"), predictors, p["n_estimators"], _depth(p), roots[strategy], _leaf_size(p), SEED)
    return trees.score(model, test)


def fit_model(train: DataFrame, name: str, params: Mapping, predictors: Sequence[str], label: str = "label"):
    """Fit one model; the assembled rows are kept while it iterates over them."""
    return fit_balanced(train, name, params, predictors, label)[0]


def run_model(train: DataFrame, test: DataFrame, name: str, params: Mapping, predictors: Sequence[str],
              keys: Sequence[str], label: str = "label") -> DataFrame:
    """Fit one model by name; returns the test rows with `score`.

    With solver='exact', logistic regression and the linear SVM (then of squared hinge) are fitted to their optimum by Newton steps.
    """
    if name == "KNN":
        p = {**DEFAULTS["KNN"], **params}
        vector = F.array(*[F.col(c).cast("double") for c in predictors])
        scores = knn_score(train.withColumn("features", vector), test.withColumn("features", vector), keys,
                           "features", label, k=p["n_neighbors"], weights=p.get("weights", "uniform"))
        return test.join(scores, list(keys))
    if name in ("LR", "SVM") and params.get("solver") == "exact":
        p = {**DEFAULTS[name], **params}
        model = fit_linear(train, predictors, label, "logistic" if name == "LR" else "squared_hinge", p.get("penalty", "l2"), p.get("C", 1.0))
        return test.withColumn("score", model.score())
    if grown_as_tables(name, params):
        model = trees.grow(train, predictors, label, keys, seed=SEED, **trees.fit_params(name, {**DEFAULTS[name], **params}))
        return trees.score(model, test).withColumn("score", F.coalesce("score", F.lit(0.0)))
    if len(tree_batches(name, params)) > 1:
        few = score_few_vectors(train, test, name, params, predictors, label)
        if few is not None:
            return few
        return score_in_batches(train, test, name, params, predictors, label)
    model, positives = fit_balanced(train, name, params, predictors, label)
    return scored(name, model, assemble(test, predictors), positives)


def params_text(params: Mapping) -> str:
    return json.dumps({k: params[k] for k in sorted(params)})


def feature_importance(name: str, model, train: DataFrame, predictors: Sequence[str], top: int = 10) -> DataFrame:
    """(feature, importance), largest first, only above 0.

    Trees report their own; linear models |coefficient| x column deviation, logistic scaled to 1.
    A neighbour model has none.
    """
    spark = train.sparkSession
    schema = "feature string, importance double"
    if name == "KNN":
        return spark.createDataFrame([], schema)
    if name in ("LR", "SVM"):
        deviations = train.agg(*[F.stddev_pop(c).alias(c) for c in predictors]).first()
        values = [abs(float(w)) * float(deviations[c] or 0.0) for w, c in zip(model.coefficients.toArray(), predictors)]
        if name == "LR" and max(values, default=0.0) > 0:
            values = [v / max(values) for v in values]
    else:
        values = [float(v) for v in model.featureImportances.toArray()]
    pairs = spark.createDataFrame(list(zip(predictors, values)), schema)
    return pairs.where("importance > 0").orderBy(F.desc("importance"), "feature").limit(top)
