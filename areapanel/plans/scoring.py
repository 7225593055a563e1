"""Production scoring and temporal grid evaluation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areapanel.operators import features as FE
from areapanel.operators import metrics as M
from areapanel.operators import models as ML
from areapanel.operators.selection import flag_first
from areapanel.session import scratch_path, stage
from areapanel.sources.landed import write_csv

LEVELS = ("low", "medium", "high")
# Parameters of the two production models.
PRODUCTION = {"LR": {"C": 10, "penalty": "l2"},
              "RF": {"n_estimators": 10000, "max_depth": 50, "max_features": "log2", "min_samples_split": 10}}


def split_features(splits: DataFrame, to_bin: Sequence[str], fit_on: str = "own", bins: int = 3,
                   labels: Sequence[str] = LEVELS, impute: Sequence[str] | None = None) -> DataFrame:
    """Features of every (split, role) set, each from its own medians and ranges.

    With fit_on='train' the test set uses the medians and ranges of its split's train set.
    """
    if fit_on == "own":
        return FE.process_features(splits, to_bin, bins, labels, ["split_date", "role"], impute)
    if fit_on != "train":
        raise ValueError("fit_on is 'own' or 'train'")
    train = splits.where(F.col("role") == "train")
    return FE.process_features(splits, to_bin, bins, labels, ["split_date"], impute, fit_on=train)


def group_columns(to_bin: Sequence[str], labels: Sequence[str] = LEVELS) -> list[str]:
    """Names of the one-hot columns made for the binned columns."""
    return [f"{c}_group_{v}" for c in to_bin for v in (*labels, "nan")]


def production_score(labelled: DataFrame, test_year: int, keys: Sequence[str] = ("tract", "year"),
                     models: Mapping[str, Mapping] = PRODUCTION, top: float = 10.0,
                     to_bin: Sequence[str] | None = None, fit_on: str = "own", output: str | None = None) -> DataFrame:
    """Train on all other years, score `test_year`, flag the top share by each model."""
    labelled = stage(labelled, "labelled")
    numeric = FE.numeric_columns(labelled, exclude=["label", "label_prev_year", *keys])
    to_bin = list(to_bin or FE.continuous_columns(labelled.select(*numeric)))
    train, test = (labelled.where(c) for c in (F.col("year") != test_year, F.col("year") == test_year))
    train_x = FE.process_features(train, to_bin, labels=LEVELS, impute=numeric).persist(StorageLevel.MEMORY_AND_DISK)
    test_x = FE.process_features(test, to_bin, labels=LEVELS, impute=numeric,
                                 fit_on=train if fit_on == "train" else None)
    try:
        predictors = FE.binary_columns(train_x, exclude=["label", *keys])
        out = None
        for name, params in models.items():
            # Ranking reads the scores several times, the caller after the train set is let go.
            scores = stage(ML.run_model(train_x, test_x, name, params, predictors, keys).select(*keys, "score"), "scores")
            flagged = flag_first(scores, [], M.score_rank("score", keys), top,
                                 name=f"prediction_{name.lower()}").drop("score")
            out = flagged if out is None else out.join(flagged, list(keys))
        if output:
            write_csv(out, output)
        return out
    finally:
        train_x.unpersist()


def split_bounds(splits: DataFrame, year: str = "year") -> DataFrame:
    """First and last year of the train and test set of each split."""
    stats = []
    for role in ("train", "test"):
        own = F.when(F.col("role") == role, F.col(year))
        stats += [F.min(own).alias(f"min_year_in_{role}"), F.max(own).alias(f"max_year_in_{role}")]
    return splits.groupBy("split_date").agg(*stats)


def grid_scores(featured: DataFrame, models: Sequence[str], grid: Mapping[str, Mapping], predictors: Sequence[str],
                keys: Sequence[str] = ("tract", "year"), label: str = "label", path: str | None = None,
                parallelism: int = 4) -> DataFrame:
    """Scores of every split, model and parameter point in one long table.

    Each fit is a distributed job over the cached features; its scores become one
    partition of a table in the shared folder, which also ends the lineage of the fits.
    """
    spark = featured.sparkSession
    path = path or scratch_path(spark, "grid-scores")
    narrow = featured.select("split_date", "role", *keys, label, *predictors).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        dates = [r.split_date for r in narrow.select("split_date").distinct().orderBy("split_date").collect()]
        points = [(d, name, params) for d in dates for name in models for params in ML.grid_points(grid[name])]

        @inheritable_thread_target(spark)
        def fit_and_score(point) -> None:
            day, name, params = point
            own = narrow.where(F.col("split_date") == F.lit(day))
            train, test = (own.where(F.col("role") == r) for r in ("train", "test"))
            scores = ML.run_model(train, test, name, params, predictors, keys, label)
            scores.select(F.lit(name).alias("model_type"), F.lit(ML.params_text(params)).alias("parameters"),
                          "split_date", *keys, F.col("score").cast("double").alias("score"),
                          F.col(label).cast("int").alias(label)) \
                  .write.parquet(f"{path}/point={points.index(point)}")

        # The fits are independent jobs; a few at a time keep the cluster busy between iterations.
        with ThreadPool(parallelism) as pool:
            pool.map(fit_and_score, points)
    finally:
        narrow.unpersist()
    return spark.read.parquet(path).drop("point")


def grid_results(scores: DataFrame, splits: DataFrame, keys: Sequence[str] = ("tract", "year"),
                 label: str = "label", ks: Sequence[float] = M.REPORT_K) -> DataFrame:
    """One result row per (model, parameters, split): year bounds, baseline, metrics at k, AUC."""
    runs = ["model_type", "parameters", "split_date"]
    return M.metrics_grid(scores, "score", label, keys, runs, ks).join(F.broadcast(split_bounds(splits)), "split_date")


def grid_bias(scores: DataFrame, attributes: DataFrame, names: Sequence[str], keys: Sequence[str] = ("tract", "year"), label: str = "label",
              runs: Sequence[str] = ("model_type", "parameters", "split_date"), top: float = 10.0, min_group_size: int = M.BIAS_MIN_SIZE) -> DataFrame:
    """Error rates per attribute value of every grid point's flagged top share; `attributes` has the keys and the columns `names`."""
    flagged = flag_first(scores, list(runs), M.score_rank("score", list(keys)), top)
    return M.bias_crosstab(flagged.join(attributes.select(*keys, *names), list(keys)), "flag", label, names, runs, min_group_size)
