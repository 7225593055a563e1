"""Ranking metrics, group bias and baselines over long score tables.

A score table has one row per scored item and run; a run is named by its group
columns, such as (model, split_date). Every function evaluates all runs at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areapanel.operators.ordering import positions, running_counts, top_count
from areapanel.operators.panel import non_null_keys, union_by_name, union_common
from areapanel.operators.sizing import pin_small

# The shares of the population, in percent, that results are reported at.
REPORT_K = (1, 2, 5, 10, 20, 30, 50)
BIAS_MIN_SIZE = 0


def score_order(score: str, keys: Sequence[str]) -> list[Column]:
    """Highest score first; equal scores in key order."""
    return [F.col(score).desc(), *[F.col(k).asc() for k in keys]]


def score_rank(score: str, keys: Sequence[str]) -> list[tuple[str, bool]]:
    """The same order as (column, ascending) pairs."""
    return [(score, False), *[(k, True) for k in keys]]


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b != 0, a.cast("double") / b).otherwise(F.lit(0.0))


def harmonic(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def _counts_at(df: DataFrame, groups, score, label, keys, ks) -> DataFrame:
    """Per run: rows, positives, and for each k the flagged rows and flagged positives."""
    placed = positions(df.select(*groups, *keys, score, F.col(label).cast("long").alias("_y")),
                       groups, score_order(score, keys))
    flagged = {k: F.col("position") < top_count(F.col("group_rows"), k) for k in ks}
    return placed.groupBy(*groups).agg(
        F.sum("_y").alias("positives"), F.count("*").alias("n"),
        *[F.count_if(f).alias(f"_m{i}") for i, f in enumerate(flagged.values())],
        *[F.sum(F.when(f, F.col("_y")).otherwise(0)).alias(f"_tp{i}") for i, f in enumerate(flagged.values())])


def _prf(i: int) -> tuple[Column, Column, Column]:
    p = safe_ratio(F.col(f"_tp{i}"), F.col(f"_m{i}"))
    r = safe_ratio(F.col(f"_tp{i}"), F.col("positives"))
    return p, r, harmonic(p, r)


def at_k(df: DataFrame, score: str, label: str, keys: Sequence[str], groups: Sequence[str] = (),
         ks: Sequence[float] = REPORT_K) -> DataFrame:
    """Long form: (groups, k, precision, recall, f1)."""
    wide = _counts_at(df, list(groups), score, label, list(keys), ks)
    rows = []
    for i, k in enumerate(ks):
        p, r, f = _prf(i)
        rows.append(F.struct(F.lit(k).alias("k"), p.alias("precision"), r.alias("recall"), f.alias("f1")))
    return wide.select(*groups, F.inline(F.array(*rows)))


def metrics_grid(df: DataFrame, score: str, label: str, keys: Sequence[str], groups: Sequence[str],
                 ks: Sequence[float] = REPORT_K) -> DataFrame:
    """Wide form: one row per run with random_baseline, p/recall/f1 at every k and auc_roc."""
    wide = _counts_at(df, list(groups), score, label, list(keys), ks)
    cols = [safe_ratio(F.col("positives"), F.col("n")).alias("random_baseline")]
    for i, k in enumerate(ks):
        p, r, f = _prf(i)
        cols += [p.alias(f"p_at_{k}"), r.alias(f"recall_at_{k}"), f.alias(f"f1_at_{k}")]
    return wide.select(*groups, *cols).join(roc_auc(df, score, label, groups), list(groups), "left")


def random_baseline(df: DataFrame, label: str, groups: Sequence[str] = ()) -> DataFrame:
    """Precision when everything is flagged: the positive share."""
    return df.groupBy(*groups).agg(F.avg(F.col(label).cast("double")).alias("random_baseline"))


def score_counts(df: DataFrame, score: str, label: str, groups: Sequence[str]) -> DataFrame:
    """Rows and positives per distinct score of a run, with running sums from the top score."""
    y = F.col(label).cast("long")
    return running_counts(df, groups, score, {"_n": F.count("*"), "_pos": F.sum(y)}, descending=True)


def roc_auc(df: DataFrame, score: str, label: str, groups: Sequence[str] = ()) -> DataFrame:
    """Chance that a positive outranks a negative, ties counting half; missing if a class is absent."""
    c = score_counts(df, score, label, groups)
    # Pair counts outgrow a long on large runs, so they are doubles from the start.
    neg = (F.col("_n") - F.col("_pos")).cast("double")
    wins = F.sum(neg * (F.col("_pos_run") - F.col("_pos")) + neg * F.col("_pos") / 2)
    pairs = F.first("_pos_all").cast("double") * (F.first("_n_all") - F.first("_pos_all"))
    return c.groupBy(*groups).agg(F.when(pairs > 0, wins / pairs).alias("auc_roc"))


def pr_curve(df: DataFrame, score: str, label: str, groups: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and flagged share of the population at each distinct score.

    The curve ends at the first score that reaches full recall.
    """
    c = score_counts(df, score, label, groups)
    kept = c.where((F.col("_pos_run") - F.col("_pos") < F.col("_pos_all")))
    return kept.select(*groups, F.col(score).alias("threshold"),
                       safe_ratio(F.col("_pos_run"), F.col("_n_run")).alias("precision"),
                       safe_ratio(F.col("_pos_run"), F.col("_pos_all")).alias("recall"),
                       safe_ratio(F.col("_n_run"), F.col("_n_all")).alias("pct_population"))


def score_histogram(df: DataFrame, score: str, label: str, groups: Sequence[str] = (), bins: int = 1000) -> DataFrame:
    """(groups, bin, low, n, pos): rows and positives in `bins` equal parts of each run's range of finite scores.

    The table has at most `bins` rows per run, however many distinct scores there are, and every count is a sum. Rows without a score
    are left out; infinite scores go to the first or the last part.
    """
    groups = list(groups)
    v = F.col(score).cast("double")
    src = non_null_keys(df, groups).where(v.isNotNull() & ~F.isnan(v)).select(*groups, v.alias("_v"), F.col(label).cast("long").alias("_y"))
    finite = F.when(F.abs("_v") < float("inf"), F.col("_v"))
    span = src.groupBy(*groups).agg(F.coalesce(F.min(finite), F.lit(0.0)).alias("_lo"), F.coalesce(F.max(finite), F.lit(0.0)).alias("_hi"))
    span = pin_small(span).frame
    placed = src.join(span, groups) if groups else src.crossJoin(F.broadcast(span))  # one row
    width = (F.col("_hi") - F.col("_lo")) / bins
    part = F.when(F.col("_v") >= F.col("_hi"), bins - 1).when(F.col("_v") <= F.col("_lo"), 0) \
        .otherwise(F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col("_v") - F.col("_lo"), width)))))
    return placed.select(*groups, part.cast("int").alias("bin"), (F.col("_lo") + part * width).alias("low"), "_y") \
        .groupBy(*groups, "bin").agg(F.first("low").alias("low"), F.count("*").alias("n"), F.sum("_y").alias("pos"))


def _from_top(histogram: DataFrame, groups: Sequence[str]) -> DataFrame:
    run = Window.partitionBy(*groups).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)  # a run has few bins
    whole = Window.partitionBy(*groups)
    return histogram.withColumns({"_n_run": F.sum("n").over(run), "_pos_run": F.sum("pos").over(run),
                                  "_n_all": F.sum("n").over(whole), "_pos_all": F.sum("pos").over(whole)})


def bounded_curve(histogram: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """The curve of `pr_curve` at the lower ends of the bins of `score_histogram`, each point exact, ending at full recall.

    Between two neighbouring points recall and population share of the full curve lie between theirs.
    """
    c = _from_top(histogram, groups)
    kept = c.where(F.col("_pos_run") - F.col("pos") < F.col("_pos_all"))
    return kept.select(*groups, F.col("low").alias("threshold"), safe_ratio(F.col("_pos_run"), F.col("_n_run")).alias("precision"),
                       safe_ratio(F.col("_pos_run"), F.col("_pos_all")).alias("recall"), safe_ratio(F.col("_n_run"), F.col("_n_all")).alias("pct_population"))


def auc_bounds(histogram: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, auc_low, auc_high): the exact ROC-AUC lies between them; they differ by the share of pairs within one bin."""
    c = _from_top(histogram, groups)
    neg = (F.col("n") - F.col("pos")).cast("double")
    sure, open_ = F.sum(neg * (F.col("_pos_run") - F.col("pos"))), F.sum(neg * F.col("pos"))
    pairs = F.first("_pos_all").cast("double") * (F.first("_n_all") - F.first("_pos_all"))
    return c.groupBy(*groups).agg(F.when(pairs > 0, sure / pairs).alias("auc_low"), F.when(pairs > 0, (sure + open_) / pairs).alias("auc_high"))


def best_points(results: DataFrame, metrics: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(metric, value, keys): the runs of a result table with the largest value of each metric, all ties; `keys` name a run and its parameters."""
    keys = list(keys)
    long = results.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(keys, list(metrics), "metric", "value")
    top = F.broadcast(long.groupBy("metric").agg(F.max("value").alias("value")))  # a row per metric
    return long.join(top, ["metric", "value"]).select("metric", "value", *keys)


def bias_crosstab(df: DataFrame, flag: str, label: str, attributes: Sequence[str],
                  groups: Sequence[str] = (), min_group_size: int = BIAS_MIN_SIZE) -> DataFrame:
    """Error rates per attribute value: fnr, for, fdr, tpr, tnr; missing where undefined."""
    base = df.select(*groups, F.col(flag).alias("_f"), F.col(label).alias("_y"),
                     *[F.col(a).cast("string").alias(a) for a in attributes])
    long = base.unpivot([*groups, "_f", "_y"], list(attributes), "attribute_name", "attribute_value")

    def cell(f: int, y: int) -> Column:
        return F.count_if((F.col("_f") == f) & (F.col("_y") == y))

    cells = long.where(F.col("attribute_value").isNotNull()) \
        .groupBy(*groups, "attribute_name", "attribute_value").agg(
            F.count("*").alias("group_size"), cell(1, 1).alias("tp"), cell(1, 0).alias("fp"),
            cell(0, 1).alias("fn"), cell(0, 0).alias("tn")) \
        .where(F.col("group_size") >= min_group_size)

    def rate(a: str, *rest: str) -> Column:
        whole = F.col(a)
        for r in rest:
            whole = whole + F.col(r)
        return F.try_divide(F.col(a).cast("double"), whole)

    return cells.withColumns({"fnr": rate("fn", "tp"), "for": rate("fn", "tn"), "fdr": rate("fp", "tp"),
                              "tpr": rate("tp", "fn"), "tnr": rate("tn", "fp")})


def persistence_baseline(labelled: DataFrame, n_areas: int | Column, period: str = "year",
                         share: float = 0.1) -> DataFrame:
    """Per period, how many of this year's top areas are also next year's, over int(share * areas)."""
    hits = F.sum(F.col("label") * F.col("label_prev_year")).cast("double")
    areas = n_areas if isinstance(n_areas, Column) else F.lit(n_areas)
    return (non_null_keys(labelled, [period]).groupBy(period)
            .agg(hits.alias("_hits"))
            .select(period, F.try_divide(F.col("_hits"), F.floor(areas * F.lit(share))).alias("correct_with_baseline")))


def best_per_run(results: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("model_type", "split_date")) -> DataFrame:
    """Largest value of each metric per (model, split); missing becomes 0."""
    return non_null_keys(results, keys).groupBy(*keys).agg(*[F.max(m).alias(m) for m in metrics]) \
        .na.fill(0, subset=list(metrics))


def leaderboard(results: DataFrame, baseline: DataFrame, metric: str = "p_at_10",
                split_dates: Sequence[str] | None = None) -> DataFrame:
    """Best value per (model, split) with the persistence and random baselines as further models.

    `baseline` has split_date and the metric column.
    """
    best = best_per_run(results, [metric]).select("split_date", metric, "model_type")
    if split_dates is not None:
        baseline = baseline.where(F.col("split_date").isin(list(split_dates)))
    persistence = baseline.withColumn("model_type", F.lit("Baseline"))
    chance = results.groupBy("split_date").agg(F.avg("random_baseline").alias(metric)) \
        .withColumn("model_type", F.lit("Random Baseline"))
    return union_by_name(union_common(best, persistence), chance)
