"""Ordered operators that stay distributed when one group holds most rows.

Three building blocks:

* `exact_quantiles` brackets every quantile with a sketch and then counts exactly,
  so only values next to a quantile are shuffled;
* `running_totals` gives cumulative sums in a total order. Groups up to
  `rows_per_task` use a window; beyond that the rows are range-partitioned on
  (group, order), and each slice adds the totals of the slices before it;
* `value_counts` collapses equal values first, so a heavy value is one row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areapanel.functions.scalar import nan_to_null
from areapanel.operators.sizing import pin_small
from areapanel.session import ensure_checkpoint_dir, stage

ROWS_PER_TASK = 2_000_000
SKETCH_ACCURACY = 10_000
# Ranks on either side of a quantile that a bracket covers, in units of the sketch error.
BRACKET_WIDTH = 8


def non_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose grouping keys are all present."""
    return df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])) if keys else df


def _bracketed_rows(n: Column, quantiles: int, accuracy: int) -> Column:
    """About how many distinct values of a group of n rows lie inside its brackets."""
    share = 2 * BRACKET_WIDTH * quantiles / accuracy
    return F.when(n <= accuracy, n).otherwise(F.ceil(n * F.lit(share)))


def _sized(stats: DataFrame) -> tuple[DataFrame, int, int, pa.Table | None]:
    """Per-group statistics as a join side, their largest and total `_rows`, and the rows if they are few."""
    pinned = pin_small(stats)
    if pinned.is_small:
        sizes = pinned.table.column("_rows").to_pylist()
        return pinned.frame, max(sizes, default=0), sum(sizes), pinned.table
    largest, total = pinned.frame.agg(F.max("_rows"), F.sum("_rows")).first()
    return pinned.frame, largest, total, None


def _quantile_names(n: int) -> list[str]:
    return [f"q{i}" for i in range(n)]


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str] = (),
                    names: Sequence[str] | None = None, accuracy: int = SKETCH_ACCURACY,
                    rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    Pass one sketches each group and reads a low and a high mark around every
    quantile. Pass two keeps only values between marks, counts everything else
    per gap, and reads the two order statistics off the exact running count.
    Groups smaller than the sketch keep all their values; where even the values
    between marks are too many for one task, the running count is sliced.
    """
    groups = list(groups)
    names = list(names or _quantile_names(len(probs)))
    slack = BRACKET_WIDTH / accuracy
    marks = [m for p in probs for m in (max(0.0, p - slack), min(1.0, p + slack))]

    src = non_null_keys(df, groups).select(*groups, nan_to_null(F.col(value).cast("double")).alias("_v")) \
        .where(F.col("_v").isNotNull())
    sketch = src.groupBy(*groups).agg(
        F.percentile_approx("_v", marks, accuracy).alias("_marks"), F.count("*").alias("_n"))
    sketch = sketch.withColumn("_rows", _bracketed_rows(F.col("_n"), len(probs), accuracy))
    sketch, largest, total, table = _sized(sketch)
    if groups:
        tagged = src.join(sketch.drop("_rows"), groups)
    else:
        row = table.to_pylist()[0]
        known = [F.lit(m) for m in row["_marks"] or [None] * len(marks)]
        tagged = src.select("_v", F.array(*known).cast("array<double>").alias("_marks"), F.lit(row["_n"]).alias("_n"))

    v, whole = F.col("_v"), F.col("_n") <= accuracy
    inside, highs = F.lit(False), []
    for i, p in enumerate(probs):
        low, high = F.col("_marks")[2 * i], F.col("_marks")[2 * i + 1]
        above_low = F.lit(True) if p - slack <= 0 else v >= low
        below_high = F.lit(True) if p + slack >= 1 else v <= high
        inside = inside | (above_low & below_high)
        highs.append(F.when(high < v, high))
    inside = whole | inside
    gap_start = F.greatest(*highs) if len(highs) > 1 else highs[0]
    keyed = tagged.select(*groups, "_n",
                          F.when(inside, v).otherwise(gap_start).alias("_key"),
                          F.when(inside, 0).otherwise(1).alias("_gap"))
    counted = keyed.groupBy(*groups, "_key", "_gap").agg(
        F.count("*").alias("_c"), F.first("_n").alias("_n"))
    ranked = _accumulate(counted, groups, [F.col("_key").asc_nulls_first(), F.col("_gap").asc()], ["_c"],
                         largest, total, rows_per_task).withColumnRenamed("_c_run", "_through")

    picks = []
    for i, p in enumerate(probs):
        spot = (F.col("_n") - 1) * F.lit(float(p))
        for tag, rank in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            hit = (F.col("_gap") == 0) & (F.col("_through") > rank) & (F.col("_through") - F.col("_c") <= rank)
            picks.append(F.max(F.when(hit, F.col("_key"))).alias(f"_{tag}{i}"))
    stats = ranked.groupBy(*groups).agg(F.first("_n").alias("_n"), *picks)
    out = []
    for i, (p, name) in enumerate(zip(probs, names)):
        spot = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        # A group without values has no quantile; a bracket that missed must not pass silently.
        missed = F.col("_n").isNotNull() & (lo.isNull() | hi.isNull())
        out.append(F.when(missed, F.raise_error(F.lit("quantile bracket missed: raise the accuracy")))
                    .otherwise(lo + (hi - lo) * (spot - F.floor(spot))).alias(name))
    return stats.select(*groups, *out)


def value_counts(df: DataFrame, groups: Sequence[str], value: str,
                 sums: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows per distinct value of a group (missing values left out)."""
    sums = dict(sums or {"_n": F.count("*")})
    return (non_null_keys(df, groups).where(F.col(value).isNotNull())
            .groupBy(*groups, value).agg(*[c.alias(n) for n, c in sums.items()]))


def running_totals(df: DataFrame, groups: Sequence[str], order: Sequence[Column], sums: Sequence[str],
                   rows_per_task: int = ROWS_PER_TASK, totals: DataFrame | None = None) -> DataFrame:
    """Cumulative `<s>_run` and whole-group `<s>_all` for each column in `sums`.

    `order` must be total within a group. The group sizes are fetched first; they
    decide whether one task per group is enough. A caller that can get them more
    cheaply passes `totals` with `_rows` (it may be approximate) and `<s>_all`.
    """
    groups = list(groups)
    if totals is None:
        totals = df.groupBy(*groups).agg(F.count("*").alias("_rows"),
                                         *[F.sum(s).alias(f"{s}_all") for s in sums])
    totals, largest, total, table = _sized(totals)

    run = _accumulate(df, groups, order, sums, largest, total, rows_per_task)
    if groups:
        return run.join(totals.drop("_rows"), groups)
    row = table.to_pylist()[0]
    return run.withColumns({f"{s}_all": F.lit(row[f"{s}_all"]) for s in sums})


def _accumulate(df: DataFrame, groups: Sequence[str], order: Sequence[Column], sums: Sequence[str],
                largest: int, total: int, rows_per_task: int) -> DataFrame:
    """`<s>_run` per row: a window per group, or slices once the largest group outgrows a task."""
    if largest > rows_per_task:
        return _sliced_running_totals(df, groups, order, sums, max(2, -(-total // rows_per_task)))
    w = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({f"{s}_run": F.sum(s).over(w) for s in sums})


def _sliced_running_totals(df, groups, order, sums, slices):
    ensure_checkpoint_dir(df.sparkSession)
    # Both uses below must see the same slices, so they are written down once.
    sliced = (df.repartitionByRange(slices, *[F.col(g) for g in groups], *order)
                .withColumn("_slice", F.spark_partition_id()).checkpoint())
    per_slice = sliced.groupBy(*groups, "_slice").agg(*[F.sum(s).alias(f"_{s}_in") for s in sums])
    earlier = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = per_slice.select(*groups, "_slice", *[
        F.coalesce(F.sum(f"_{s}_in").over(earlier), F.lit(0)).alias(f"_{s}_before") for s in sums])
    w = Window.partitionBy(*groups, "_slice").orderBy(*order) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = sliced.withColumns({f"_{s}_within": F.sum(s).over(w) for s in sums})
    joined = within.join(pin_small(before).frame, [*groups, "_slice"])
    joined = joined.withColumns({f"{s}_run": F.col(f"_{s}_within") + F.col(f"_{s}_before") for s in sums})
    return joined.drop("_slice", *[f"_{s}_{x}" for s in sums for x in ("within", "before")])


def running_counts(df: DataFrame, groups: Sequence[str], value: str, sums: Mapping[str, Column] | None = None,
                   descending: bool = False, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """One row per distinct value of a group with sums, running sums and group sums.

    Group sums come from the rows themselves with a distinct-count sketch, so the
    per-value table is shuffled once only.
    """
    sums = dict(sums or {"_n": F.count("*")})
    known = non_null_keys(df, groups).where(F.col(value).isNotNull())
    totals = known.groupBy(*groups).agg(F.approx_count_distinct(value).alias("_rows"),
                                        *[c.alias(f"{n}_all") for n, c in sums.items()])
    order = F.col(value).desc() if descending else F.col(value).asc()
    return running_totals(value_counts(df, groups, value, sums), groups, [order], list(sums), rows_per_task, totals)


def positions(df: DataFrame, groups: Sequence[str], order: Sequence[Column],
              rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """0-based `position` in each group's total order, and the group's `group_rows`."""
    run = running_totals(df.withColumn("_one", F.lit(1).cast("long")), groups, order, ["_one"], rows_per_task)
    return run.withColumns({"position": F.col("_one_run") - 1, "group_rows": F.col("_one_all")}) \
              .drop("_one", "_one_run", "_one_all")


def percentile_ranks(df: DataFrame, value: str, groups: Sequence[str] = (),
                     rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(group, value, _pct) per distinct value: average rank of ties over the non-missing count."""
    run = running_counts(df, groups, value, rows_per_task=rows_per_task)
    average_rank = F.col("_n_run") - F.col("_n") + (F.col("_n") + 1) / 2
    return run.select(*groups, value, (average_rank / F.col("_n_all")).alias("_pct"))


def with_percentile_rank(df: DataFrame, value: str, groups: Sequence[str] = (), name: str = "pct_rank",
                         rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Each row with its percentile rank; a missing value has none."""
    ranks = percentile_ranks(df, value, groups, rows_per_task).withColumnRenamed("_pct", name)
    return df.join(ranks, [*groups, value], "left")


def percentile_cut(df: DataFrame, value: str, groups: Sequence[str], limit: float,
                   strict: bool = True) -> DataFrame:
    """Per group, the smallest value whose percentile rank passes `limit`.

    The rank grows with the value, so this one number replaces a rank per row.
    """
    ranks = percentile_ranks(df, value, groups)
    passed = F.col("_pct") > limit if strict else F.col("_pct") >= limit
    return ranks.where(passed).groupBy(*groups).agg(F.min(value).alias("_cut"))


def top_share(df: DataFrame, value: str, groups: Sequence[str] = (), limit: float = 0.90,
              strict: bool = True) -> DataFrame:
    """Rows whose percentile rank within the group passes `limit`."""
    cuts = percentile_cut(df, value, groups, limit, strict)
    if not groups:
        return df.where(F.col(value) >= cuts.scalar())
    return df.join(pin_small(cuts).frame, list(groups)).where(F.col(value) >= F.col("_cut")).drop("_cut")


def times_in_top(df: DataFrame, value: str, period: str, key: str, more_than: int,
                 limit: float = 0.90) -> DataFrame:
    """Keys that are in the top share in more than `more_than` periods, with the count."""
    cuts = pin_small(percentile_cut(df, value, [period], limit, strict=False)).frame
    flagged = df.join(cuts, [period], "left")
    hit = F.coalesce(F.col(value) >= F.col("_cut"), F.lit(False)).cast("int")
    return (non_null_keys(flagged, [key]).groupBy(key).agg(F.sum(hit).alias("times"))
            .where(F.col("times") > more_than))


def top_count(n: Column, k: float) -> Column:
    """How many of n rows the first k percent are, rounded down."""
    return F.floor(n * F.lit(k / 100.0))


def flag_top_k(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: float,
               name: str = "flag", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """0/1 flag on the first int(n*k/100) rows of each group's order."""
    placed = positions(df, groups, order, rows_per_task)
    flag = (F.col("position") < top_count(F.col("group_rows"), k)).cast("int")
    return placed.withColumn(name, flag).drop("position", "group_rows")


def zscore_outliers(df: DataFrame, value: str, limit: float = 3.0) -> DataFrame:
    """Rows whose distance from the mean exceeds `limit` sample standard deviations."""
    spread = df.agg(F.struct(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")).alias("s")).scalar()
    mean, sd = spread.getField("mean"), spread.getField("sd")
    return df.where(F.abs(F.col(value) - mean) > sd * limit)


def argmax_rows(df: DataFrame, value: str) -> DataFrame:
    """Every row that reaches the column's maximum."""
    return df.where(F.col(value) == df.agg(F.max(value)).scalar())


def quantile_classes(df: DataFrame, value: str, classes: int = 5, name: str = "class_no") -> DataFrame:
    """0-based right-closed quantile class of each non-missing row, with its upper limit."""
    probs = [(i + 1) / classes for i in range(classes)]
    names = _quantile_names(classes)
    limits = exact_quantiles(df, value, probs, names=names)
    edge = limits.select(F.struct(*[F.round(n, 9).alias(n) for n in names]).alias("s")).scalar()
    kept = df.where(F.col(value).isNotNull()).withColumn("_e", edge)
    code, upper = F, F
    for i, n in enumerate(names):
        fits = F.lit(True) if i == classes - 1 else F.col(value) <= F.col(f"_e.{n}")
        code = code.when(fits, F.lit(i))
        upper = upper.when(fits, F.col(f"_e.{n}"))
    return kept.withColumns({name: code, "upper_limit": upper}).drop("_e")
