"""Labels, imputation, binning, one-hot encoding and time splits."""

from __future__ import annotations

from calendar import monthrange
from collections.abc import Mapping, Sequence
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areapanel.functions.scalar import cap_at_one
from areapanel.operators.ordering import exact_quantiles
from areapanel.operators.panel import numeric_columns, with_next_year
from areapanel.operators.sizing import pin_small

# Digits a quantile is rounded to before values are compared with it.
QUANTILE_DIGITS = 9
# Aggregates per job when profiling very wide tables.
COLUMNS_PER_JOB = 200
SKETCH_ERROR = 0.02


def yearly_threshold(df: DataFrame, value: str, quantile: float, year: str = "year") -> DataFrame:
    cut = exact_quantiles(df, value, [quantile], [year], ["threshold"])
    return cut.withColumn("threshold", F.round("threshold", QUANTILE_DIGITS))


def create_label(df: DataFrame, value: str, quantile: float = 0.9, key: str = "tract", year: str = "year",
                 horizon: int = 1, drop_unlabelled: bool = False) -> DataFrame:
    """`label`: next year's value reaches next year's quantile; `label_prev_year`: same for this year.

    A row without a next year gets 0. Rows of a year whose next year has no
    threshold can be left out with `drop_unlabelled`.
    """
    cuts = pin_small(yearly_threshold(df, value, quantile, year)).frame
    own = cuts.withColumnRenamed("threshold", "_own")
    ahead = cuts.select((F.col(year) - horizon).alias(year), F.col("threshold").alias("_ahead"))
    joined = with_next_year(df, value, key, year, horizon).join(own, [year], "left").join(ahead, [year], "left")
    if drop_unlabelled:
        joined = joined.where(F.col("_ahead").isNotNull())

    def reaches(v: str, cut: str) -> Column:
        return F.coalesce(F.col(v) >= F.col(cut), F.lit(False)).cast("int")

    return joined.withColumns({"label": reaches(f"{value}_next_year", "_ahead"),
                               "label_prev_year": reaches(value, "_own")}).drop("_own", "_ahead")


def _long(df: DataFrame, columns: Sequence[str], groups: Sequence[str]) -> DataFrame:
    doubles = df.select(*groups, *[F.col(c).cast("double").alias(c) for c in columns])
    return doubles.unpivot(list(groups), list(columns), "_column", "_value")


def column_medians(df: DataFrame, columns: Sequence[str], groups: Sequence[str] = (),
                   suffix: str = "_median") -> DataFrame:
    """Exact medians of many columns at once, one row per group."""
    long = exact_quantiles(_long(df, columns, groups), "_value", [0.5], [*groups, "_column"], ["_m"])
    return long.groupBy(*groups).agg(
        *[F.max(F.when(F.col("_column") == c, F.round("_m", QUANTILE_DIGITS))).alias(f"{c}{suffix}") for c in columns])


def median_impute(df: DataFrame, columns: Sequence[str] | None = None, groups: Sequence[str] = ()) -> DataFrame:
    """Missing numbers become the column's median within the set; other types are left alone."""
    numeric = numeric_columns(df, exclude=groups)
    columns = [c for c in (columns or numeric) if c in numeric]
    if not columns:
        return df
    medians = column_medians(df, columns, groups, "__median")
    joined = _attach(df, medians, groups)
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"{c}__median")) for c in columns}
    return joined.withColumns(filled).drop(*[f"{c}__median" for c in columns])


def _attach(df: DataFrame, stats: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Per-group statistics as columns on every row."""
    if groups:
        return df.join(pin_small(stats).frame, list(groups), "left")
    row = stats.select(F.struct(*stats.columns).alias("s")).scalar()
    return df.withColumn("_stats", row).select(*df.columns, *[F.col(f"_stats.{c}").alias(c) for c in stats.columns])


def cut_edge(low: Column, high: Column, i: int, bins: int) -> Column:
    return low + F.lit(i) * (high - low) / bins


def bin_code(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based equal-width bin, right-closed, lowest value included.

    A constant column is widened by 0.1 % (0.001 around zero) on both sides first. An infinite edge raises: no
    width is equal then; cap or blank such values first.
    """
    flat = low == high
    margin = F.when(low == 0, F.lit(0.001)).otherwise(F.abs(low) * 0.001)
    lo, hi = F.when(flat, low - margin).otherwise(low), F.when(flat, high + margin).otherwise(high)
    endless = F.abs(low).isin(float("inf")) | F.abs(high).isin(float("inf"))
    chain = F.when(value.isNull(), F.lit(None).cast("int")) \
        .when(endless, F.raise_error(F.lit("cannot cut a column with infinite values into equal widths")).cast("int"))
    for i in range(1, bins):
        chain = chain.when(value <= cut_edge(lo, hi, i, bins), F.lit(i - 1))
    return chain.otherwise(F.lit(bins - 1))


def label_of(code: Column, labels: Sequence[str]) -> Column:
    chain = F
    for i, label in enumerate(labels):
        chain = chain.when(code == i, F.lit(label))
    return chain


def column_ranges(df: DataFrame, columns: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    stats = [f(F.col(c).cast("double")).alias(f"{c}{tag}")
             for c in columns for f, tag in ((F.min, "__low"), (F.max, "__high"))]
    return df.groupBy(*groups).agg(*stats)


def discretize(df: DataFrame, columns: Sequence[str], bins: int = 3, labels: Sequence[str] | None = None,
               suffix: str = "_group", groups: Sequence[str] = (), ranges: DataFrame | None = None) -> DataFrame:
    """Equal-width bin of each column as `<column><suffix>`: codes, or labels if given."""
    ranges = column_ranges(df, columns, groups) if ranges is None else ranges
    joined = _attach(df, ranges, groups)

    def bin_of(c: str) -> Column:
        code = bin_code(F.col(c).cast("double"), F.col(f"{c}__low"), F.col(f"{c}__high"), bins)
        return label_of(code, labels) if labels else code

    out = joined.withColumns({f"{c}{suffix}": bin_of(c) for c in columns})
    return out.drop(*[f"{c}{t}" for c in columns for t in ("__low", "__high")])


def cut_column(df: DataFrame, old: str, new: str, bins: int, labels: Sequence[str]) -> DataFrame:
    """Equal-width bins of one column under a new name."""
    return discretize(df, [old], bins, labels, suffix="_cut").withColumnRenamed(f"{old}_cut", new)


def quantile_bins(df: DataFrame, old: str, new: str, bins: int, labels: Sequence[str]) -> DataFrame:
    """Right-closed quantile bins with labels; repeated edges raise."""
    names = [f"e{i}" for i in range(bins + 1)]
    edges = exact_quantiles(df, old, [i / bins for i in range(bins + 1)], names=names)
    edges = edges.select(*[F.round(n, QUANTILE_DIGITS).alias(n) for n in names])
    joined = _attach(df, edges, ())
    value = F.col(old).cast("double")
    repeated = F.lit(False)
    for a, b in zip(names, names[1:]):
        repeated = repeated | (F.col(a) == F.col(b))
    chain = F.when(value.isNull(), F.lit(None).cast("string")) \
        .when(repeated, F.raise_error(F.lit("quantile edges are not unique")).cast("string"))
    for i, label in enumerate(labels[:-1], start=1):
        chain = chain.when(value <= F.col(f"e{i}"), F.lit(label))
    return joined.withColumn(new, chain.otherwise(F.lit(labels[-1]))).drop(*names)


def one_hot(df: DataFrame, levels: Mapping[str, Sequence], unlisted: str = "raise") -> DataFrame:
    """0/1 column per listed level plus `<column>_nan`; the source columns go.

    A non-null value that is not listed raises; with unlisted='other' it is 1 in `<column>_other`, with 'zero' in no column.
    """
    if unlisted not in ("raise", "other", "zero"):
        raise ValueError("unlisted is 'raise', 'other' or 'zero'")
    flags = []
    for c, values in levels.items():
        if unlisted == "other" and "other" in values:
            raise ValueError(f"{c} lists a value named other")
        listed = reduce(lambda a, b: a | b, [F.col(c) == F.lit(v) for v in values], F.col(c).isNull())
        stop = F.raise_error(F.concat(F.lit(f"{c} has a value that is not listed: "), F.col(c).cast("string"))).cast("int")
        for v in values:
            flag = F.coalesce(F.col(c) == F.lit(v), F.lit(False)).cast("int")
            flags.append((F.when(listed, flag).otherwise(stop) if unlisted == "raise" else flag).alias(f"{c}_{v}"))
        if unlisted == "other":
            flags.append((~listed).cast("int").alias(f"{c}_other"))
        flags.append(F.col(c).isNull().cast("int").alias(f"{c}_nan"))
    return df.select(*[c for c in df.columns if c not in levels], *flags)


def process_features(df: DataFrame, to_bin: Sequence[str], bins: int = 3, labels: Sequence[str] = ("low", "medium", "high"),
                     groups: Sequence[str] = (), impute: Sequence[str] | None = None,
                     fit_on: DataFrame | None = None) -> DataFrame:
    """Median fill, equal-width bins as `<column>_group`, one-hot of the bins.

    Medians and ranges come from `df` itself (per group if given), or from `fit_on`.
    """
    numeric = numeric_columns(df, exclude=groups)
    fill = [c for c in (impute if impute is not None else numeric) if c in numeric]
    source = df if fit_on is None else fit_on
    medians = column_medians(source, fill, groups, "__median") if fill else None
    # A median lies within its column's range, so filling does not move the range.
    ranges = column_ranges(source, to_bin, groups)
    if medians is not None and groups:
        stats = medians.join(ranges, list(groups))
    elif medians is not None:
        both = ranges.select(F.struct(*ranges.columns).alias("s")).scalar()
        stats = medians.withColumn("_r", both).select(*medians.columns,
                                                      *[F.col(f"_r.{c}").alias(c) for c in ranges.columns])
    else:
        stats = ranges
    joined = _attach(df, stats, groups)
    if fill:
        joined = joined.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"{c}__median")) for c in fill})
    coded = joined.withColumns({
        f"{c}_group": label_of(bin_code(F.col(c).cast("double"), F.col(f"{c}__low"), F.col(f"{c}__high"), bins), labels)
        for c in to_bin})
    kept = coded.drop(*[f"{c}__median" for c in fill], *[f"{c}{t}" for c in to_bin for t in ("__low", "__high")])
    return one_hot(kept, {f"{c}_group": labels for c in to_bin})


def pre_process(df: DataFrame, cap: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Median fill, then one column capped at 1."""
    filled = median_impute(df, columns)
    return filled.withColumn(cap, cap_at_one(cap)) if cap else filled


def _add_months(day: date, months: int) -> date:
    """The same day of a later month, or that month's last day."""
    total = day.year * 12 + day.month - 1 + months
    year, month = total // 12, total % 12 + 1
    return date(year, month, min(day.day, monthrange(year, month)[1]))


def split_table(start: str, end: str, train_months: int, test_months: int, gap_days: int = 0,
                step_months: int = 12) -> list[tuple[date, date, date, date]]:
    """Expanding windows (train start, train end, test start, test end), half-open."""
    first, last = (datetime.strptime(s, "%Y-%m-%d").date() for s in (start, end))
    out, months = [], train_months
    while first <= _add_months(last, -months):
        train_end = _add_months(first, months)
        test_start = date.fromordinal(train_end.toordinal() + gap_days)
        out.append((first, train_end, test_start, _add_months(test_start, test_months)))
        months += step_months
    return out


def temporal_splits(df: DataFrame, day: str, start: str, end: str, train_months: int = 36,
                    test_months: int = 12, gap_days: int = 0) -> DataFrame:
    """Rows repeated per split they belong to, with `split_date` and `role`.

    The split list is short, so each row meets it as an array and not in a join.
    """
    entries = []
    d = F.to_date(day)
    for first, train_end, test_start, test_end in split_table(start, end, train_months, test_months, gap_days):
        role = F.when((d >= F.lit(first)) & (d < F.lit(train_end)), F.lit("train")) \
            .when((d >= F.lit(test_start)) & (d < F.lit(test_end)), F.lit("test"))
        entries.append(F.struct(F.lit(test_start).alias("split_date"), role.alias("role")))
    if not entries:
        return df.withColumns({"split_date": F.lit(None).cast("date"), "role": F.lit(None).cast("string")}).limit(0)
    hits = F.filter(F.array(*entries), lambda e: e["role"].isNotNull())
    return df.withColumn("_s", F.explode(hits)).select(*df.columns, "_s.split_date", "_s.role")


def _column_batches(columns: Sequence[str]) -> list[list[str]]:
    return [list(columns[i:i + COLUMNS_PER_JOB]) for i in range(0, len(columns), COLUMNS_PER_JOB)]


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n_distinct) for each column, missing values left out."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column_name", "v")
    counted = long.where(F.col("v").isNotNull()).groupBy("column_name", "v").agg(F.lit(1).alias("one"))
    found = counted.groupBy("column_name").agg(F.count("*").alias("n_distinct"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return names.join(found, "column_name", "left").na.fill(0)


def continuous_columns(df: DataFrame, more_than: int = 30, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns with more than `more_than` distinct values, in table order.

    A sketch settles the columns far from the limit in one pass; only columns near
    it, which have few values, are counted exactly.
    """
    numeric = numeric_columns(df, exclude)
    wide: set[str] = set()
    for batch in _column_batches(numeric):
        rough = df.agg(*[F.approx_count_distinct(c, SKETCH_ERROR).alias(c) for c in batch]).first()
        wide |= {c for c in batch if rough[c] > 2 * more_than}
        near = [c for c in batch if more_than / 2 < rough[c] <= 2 * more_than]
        if near:
            wide |= {r.column_name for r in distinct_counts(df, near).where(F.col("n_distinct") > more_than).collect()}
    return [c for c in numeric if c in wide]


def binary_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, is_binary): every value is 0 or 1, a missing one is neither."""
    row = df.agg(*[F.bool_and(F.coalesce(F.col(c).isin(0, 1), F.lit(False))).alias(c) for c in columns])
    return row.unpivot([], list(columns), "column_name", "is_binary")


def binary_columns(df: DataFrame, exclude: Sequence[str] = ("label",)) -> list[str]:
    names = [f.name for f in df.schema.fields
             if isinstance(f.dataType, T.NumericType) and f.name not in exclude]
    found: set[str] = set()
    for batch in _column_batches(names):
        found |= {r.column_name for r in binary_flags(df, batch).where("is_binary").collect()}
    return [c for c in names if c in found]
