"""Column profiles: missing counts, summaries, correlations, histograms, box plots."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areapanel.operators.features import _attach
from areapanel.operators.ordering import exact_quantiles

QUARTILES = [0.25, 0.5, 0.75]
# Columns of a tile and rows multiplied at once: a few MB.
TILE = 128
TILE_ROWS = 4096
# A sum of squares about the mean below this share of the whole is rounding.
ROUNDING = 1e-12


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, n_missing), most missing first. One pass whatever the width."""
    columns = list(columns or df.columns)
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return row.unpivot([], columns, "column_name", "n_missing").orderBy(F.desc("n_missing"), "column_name")


def columns_with_nulls(df: DataFrame) -> list[str]:
    found = {r.column_name for r in null_profile(df).where("n_missing > 0").collect()}
    return [c for c in df.columns if c in found]


def describe_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles, one row per column."""
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    long = doubles.unpivot([], list(columns), "column_name", "v")
    basics = long.groupBy("column_name").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"))
    quartiles = exact_quantiles(long, "v", QUARTILES, ["column_name"], ["p25", "p50", "p75"])
    return basics.join(quartiles, "column_name", "left")


def column_types(df: DataFrame) -> list[tuple[str, str]]:
    return df.dtypes


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def _block_moments(width: int):
    """Batches of `width` shifted columns to one row per pair of column tiles: sums over the rows complete in both columns."""
    tiles = [(start, min(start + TILE, width)) for start in range(0, width, TILE)]
    fields = ("n", "x", "y", "xx", "yy", "xy")

    def run(batches):
        sums: dict = {}
        for batch in batches:
            for start in range(0, batch.num_rows, TILE_ROWS):
                part = batch.slice(start, TILE_ROWS)
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns]) if width else np.zeros((0, 0))
                seen = (~np.isnan(x)).astype(float)
                x = np.where(seen > 0, x, 0.0)
                for i, (a0, a1) in enumerate(tiles):
                    for j, (b0, b1) in enumerate(tiles[i:], i):
                        xa, xb, sa, sb = x[:, a0:a1], x[:, b0:b1], seen[:, a0:a1], seen[:, b0:b1]
                        got = np.stack([sa.T @ sb, xa.T @ sb, sa.T @ xb, (xa * xa).T @ sb, sa.T @ (xb * xb), xa.T @ xb])
                        sums[i, j] = sums[i, j] + got if (i, j) in sums else got
        for (i, j), got in sums.items():
            rows, cols = np.meshgrid(np.arange(*tiles[i]), np.arange(*tiles[j]), indexing="ij")
            keep = (rows <= cols).ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows.ravel()[keep], pa.int32()), pa.array(cols.ravel()[keep], pa.int32()),
                 *[pa.array(v.ravel()[keep], pa.float64()) for v in got]], ["i", "j", *fields])
    return run


def co_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, j, n, x, y, xx, yy, xy) per pair i <= j of columns: sums over the rows where both are there, taken about the columns' means.

    The plan has the same size for any number of columns. A task adds its rows up tile by tile, in matrix products, and hands on
    one row per pair; tasks meet in one aggregation on the pair. A value that is not a number counts as missing.
    """
    doubles = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in columns]
    finite = df.select(F.array(*doubles).alias("v"))
    means = finite.select(F.posexplode("v")).groupBy("pos").agg(F.avg("col").alias("mean")).toArrow()  # one number per column
    shift = dict(zip(means.column("pos").to_pylist(), means.column("mean").to_pylist()))
    moved = df.select(*[(c - F.lit(shift.get(i) or 0.0)).alias(f"c{i}") for i, c in enumerate(doubles)])
    sums = moved.mapInArrow(_block_moments(len(columns)), "i int, j int, n double, x double, y double, xx double, yy double, xy double")
    width = len(columns)
    every = df.sparkSession.range(width * width).select((F.col("id") / F.lit(width)).cast("int").alias("i"), (F.col("id") % F.lit(width)).cast("int").alias("j"))
    none = every.where("i <= j").select("i", "j", *[F.lit(0.0).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    return sums.unionByName(none).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, corr) for all pairs in both directions, each pair on its complete rows; missing where a column does not vary there."""
    columns = list(columns)
    n = F.nullif(F.col("n"), F.lit(0.0))
    vx, vy = F.col("xx") - F.col("x") * F.col("x") / n, F.col("yy") - F.col("y") * F.col("y") / n
    varies = (n > 1) & (vx > ROUNDING * F.col("xx")) & (vy > ROUNDING * F.col("yy"))
    corr = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.try_divide(F.col("xy") - F.col("x") * F.col("y") / n, F.sqrt(vx) * F.sqrt(vy)))
    names = F.array(*[F.lit(c) for c in columns])
    pairs = co_moments(df, columns).select(F.get(names, F.col("i")).alias("_a"), F.get(names, F.col("j")).alias("_b"),
                                           F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), corr))).alias("corr"))
    both = F.when(F.col("_a") == F.col("_b"), F.array(F.struct(F.col("_a").alias("a"), F.col("_b").alias("b")))).otherwise(
        F.array(F.struct(F.col("_a").alias("a"), F.col("_b").alias("b")), F.struct(F.col("_b").alias("a"), F.col("_a").alias("b"))))
    return pairs.select(F.inline(both), "corr").select("a", "b", "corr")


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """(bin, bin_start, n) of equal-width bins over the value range; the last bin is closed."""
    v = F.col(value).cast("double")
    span = df.agg(F.struct(F.min(v).alias("low"), F.max(v).alias("high")).alias("s")).scalar()
    low, high = F.col("_s.low"), F.col("_s.high")
    flat = low == high
    lo, hi = F.when(flat, low - 0.5).otherwise(low), F.when(flat, high + 0.5).otherwise(high)
    spread = df.select(v.alias("_v")).where("_v is not null").withColumn("_s", span) \
        .select("_v", lo.alias("_lo"), ((hi - lo) / bins).alias("_w"))
    code = F.least(F.floor((F.col("_v") - F.col("_lo")) / F.col("_w")).cast("int"), F.lit(bins - 1))
    return (spread.groupBy(code.alias("bin")).agg(F.count("*").alias("n"), F.first("_lo").alias("_lo"), F.first("_w").alias("_w"))
            .select("bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_start"), "n"))


def boxplot_stats(df: DataFrame, value: str, by: str) -> DataFrame:
    """Quartiles, extremes, whiskers and outlier count per group."""
    quart = exact_quantiles(df, value, QUARTILES, [by], ["p25", "p50", "p75"])
    reach = (F.col("p75") - F.col("p25")) * 1.5
    boxes = quart.withColumns({"_from": F.col("p25") - reach, "_to": F.col("p75") + reach})
    joined = _attach(df.where(F.col(value).isNotNull() & F.col(by).isNotNull()), boxes, [by])
    inside = F.col(value).between(F.col("_from"), F.col("_to"))
    return joined.groupBy(by).agg(
        F.count("*").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.first("p25").alias("p25"), F.first("p50").alias("p50"), F.first("p75").alias("p75"),
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"))
