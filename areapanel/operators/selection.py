"""The first rows of an order without sorting, and samples of exact size: the cut value is found by counts, and only rows tied at the cut are put in order.

`rank_cuts` narrows an interval around the value of each wanted rank: a pass reads marks of the values inside by a sketch, keeps the two marks that must hold
the rank, and counts exactly what lies above and inside. Once an interval holds few distinct values, these are counted one by one and the cut is read off.
Every pass is one aggregation combined map-side, so equal values, however many, are one row of a task. A pass that lost its rank would raise.

`flag_first` compares each row with its group's cut. Rows equal to the cut are ordered by the whole order, in range-partitioned slices, if not all of them are taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areapanel.operators.ordering import ROWS_PER_TASK, _sliced_running_totals, non_null_keys, top_count
from areapanel.session import stage

VALUES = 100_000
MARKS = 200
ACCURACY = 10_000


def _value(column: str, ascending: bool) -> Column:
    """The column as a number whose largest comes first; missing comes last where large comes first, first where small comes first."""
    number = F.col(column).cast("double")
    if ascending:
        return F.coalesce(-number, F.lit(float("inf")))
    return F.coalesce(number, F.lit(float("-inf")))


def rank_cuts(df: DataFrame, groups: Sequence[str], value: Column, wanted: Sequence[Column], values: int = VALUES) -> DataFrame:
    """(groups, i, m, cut, above, tied): the value at rank m_i from the top, the rows above it and those equal to it.

    `wanted` are expressions of the group's row count `n`; ranks of 0 have no row. `df` is read once a pass, so it should be a kept table.
    """
    groups = list(groups)
    src = non_null_keys(df, groups).select(*groups, value.alias("_v"))
    span = src.groupBy(*groups).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.approx_count_distinct("_v").alias("distinct"))
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), w.cast("long").alias("m")) for i, w in enumerate(wanted)])
    bounds = span.select(*groups, F.inline(ranks), "n", "lo", "hi", "distinct").where("m > 0 and n > 0").withColumn("m", F.least("m", "n"))
    bounds = stage(bounds.select(*groups, "i", "m", "lo", "hi", F.lit(0).cast("long").alias("above"), F.col("n").alias("inside"), "distinct"), "bounds")
    marks = [j / MARKS for j in range(MARKS + 1)]

    def joined(other: DataFrame) -> DataFrame:
        # a few numbers per group and rank
        return src.join(other, groups) if groups else src.crossJoin(F.broadcast(other))

    while (bounds.agg(F.max("distinct")).first()[0] or 0) > values:
        intervals = bounds.select(*groups, "lo", "hi").distinct()
        sketch = joined(intervals).where("_v between lo and hi").groupBy(*groups, "lo", "hi").agg(F.percentile_approx("_v", marks, ACCURACY).alias("marks"))
        at = (1 - (F.col("m") - F.col("above")) / F.col("inside")) * MARKS
        low, high = F.greatest(F.floor(at) - 1, F.lit(0)).cast("int"), F.least(F.ceil(at) + 2, F.lit(MARKS)).cast("int")
        narrowed = bounds.join(sketch, [*groups, "lo", "hi"]).select(*groups, "i", "m", F.get("marks", low).alias("lo"), F.get("marks", high).alias("hi"))
        narrowed = stage(narrowed, "narrowed")
        inner = F.col("_v").between(F.col("lo"), F.col("hi"))
        counted = joined(narrowed).groupBy(*groups, "i", "m", "lo", "hi").agg(
            F.count_if(F.col("_v") > F.col("hi")).alias("above"), F.count_if(inner).alias("inside"), F.approx_count_distinct(F.when(inner, F.col("_v"))).alias("distinct"))
        missed = (F.col("m") <= F.col("above")) | (F.col("m") > F.col("above") + F.col("inside"))
        bounds = stage(counted.withColumn("above", F.when(missed, F.raise_error(F.lit("a rank left its interval"))).otherwise(F.col("above"))), "bounds")
    own = joined(bounds.select(*groups, "i", "m", "lo", "hi", "above")).where("_v between lo and hi")
    own = own.groupBy(*groups, "i", "m", "above", "_v").agg(F.count("*").alias("tied"))
    run = Window.partitionBy(*groups, "i").orderBy(F.desc("_v")).rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("above", F.col("above") + F.coalesce(F.sum("tied").over(run), F.lit(0)))
    return own.where((F.col("above") < F.col("m")) & (F.col("m") <= F.col("above") + F.col("tied"))).select(*groups, "i", "m", F.col("_v").alias("cut"), "above", "tied")


def flag_first(df: DataFrame, groups: Sequence[str], order: Sequence[tuple[str, bool]], k: float, name: str = "flag",
               values: int = VALUES, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """0/1 flag on the first int(n*k/100) rows of each group; `order` is (column, ascending) pairs, the first of them numeric.

    Rows equal in the whole order are told apart arbitrarily. Rows whose group is missing drop out.
    """
    groups = list(groups)
    rows = stage(non_null_keys(df, groups), "to-flag")
    first, ascending = order[0]
    cuts = stage(rank_cuts(rows, groups, _value(first, ascending), [top_count(F.col("n"), k)], values).select(
        *groups, F.col("cut").alias("_cut"), (F.col("m") - F.col("above")).alias("_left"), F.col("tied").alias("_tied")), "cuts")
    if groups:
        marked = rows.join(cuts, groups, "left")
    else:
        one = cuts.first()
        marked = rows.withColumns({"_cut": F.lit(one._cut if one else None).cast("double"), "_left": F.lit(one._left if one else 0).cast("long"),
                                   "_tied": F.lit(one._tied if one else 0).cast("long")})
    v = _value(first, ascending)
    is_open = F.coalesce((v == F.col("_cut")) & (F.col("_left") < F.col("_tied")), F.lit(False))
    flag = F.coalesce(v >= F.col("_cut"), F.lit(False)).cast("int")
    decided = marked.where(~is_open).withColumn(name, flag).select(*df.columns, name)
    total = cuts.where("_left < _tied").agg(F.sum("_tied")).first()[0] or 0
    if not total:
        return decided
    by = [F.col(c).asc() if up else F.col(c).desc() for c, up in order]
    tied = marked.where(is_open).withColumn("_one", F.lit(1).cast("long"))
    placed = _sliced_running_totals(tied, groups, by, ["_one"], max(2, -(-total // rows_per_task)))
    return decided.unionByName(placed.withColumn(name, (F.col("_one_run") <= F.col("_left")).cast("int")).select(*df.columns, name))


def sample_exact(df: DataFrame, keys: Sequence[str], share: float, seed: int = 7, values: int = VALUES) -> DataFrame:
    """int(n * share) of the n rows: those with the smallest numbers drawn from a hash of their keys. The same rows at every partitioning.

    Rows with equal keys draw alike; which of them stay at the threshold is arbitrary.
    """
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in keys])
    drawn = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), drawn.alias("drawn"), *[F.col(f"`{k}`").alias(f"key{i}") for i, k in enumerate(keys)])
    flagged = flag_first(rows, [], [("drawn", True), *[(f"key{i}", True) for i in range(len(keys))]], share * 100, values=values)
    return flagged.where("flag = 1").select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns])
