"""Panel building: counts per (area, year), growth, expansion, base joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areapanel.functions.scalar import blank_year, cap_at_one, ratio, shares, zero_pad
from areapanel.operators.ordering import non_null_keys
from areapanel.operators.sizing import pin_small
from areapanel.session import stage

KEY = ("tract", "year")


def group_count(df: DataFrame, keys: Sequence[str] = KEY, name: str = "total") -> DataFrame:
    return non_null_keys(df, keys).groupBy(*keys).agg(F.count("*").alias(name))


def pivot_name(column: str, value) -> str:
    return f"total_{column}_{value}"


def pivot_counts(df: DataFrame, column: str, values: Sequence, keys: Sequence[str] = KEY, other: bool = False) -> DataFrame:
    """Rows per category value as columns; absent pairs are 0. Unlisted values as in `multi_pivot`."""
    return multi_pivot(df, {column: values}, keys, total=None, other=other)


def multi_pivot(df: DataFrame, categories: Mapping[str, Sequence], keys: Sequence[str] = KEY,
                total: str | None = "total", keep_all: bool = False, other: bool = False) -> DataFrame:
    """Total and one count column per listed category value, in one aggregation.

    A key whose category is missing on every row drops out, unless `keep_all`. The counts of a category add up to its
    non-null rows: values that are not listed raise, or with `other` are counted in `total_<column>_other`.
    """
    for c, values in categories.items():
        if other and "other" in values:
            raise ValueError(f"{c} lists a value named other")
    counts = [F.count_if(F.col(c) == F.lit(v)).alias(pivot_name(c, v))
              for c, values in categories.items() for v in values]
    present = {c: f"_has_{i}" for i, c in enumerate(categories)}
    totals = [F.count("*").alias(total)] if total else []
    out = non_null_keys(df, keys).groupBy(*keys).agg(
        *totals, *counts, *[F.count(c).alias(p) for c, p in present.items()])
    if not keep_all:
        out = out.where(reduce(lambda a, b: a & b, [F.col(p) > 0 for p in present.values()]))
    columns = []
    for c, values in categories.items():
        names = [pivot_name(c, v) for v in values]
        unlisted = reduce(lambda a, b: a - b, [F.col(f"`{n}`") for n in names], F.col(present[c]))
        if other:
            columns += [*[F.col(f"`{n}`") for n in names], unlisted.alias(pivot_name(c, "other"))]
        else:
            stop = F.raise_error(F.concat(F.lit(f"rows of {c} with a value that is not listed: "), unlisted.cast("string"))).cast("long")
            columns += [F.when(unlisted == 0, F.col(f"`{n}`")).otherwise(stop).alias(n) for n in names]
    return out.select(*keys, *([total] if total else []), *columns)


def growth(df: DataFrame, columns: Sequence[str], key: str = "tract", year: str = "year",
           prefix: str = "perc_increase_", inf_to_null: bool = False) -> DataFrame:
    """Relative change against the area's previous row; its first row has none.

    One area's rows are its years, so the window stays small however many areas there are.
    """
    w = Window.partitionBy(key).orderBy(year)

    def change(c: str) -> Column:
        before = F.lag(c).over(w)
        g = ratio(F.col(c) - before, before)
        return F.when(F.abs(g) != float("inf"), g) if inf_to_null else g

    return df.withColumns({f"{prefix}{c}": change(c) for c in columns})


def crime_base(df: DataFrame, classes: Sequence[str], total: str = "total_crime",
               first_year: int = 2010) -> DataFrame:
    """Class shares, and growth of total and classes: capped at 1, blank in the first year."""
    padded = df.withColumn("tract", zero_pad("tract"))
    grown = growth(padded.select("*", *shares(classes, total, prefix="perc_")), [total, *classes])
    return grown.withColumns({f"perc_increase_{c}": blank_year(cap_at_one(f"perc_increase_{c}"), "year", first_year)
                              for c in [total, *classes]})


def building_base(df: DataFrame, categories: Sequence[str], total: str = "total_building_violations",
                  first_year: int = 2010, inf_to_null: bool = False) -> DataFrame:
    """Category shares, and uncapped growth of the total, blank in the first year."""
    padded = df.withColumn("tract", zero_pad("tract"))
    grown = growth(padded.select("*", *shares(categories, total, suffix="_perc")), [total],
                   prefix="_growth_", inf_to_null=inf_to_null)
    return grown.withColumn("perc_increase_bv", blank_year(f"_growth_{total}", "year", first_year)) \
                .drop(f"_growth_{total}")


def expand_years(df: DataFrame, years: Mapping, year: str = "year") -> DataFrame:
    """Repeat each survey row over the years its survey stands for.

    A survey that is not listed raises, so no row is lost silently.
    """
    chain = F
    for survey, covered in years.items():
        chain = chain.when(F.col(year) == F.lit(survey), F.array(*[F.lit(int(y)) for y in covered]))
    unknown = F.raise_error(F.concat(F.lit("survey without years: "), F.col(year).cast("string")))
    return df.withColumn(year, F.explode(chain.otherwise(unknown.cast("array<int>"))))


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def group_means(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None,
                suffix: str = "") -> DataFrame:
    columns = columns or numeric_columns(df, exclude=keys)
    return non_null_keys(df, keys).groupBy(*keys).agg(*[F.avg(c).alias(f"{c}{suffix}") for c in columns])


def with_group_means(df: DataFrame, keys: Sequence[str] = ("commarea", "year"),
                     columns: Sequence[str] | None = None, suffix: str = "_mean_by_commarea") -> DataFrame:
    """Each row with the means of its group.

    Means are aggregated map-side and joined back; a window would sort every row
    of a group in one task.
    """
    return df.join(pin_small(group_means(df, keys, columns, suffix)).frame, list(keys))


def dimension_join(df: DataFrame, dim: DataFrame, key: str = "tract", dim_first: bool = False) -> DataFrame:
    small = pin_small(dim).frame
    return small.join(df, key) if dim_first else df.join(small, key)


def disjoint(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join that refuses names both sides use beyond the keys."""
    shared = (set(left.columns) & set(right.columns)) - set(keys)
    if shared:
        raise ValueError(f"rename before joining: {sorted(shared)}")
    return left.join(right, list(keys))


def join_bases(rates: DataFrame, census: DataFrame, education: DataFrame, crime: DataFrame,
               building: DataFrame, tracts: DataFrame, tracts_first: bool = False,
               mean_columns: Sequence[str] | None = None) -> DataFrame:
    """Modelling table: five bases on (tract, year), the tract dimension, group means."""
    joined = reduce(lambda a, b: disjoint(a, b, KEY), [rates, census, education, crime, building])
    # The means read the joined table a second time.
    joined = stage(dimension_join(joined, tracts, dim_first=tracts_first), "joined-bases")
    return with_group_means(joined, columns=mean_columns)


def with_next_year(df: DataFrame, value: str, key: str = "tract", year: str = "year",
                   horizon: int = 1) -> DataFrame:
    """Each row with its own value `horizon` years later (missing if there is no such row)."""
    ahead = df.select(key, (F.col(year) - horizon).alias(year), F.col(value).alias(f"{value}_next_year"))
    return df.withColumn("next_year", F.col(year) + horizon).join(ahead, [key, year], "left")


def outer_results(polygons: DataFrame, predictions: DataFrame, key: str = "tract") -> DataFrame:
    return polygons.join(predictions, key, "full_outer")


def semi_join(df: DataFrame, keys: DataFrame, key: str = "tract") -> DataFrame:
    return df.join(keys.select(key), key, "left_semi")


def union_by_name(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_common(*frames: DataFrame) -> DataFrame:
    """Union on the columns every input has, in the first input's order."""
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    return reduce(lambda a, b: a.unionByName(b), [f.select(common) for f in frames])
