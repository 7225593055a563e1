"""Scalar column helpers with the panel's missing-value rules.

Missing is NULL. Text or arithmetic that yields NaN is turned into NULL, so
that comparisons, averages and quantiles skip it.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INFINITY = float("inf")


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    c = as_column(c)
    return F.when(~F.isnan(c), c)


def coerce_number(c: Column | str) -> Column:
    """Text to double; anything that is not a number becomes NULL."""
    return nan_to_null(as_column(c).try_cast("double"))


def strict_int(c: Column | str) -> Column:
    """Whole number or an error: missing and malformed input both raise."""
    c = as_column(c)
    return F.when(c.isNull(), F.raise_error(F.lit("missing value in a strict integer column"))) \
            .otherwise(c.cast("int"))


def flag_int(c: Column | str) -> Column:
    """Boolean (or its text form) to 0/1."""
    return strict_int(as_column(c).cast("boolean"))


def parse_timestamp(c: Column | str, fmt: str | None = None) -> Column:
    """Text to a zone-less timestamp; malformed text raises."""
    return F.to_timestamp_ntz(as_column(c), F.lit(fmt)) if fmt else as_column(c).cast("timestamp_ntz")


def year_of(c: Column | str) -> Column:
    return F.year(as_column(c))


def zero_pad(c: Column | str, width: int = 6) -> Column:
    """Left-pad a code with zeros; longer codes are kept whole."""
    text = as_column(c).cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def code_suffix(c: Column | str, width: int = 6) -> Column:
    return F.right(as_column(c).cast("string"), F.lit(width))


def classify(c: Column | str, classes: Mapping[str, Sequence]) -> Column:
    """Class whose code list holds the value; unlisted codes give NULL."""
    c = as_column(c)
    chain = F
    for label, codes in classes.items():
        chain = chain.when(c.isin(list(codes)), F.lit(label))
    return chain


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b where x/0 is signed infinity and 0/0 is missing."""
    a, b = as_column(a).cast("double"), as_column(b).cast("double")
    return (F.when(b != 0, a / b)
             .when((b == 0) & (a > 0), F.lit(INFINITY))
             .when((b == 0) & (a < 0), F.lit(-INFINITY)))


def shares(columns: Iterable[str], total: str, prefix: str = "", suffix: str = "") -> list[Column]:
    """One share column per input column, named prefix + column + suffix."""
    return [ratio(c, total).alias(f"{prefix}{c}{suffix}") for c in columns]


def row_sum(columns: Iterable[Column | str]) -> Column:
    """Sum across columns; missing counts as 0, so an all-missing row gives 0."""
    return reduce(lambda x, y: x + y, [F.coalesce(as_column(c), F.lit(0)) for c in columns])


def largest_share_class(labelled: Sequence[tuple[str, Column | str]], minimum: float,
                        mixed: str) -> Column:
    """Label of the largest share; ties go to the earlier entry.

    Below `minimum` the label is `mixed`; a row without any share gives NULL.
    """
    top = F.greatest(*[as_column(c) for _, c in labelled])
    chain = F.when(top < minimum, F.lit(mixed))
    for label, c in labelled:
        chain = chain.when(as_column(c) == top, F.lit(label))
    return chain


def threshold_flag(c: Column | str, limit: float, above: str, otherwise: str) -> Column:
    return F.when(as_column(c) > limit, F.lit(above)).otherwise(F.lit(otherwise))


def cap_at_one(c: Column | str) -> Column:
    """Values from 1 upward become 1; missing stays missing."""
    c = as_column(c).cast("double")
    return F.when(c >= 1, F.lit(1.0)).otherwise(c)


def blank_year(c: Column | str, year: Column | str, first_year: Column | int) -> Column:
    """Missing in the first year, unchanged afterwards."""
    return F.when(as_column(year) != first_year, as_column(c))


def rename_affixed(df: DataFrame, columns: Iterable[str], prefix: str = "", suffix: str = "") -> DataFrame:
    """Put a prefix and/or suffix on the named columns."""
    return df.withColumnsRenamed({c: f"{prefix}{c}{suffix}" for c in columns})
