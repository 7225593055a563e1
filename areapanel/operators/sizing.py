"""Checked small sides for joins.

A side is shipped to every executor only after its bytes have been counted on a written table, so it is evaluated once
whatever its size. A larger side stays distributed and is joined by a shuffle, where adaptive execution splits hot keys.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areapanel.session import stage

SMALL_ROWS = 20_000
SMALL_BYTES = 32 << 20
# What a row costs in a broadcast table beside its values.
ROW_BYTES = 64

_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.NullType, T.DayTimeIntervalType,
          T.YearMonthIntervalType)


def value_bytes(column: Column, kind: T.DataType) -> Column:
    """About the bytes a value takes in memory, without building it anew."""
    if isinstance(kind, _FIXED):
        return F.lit(16)
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return sum((value_bytes(column[f.name], f.dataType) for f in kind.fields), F.lit(16))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, _FIXED):
            return F.greatest(F.size(column), F.lit(0)) * 16 + 16
        sizes = F.transform(column, lambda v: value_bytes(v, kind.elementType).cast("long"))
        return F.coalesce(F.aggregate(sizes, F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0)) + 16
    if isinstance(kind, T.MapType):
        return value_bytes(F.map_keys(column), T.ArrayType(kind.keyType)) + value_bytes(F.map_values(column), T.ArrayType(kind.valueType))
    return F.octet_length(column.cast("string")) * 2 + 16


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row of `df` in memory."""
    return sum((value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(ROW_BYTES)).cast("long")


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes of a written table."""
    size = df.agg(F.count("*").alias("rows"), F.sum(row_bytes(df)).alias("bytes")).first()
    return size.rows, size.bytes or 0


def broadcast_by_bytes(table: DataFrame, max_bytes: int = SMALL_BYTES) -> DataFrame:
    """A written table, marked for broadcast if its counted bytes allow it."""
    return F.broadcast(table) if measured(table)[1] <= max_bytes else table


@dataclass
class Pinned:
    frame: DataFrame
    table: pa.Table | None

    @property
    def is_small(self) -> bool:
        return self.table is not None


def pin_small(df: DataFrame, max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES) -> Pinned:
    """Evaluate `df` once, as a written table, and keep it as a broadcast side if rows and bytes are few.

    The driver holds at most `max_bytes` of it.
    """
    kept = stage(df, "side")
    rows, size = measured(kept)
    if rows > max_rows or size > max_bytes:
        return Pinned(kept, None)
    table = kept.toArrow()
    return Pinned(F.broadcast(df.sparkSession.createDataFrame(table, schema=df.schema)), table)
