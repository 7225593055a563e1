"""Helpers of the operators in this folder: table access, reliable stages, running totals, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from areapanel.session import scratch_path, stage

__all__ = ["QUERIES", "SQL", "as_struct", "connected_components", "from_struct", "query", "running_totals", "scratch_path", "spread_text", "stage", "table"]

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its DuckDB SQL if there is one."""
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def as_struct(df: DataFrame, columns=None) -> Column:
    """The columns as one struct, so that helper columns beside it can have any name."""
    return F.struct(*[F.col(f"`{c}`") for c in (df.columns if columns is None else columns)])


def from_struct(df: DataFrame, name: str, columns) -> DataFrame:
    """The columns out of the struct `name` again, nothing else."""
    return df.select(*[F.col(f"{name}.`{c}`").alias(c) for c in columns])


def in_bucket(key: str, modulus: int, remainder: int) -> Column:
    """crc32 of the key as text has this remainder; null keys count as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Add to each row, for every `name: column` of `sums`, the total of the rows before it in one global order.

    The rows are range-partitioned and kept as a table, so that the slices stay the same in both
    steps; each slice then adds the totals of the slices before it. Only one row per slice meets
    in one place.
    """
    sliced = stage(df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()), "slices")
    per_slice = sliced.groupBy("_slice").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select("_slice", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = sliced.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_i_{n}") for n, c in sums.items()])
    out = out.join(F.broadcast(offsets), "_slice")  # one row per slice
    return out.select(*df.columns, *[(F.col(f"_i_{n}") + F.col(f"_o_{n}")).cast("long").alias(n) for n in sums])


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, comp) for every node of edges (a, b): comp is the smallest node reachable.

    Alternates the large-star and small-star steps; hubs are combined map-side, every step is
    kept as a table, nothing but two numbers reaches the driver.
    """
    ends = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        both = ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        ends = stage(small, "edges")
        now = ends.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return stage(ends.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp").unionByName(
        ends.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()), "components")
