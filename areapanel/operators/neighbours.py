"""Exact k-nearest-neighbour scores.

Equal training vectors are first collapsed into one row with a count. Distances are
computed block against block inside tasks, and only the nearest distances of each
scored row leave a task. Neighbours at the k-th distance share the remaining slots,
so the result does not depend on row order or partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes of training vectors that may be shipped whole to each executor.
BROADCAST_BYTES = 64 << 20
# Bytes of vectors on either side of one block pair beyond that.
BLOCK_BYTES = 64 << 20
# Distances held at a time inside a task.
MATRIX_CELLS = 8 << 20


def _bounds(test: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by a matrix product, and how far rounding can have moved each."""
    a, b = (test ** 2).sum(axis=1)[:, None], (train ** 2).sum(axis=1)[None, :]
    return a + b - 2.0 * test @ train.T, 8 * (test.shape[1] + 4) * np.finfo(np.float64).eps * (a + b)


def _nearest(row: np.ndarray, slack: np.ndarray, test: np.ndarray, train: np.ndarray, counts: np.ndarray, k: int):
    """The training rows no farther than the k-th neighbour, and their distances by differences.

    The product only preselects: every row that could be among the nearest is measured again, so equal vectors are
    at 0 and equal distances are equal, however the vectors are dealt into blocks.
    """
    width = min(k, len(row))
    # k collapsed rows hold at least k neighbours, so the k-th smallest distance bounds the search.
    near = np.flatnonzero(row - slack <= np.partition(row + slack, width - 1)[width - 1])
    d = np.sqrt(((train[near] - test) ** 2).sum(axis=1))
    order = np.argsort(d, kind="stable")
    near, d = near[order], d[order]
    last = d[min(int(np.searchsorted(np.cumsum(counts[near]), k)), len(near) - 1)]
    return near[d <= last], d[d <= last]


def _summaries(test: np.ndarray, vectors: np.ndarray, counts: np.ndarray, positives: np.ndarray, k: int):
    """(test row, distance, neighbours, label sum), equal distances merged."""
    squares, slack = _bounds(test, vectors)
    rows, ds, ns, ys = [], [], [], []
    for i in range(len(test)):
        near, distances = _nearest(squares[i], slack[i], test[i], vectors, counts, k)
        d, where = np.unique(distances, return_inverse=True)
        rows.append(np.full(len(d), i))
        ds.append(d)
        ns.append(np.bincount(where, weights=counts[near]))
        ys.append(np.bincount(where, weights=positives[near]))
    return np.concatenate(rows), np.concatenate(ds), np.concatenate(ns), np.concatenate(ys)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def knn_score(train: DataFrame, test: DataFrame, keys: Sequence[str], features: str, label: str,
              k: int = 5, weights: str = "uniform", broadcast_bytes: int = BROADCAST_BYTES,
              block_bytes: int = BLOCK_BYTES, matrix_cells: int = MATRIX_CELLS) -> DataFrame:
    """(keys, score): mean label of the k nearest training rows, uniform or by 1/distance."""
    spark = test.sparkSession
    doubles = F.col(features).cast("array<double>")
    known = (train.select(doubles.alias("_x"), F.col(label).cast("double").alias("_y"))
             .groupBy("_x").agg(F.count("*").cast("double").alias("_n"), F.sum("_y").alias("_s")))
    size = known.agg(F.count("*").alias("rows"), F.max(F.size("_x")).alias("width")).first()
    scored = test.select(*keys, doubles.alias("_t"))
    near_type = T.StructType([*[scored.schema[c] for c in keys], T.StructField("_d", T.DoubleType()),
                              T.StructField("_n", T.DoubleType()), T.StructField("_s", T.DoubleType())])
    if not size.rows:
        return test.select(*keys, F.lit(None).cast("double").alias("score"))

    def summaries(frame: pd.DataFrame, vectors, counts, positives):
        step = max(1, matrix_cells // len(vectors))
        for at in range(0, len(frame), step):
            part = frame.iloc[at:at + step]
            rows, d, n, s = _summaries(_matrix(part["_t"]), vectors, counts, positives, k)
            yield part[list(keys)].iloc[rows].assign(_d=d, _n=n, _s=s)

    if size.rows * size.width * 8 <= broadcast_bytes:
        known_pdf = known.toPandas()
        shipped = spark.sparkContext.broadcast(
            (_matrix(known_pdf["_x"]), known_pdf["_n"].to_numpy(), known_pdf["_s"].to_numpy()))

        def against_all(batches):
            for frame in batches:
                yield from summaries(frame, *shipped.value)

        near = scored.mapInPandas(against_all, near_type)
    else:
        # Every block meets every chunk once; large ones keep the copies few.
        block_rows = max(1, block_bytes // (8 * max(1, size.width)))
        blocks = -(-size.rows // block_rows)
        chunks = max(1, -(-scored.count() // block_rows))
        # Distinct vectors hash evenly, so no block or chunk outgrows its task.
        left = known.withColumn("_block", F.pmod(F.xxhash64("_x"), F.lit(blocks))) \
            .withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)).cast("array<bigint>")))
        right = scored.withColumn("_chunk", F.pmod(F.xxhash64(*keys), F.lit(chunks))) \
            .withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))

        def against_block(known_part: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
            if known_part.empty or part.empty:
                return pd.DataFrame({f.name: pd.Series(dtype="object") for f in near_type.fields})
            return pd.concat(summaries(part, _matrix(known_part["_x"]), known_part["_n"].to_numpy(),
                                       known_part["_s"].to_numpy()))

        near = left.groupBy("_block", "_chunk").cogroup(right.groupBy("_block", "_chunk")) \
            .applyInPandas(against_block, near_type) \
            .groupBy(*keys, "_d").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))

    # At most k distances per row and block are left here.
    return mean_of_nearest(near, keys, k, weights)


def mean_of_nearest(near: DataFrame, keys: Sequence[str], k: int, weights: str = "uniform") -> DataFrame:
    """(keys, score) of near (keys, _d, _n, _s): neighbours and label sum at each distance, every distance once."""
    w = Window.partitionBy(*keys).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(w), F.lit(0.0))
    taken = near.withColumn("_before", before).where(F.col("_before") < k) \
        .withColumn("_take", F.least(F.col("_n"), F.lit(float(k)) - F.col("_before")))
    if weights == "distance":
        exact = F.max(F.when(F.col("_d") == 0, 1).otherwise(0)).over(Window.partitionBy(*keys))
        weight = F.when(exact == 1, F.when(F.col("_d") == 0, F.lit(1.0)).otherwise(0.0)) \
            .otherwise(F.lit(1.0) / F.nullif(F.col("_d"), F.lit(0.0)))
    else:
        weight = F.lit(1.0)
    weighted = taken.withColumn("_w", weight * F.col("_take"))
    return weighted.groupBy(*keys).agg(
        (F.sum(F.col("_w") * F.col("_s") / F.col("_n")) / F.sum("_w")).alias("score"))
