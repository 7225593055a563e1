"""Nearest-neighbour scores by similarity hashing: approximate beside `neighbours.knn_score`, for tables that all pairs cannot meet.

Vectors are moved to the middle of the training set and rounded to integers. A table of the index has `bits` hyperplanes with coefficients of 1 and -1;
the sides on which a vector lies are its bucket, so near vectors often share one. Training vectors are kept once per table, scored rows look into their own bucket
and those that differ by up to `radius` sides. What they meet there is measured exactly, so found distances are right and only a neighbour that shares
no bucket in any table is missed. Rows that met fewer than k neighbours go the exact way.

Bits grow with the training set, so that a bucket holds about `bucket_rows` vectors. A bucket with more of them, or that more rows ask, is dealt into
blocks of bounded size that meet pairwise; equal training vectors collapse first. `enough_tables` measures the recall on a bounded sample of
rows and doubles the tables until it reaches the target.

Missing vectors, and those with missing or infinite components, are no neighbours and have no score. Several rows of equal keys keep a score each.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areapanel.operators.neighbours import _bounds, _matrix, _nearest, knn_score, mean_of_nearest
from areapanel.session import stage

TABLES = 24
RADIUS = 1
BUCKET_ROWS = 512
BLOCK_ROWS = 16_384
SAMPLE_ROWS = 200
SCALE = 256
SEED = 7
MATRIX_CELLS = 4 << 20


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def plane(seed: int, table: int, bit: int, width: int) -> list[int]:
    """1 or -1 for each component, from a hash of its place."""
    return [1 if hashlib.md5(f"{seed}:{table}:{bit}:{d}".encode()).hexdigest()[0] >= "8" else -1 for d in range(width)]


def bits_for(vectors: int, bucket_rows: int) -> int:
    return max(1, math.ceil(math.log2(max(2.0, vectors / bucket_rows))))


def _coder(origin: np.ndarray, tables: int, bits: int, seed: int):
    """Function from vectors to their bucket in every table, (rows, tables)."""
    planes = np.array([plane(seed, t, b, len(origin)) for t in range(tables) for b in range(bits)], dtype=np.float64).T
    powers = 1 << np.arange(bits, dtype=np.int64)

    def codes(x: np.ndarray) -> np.ndarray:
        # integers far below 2^53, so the product is exact
        sides = ((np.floor(SCALE * x) - origin) @ planes >= 0).reshape(len(x), tables, bits)
        return sides.astype(np.int64) @ powers
    return codes


def _found(known: DataFrame, asked: DataFrame, k: int, tables: int, radius: int, bucket_rows: int, block_rows: int, seed: int) -> DataFrame:
    """(_row, _d, _n, _s): the nearest of all that the rows meet, by distance."""
    size = known.agg(F.count("*").alias("rows"), F.max(F.size("_x")).alias("width")).first()
    means = known.select(F.posexplode("_x").alias("d", "v")).groupBy("d").agg(
        (F.sum(F.floor(F.col("v") * SCALE)) / F.count("*")).alias("m")).orderBy("d")
    origin = np.floor(np.array([r.m for r in means.collect()], dtype=np.float64))
    bits = bits_for(size.rows, bucket_rows)
    radius = min(radius, bits)
    masks = np.array([sum(1 << b for b in some) for r in range(radius + 1) for some in combinations(range(bits), r)], dtype=np.int64)

    def place(probe: np.ndarray):
        def run(batches):
            codes = _coder(origin, tables, bits, seed)
            for frame in batches:
                # few rows at a time, because each one is written once per table and mask
                for at in range(0, len(frame), 256):
                    part = frame.iloc[at:at + 256]
                    buckets = (codes(_matrix(part.iloc[:, -1]))[:, :, None] ^ probe[None, None, :]).reshape(len(part), -1)
                    out = part.iloc[np.repeat(np.arange(len(part)), buckets.shape[1])].copy()
                    out["_table"] = np.tile(np.repeat(np.arange(tables, dtype=np.int32), len(probe)), len(part))
                    out["_code"] = buckets.ravel()
                    yield out
        return run
    index = stage(known.select("_id", "_n", "_s", "_x").mapInPandas(
        place(np.zeros(1, dtype=np.int64)), "_id long, _n double, _s double, _x array<double>, _table int, _code long"), "buckets")
    probes = stage(asked.select("_row", "_t").mapInPandas(place(masks), "_row long, _t array<double>, _table int, _code long"), "probes")
    bucket = ["_table", "_code"]

    def pieces(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*bucket).agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias(name))
    sizes = stage(pieces(index, "_known_pieces").join(pieces(probes, "_row_pieces"), bucket), "bucket-sizes")

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        """Each row in one piece of its own side, beside every piece of the other."""
        met = df.join(sizes, bucket)
        return met.select(*df.columns, F.pmod(F.xxhash64(key), F.col(f"{own}_pieces")).cast("int").alias(f"{own}_piece"),
                          F.explode(F.sequence(F.lit(0), F.col(f"{other}_pieces") - 1)).alias(f"{other}_piece"))
    block = [*bucket, "_known_piece", "_row_piece"]
    left, right = dealt(index, "_id", "_known", "_row"), dealt(probes, "_row", "_row", "_known")

    def measure(known_part: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        rows, ids, ds = [], [], []
        if len(known_part) and len(part):
            x, n, names = _matrix(known_part["_x"]), known_part["_n"].to_numpy(), known_part["_id"].to_numpy()
            step = max(1, MATRIX_CELLS // len(x))
            for at in range(0, len(part), step):
                t, own = _matrix(part["_t"].iloc[at:at + step]), part["_row"].to_numpy()[at:at + step]
                squares, slack = _bounds(t, x)
                for i in range(len(t)):
                    near, d = _nearest(squares[i], slack[i], t[i], x, n, k)
                    rows.append(np.full(len(near), own[i]))
                    ids.append(near)
                    ds.append(d)
        if not rows:
            return pd.DataFrame({"_row": pd.Series(dtype="int64"), "_id": pd.Series(dtype="int64"), "_d": pd.Series(dtype="float64"),
                                 "_n": pd.Series(dtype="float64"), "_s": pd.Series(dtype="float64")})
        at = np.concatenate(ids)
        return pd.DataFrame({"_row": np.concatenate(rows), "_id": names[at], "_d": np.concatenate(ds), "_n": n[at], "_s": known_part["_s"].to_numpy()[at]})
    met = left.groupBy(*block).cogroup(right.groupBy(*block)).applyInPandas(measure, "_row long, _id long, _d double, _n double, _s double")
    # a vector met in several tables counts once
    once = met.groupBy("_row", "_id").agg(F.min("_d").alias("_d"), F.first("_n").alias("_n"), F.first("_s").alias("_s"))
    return stage(once.groupBy("_row", "_d").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s")), "near")


def _sides(train: DataFrame, test: DataFrame, keys: Sequence[str], features: str, label: str) -> tuple[DataFrame, DataFrame]:
    doubles = F.col(features).cast("array<double>")
    known = train.select(doubles.alias("_x"), F.col(label).cast("double").alias("_y")).where(_usable(F.col("_x"))).groupBy("_x").agg(
        F.count("*").cast("double").alias("_n"), F.sum("_y").alias("_s"))
    asked = test.select(F.struct(*keys).alias("_keys"), doubles.alias("_t"))
    return (stage(known.withColumn("_id", F.monotonically_increasing_id()), "known"),
            stage(asked.withColumn("_row", F.monotonically_increasing_id()), "asked"))


def hashed_knn_score(train: DataFrame, test: DataFrame, keys: Sequence[str], features: str, label: str, k: int = 5, weights: str = "uniform",
                     tables: int = TABLES, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS, block_rows: int = BLOCK_ROWS, seed: int = SEED) -> DataFrame:
    """(keys, score): mean label of the k nearest training rows that share a bucket, uniform or by 1/distance."""
    known, asked = _sides(train, test, keys, features, label)
    usable = asked.where(_usable(F.col("_t")))
    in_all = known.agg(F.sum("_n")).first()[0] or 0.0
    scores = asked.select("_row", F.lit(None).cast("double").alias("score")).limit(0)
    if in_all:
        near = _found(known, usable, k, tables, radius, bucket_rows, block_rows, seed)
        full = near.groupBy("_row").agg(F.sum("_n").alias("met")).where(F.col("met") >= min(float(k), in_all)).select("_row")
        scores = mean_of_nearest(near.join(full, "_row", "left_semi"), ["_row"], k, weights)
        rest = stage(usable.join(full, "_row", "left_anti"), "rest")
        if not rest.isEmpty():
            usable_train = train.where(_usable(F.col(features).cast("array<double>")))
            scores = scores.unionByName(knn_score(usable_train, rest.withColumnRenamed("_t", features), ["_row"], features, label, k, weights))
    return asked.join(scores, "_row", "left").select("_keys.*", "score")


def recall(train: DataFrame, test: DataFrame, features: str, k: int = 5, tables: int = TABLES, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS,
           block_rows: int = BLOCK_ROWS, sample_rows: int = SAMPLE_ROWS, seed: int = SEED) -> float:
    """Share of the k nearest that hashing meets, over a sample of at most `sample_rows` rows held against every training row."""
    vector = F.col(features).cast("array<double>")
    some = test.where(_usable(vector)).select(vector.alias("_v")).orderBy(F.xxhash64("_v", F.lit(seed))).limit(sample_rows)
    known, asked = _sides(train.select(vector.alias("_v"), F.lit(1).alias("_one")), some, ["_v"], "_v", "_one")
    if asked.isEmpty() or known.isEmpty():
        return 1.0
    # one bucket without sides to differ in holds every vector, so it gives the exact neighbours
    exact = _found(known, asked, k, 1, 1, 1 << 62, block_rows, seed)
    hashed = _found(known, asked, k, tables, radius, bucket_rows, block_rows, seed)

    def distances(near: DataFrame, name: str) -> DataFrame:
        every = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_n"))), lambda e: F.array_repeat(e["_d"], F.least(e["_n"], F.lit(k)).cast("int"))))
        return near.groupBy("_row").agg(F.slice(every, 1, k).alias(name))
    both = distances(exact, "e").join(distances(hashed, "h"), "_row", "left")
    last = F.element_at("e", -1)
    hit = F.size(F.filter(F.coalesce("h", F.array().cast("array<double>")), lambda d: d <= last)) / F.size("e")
    return float(both.agg(F.avg(hit)).first()[0])


def enough_tables(train: DataFrame, test: DataFrame, features: str, k: int = 5, target: float = 0.9, start: int = 8, most: int = 256, **options) -> int:
    """The smallest of start, 2 start, 4 start, ... tables with this recall on the sample; raises beyond `most`, where the exact way is due."""
    tables = start
    while tables <= most:
        if recall(train, test, features, k, tables, **options) >= target:
            return tables
        tables *= 2
    raise ValueError(f"{most} tables do not reach a recall of {target}; score exactly or with a larger radius")
