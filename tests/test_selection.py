"""Selection at a rank against sorting, with ties, missing values, heavy values and many distinct ones."""

import random

import pytest
from pyspark.sql import functions as F

from areapanel.operators.selection import flag_first, rank_cuts, sample_exact

SCHEMA = "id int, g string, score double, label int"


def table(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        score = 5.0 if i % 3 == 0 else None if i % 50 == 1 else round(rng.gauss(5, 2), 2)  # a third of all rows share one score
        rows.append((i, ("a", "b", "b", "b", None)[i % 5], score, i % 2))
    return rows


def wanted(rows, groups, k):
    out = {}
    parts = {}
    for r in rows:
        if not groups or r[1] is not None:
            parts.setdefault(r[1] if groups else None, []).append(r)
    for part in parts.values():
        part.sort(key=lambda r: (-(float("-inf") if r[2] is None else r[2]), -r[3], r[0]))
        for place, r in enumerate(part):
            out[r[0]] = int(place < int(len(part) * k / 100 + 1e-9))
    return out


@pytest.mark.parametrize("groups", [[], ["g"]])
@pytest.mark.parametrize("k,values", [(10, 100_000), (50, 100_000), (45, 20), (100, 20), (0.001, 20)])
def test_flags_equal_sorting(spark, groups, k, values):
    rows = table(1500)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = flag_first(df, groups, [("score", False), ("label", False), ("id", True)], k, values=values, rows_per_task=100)
    assert got.columns == ["id", "g", "score", "label", "flag"]
    assert {r.id: r.flag for r in got.collect()} == wanted(rows, groups, k)


def test_no_global_window(spark):
    df = spark.createDataFrame(table(300), SCHEMA)
    plan = flag_first(df, [], [("score", False), ("id", True)], 30)._jdf.queryExecution().toString()
    assert "Exchange SinglePartition" not in plan


def test_cuts_of_several_ranks(spark):
    df = spark.createDataFrame([(i, "x", float(i // 4), 0) for i in range(4000)], SCHEMA)
    got = {r.i: (r.m, r.cut, r.above, r.tied) for r in rank_cuts(df, ["g"], F.col("score"), [F.lit(1), F.col("n") / 2, F.col("n"), F.lit(0)], values=30).collect()}
    assert got == {0: (1, 999.0, 0, 4), 1: (2000, 500.0, 1996, 4), 2: (4000, 0.0, 3996, 4)}
    assert rank_cuts(df.limit(0), [], F.col("score"), [F.lit(3)]).count() == 0


def test_sample_has_exact_size_and_ignores_partitions(spark):
    df = spark.createDataFrame([(i, None, 1.0, 0) for i in range(2000)] + [(7, "again", 1.0, 0)] * 3, SCHEMA).withColumn("drawn", F.lit(1)).withColumn("flag", F.lit(2))
    picked = [sorted(r.id for r in sample_exact(d, ["id"], 0.05, values=50).collect()) for d in (df, df.repartition(5))]
    assert picked[0] == picked[1] and len(picked[0]) == 100
    assert sample_exact(df, ["id"], 1.0).count() == 2003 and sample_exact(df, ["id"], 0.0).count() == 0
    assert sample_exact(df, ["id"], 0.05).columns == df.columns
