import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from areapanel.operators import ordering as O
from areapanel.operators.sizing import pin_small as real_pin


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, and many values repeat."""
    rng = random.Random(3)
    rows = [("hot" if i % 10 else f"g{i % 3}", i, None if i % 97 == 0 else float(rng.choice([0, 0, 0, rng.randint(1, 5000)])))
            for i in range(6000)]
    return spark.createDataFrame(rows, "g string, id long, v double").cache(), pd.DataFrame(rows, columns=["g", "id", "v"])


@pytest.mark.parametrize("accuracy,rows_per_task", [(100, 10**9), (10_000, 10**9), (100, 150), (10_000, 400)])
def test_quantiles_match_linear_interpolation(skewed, accuracy, rows_per_task):
    """Accuracy 100 makes every group large enough for brackets; few rows per task force slices."""
    df, pdf = skewed
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = O.exact_quantiles(df, "v", probs, ["g"], accuracy=accuracy, rows_per_task=rows_per_task).toPandas().set_index("g").sort_index()
    want = pdf.groupby("g").v.quantile(probs).unstack()
    assert got.index.tolist() == want.index.tolist()
    for name, p in zip(got.columns, probs):
        assert got[name].tolist() == pytest.approx(want[p].tolist(), abs=1e-9)


def test_quantile_of_whole_table_and_of_nothing(skewed, spark):
    df, pdf = skewed
    assert O.exact_quantiles(df, "v", [0.9], accuracy=200).first()[0] == pytest.approx(pdf.v.quantile(0.9))
    assert O.exact_quantiles(df.where("v < 0"), "v", [0.9]).first()[0] is None


@pytest.mark.parametrize("rows_per_task", [10**9, 500])
def test_percentile_rank_averages_ties(skewed, rows_per_task):
    df, pdf = skewed
    got = O.with_percentile_rank(df, "v", ["g"], rows_per_task=rows_per_task).toPandas().sort_values("id")
    want = pdf.assign(p=pdf.groupby("g").v.rank(pct=True)).sort_values("id")
    assert got.pct_rank.fillna(-1).tolist() == pytest.approx(want.p.fillna(-1).tolist())


def test_percentile_rank_small_example(values):
    df = values([(1.0,), (2.0,), (2.0,), (3.0,), (None,)], "v double")
    got = sorted((r.v is None, r.v or 0, r.pct_rank) for r in O.with_percentile_rank(df, "v").collect())
    assert [g[2] for g in got] == [0.25, 0.625, 0.625, 1.0, None]


@pytest.mark.parametrize("rows_per_task", [10**9, 700])
def test_flags_mark_exactly_the_first_rows(skewed, rows_per_task):
    df, pdf = skewed
    scored = df.withColumn("s", F.coalesce("v", F.lit(0.0)))
    got = O.flag_top_k(scored, ["g"], [F.desc("s"), F.asc("id")], 10, rows_per_task=rows_per_task).toPandas()
    pdf = pdf.assign(s=pdf.v.fillna(0.0)).sort_values(["s", "id"], ascending=[False, True])
    for g, part in pdf.groupby("g"):
        want = set(part.id.head(int(len(part) * 0.10)))
        assert set(got[(got.g == g) & (got.flag == 1)].id) == want


def test_sliced_positions_without_groups(skewed):
    df, _ = skewed
    got = O.positions(df, [], [F.asc("id")], rows_per_task=1000)
    assert got.where(F.col("position") != F.col("id")).count() == 0
    assert got.agg(F.max("group_rows")).first()[0] == 6000


def test_no_flag_when_the_share_is_below_one_row(values):
    df = values([(i, float(i)) for i in range(9)], "id int, s double")
    assert O.flag_top_k(df, [], [F.desc("s")], 10).agg(F.sum("flag")).first()[0] == 0


def test_top_share_and_times(values):
    rows = [(t, y, float(t)) for t in range(10) for y in range(3)] + [(99, 0, None)]
    df = values(rows, "tract int, year int, v double")
    assert {r.tract for r in O.top_share(df, "v", ["year"]).collect()} == {9}
    assert {(r.tract, r.times) for r in O.times_in_top(df, "v", "year", "tract", 2).collect()} == {(8, 3), (9, 3)} or \
        {(r.tract, r.times) for r in O.times_in_top(df, "v", "year", "tract", 2).collect()} == {(9, 3), (8, 3)}


def test_outliers_and_argmax_keep_ties(values):
    df = values([(float(i % 5),) for i in range(100)] + [(500.0,), (500.0,)], "v double")
    assert [r.v for r in O.zscore_outliers(df, "v").collect()] == [500.0, 500.0]
    assert O.argmax_rows(df, "v").count() == 2


def test_quantile_classes_cover_all_rows(skewed):
    df, pdf = skewed
    got = O.quantile_classes(df.where("v > 0"), "v").groupBy("class_no").count().toPandas()
    assert got["count"].sum() == (pdf.v > 0).sum() and sorted(got.class_no) == [0, 1, 2, 3, 4]


def test_more_groups_than_a_broadcast_side_holds(skewed, monkeypatch):
    df, pdf = skewed
    monkeypatch.setattr(O, "pin_small", lambda d, max_rows=2: real_pin(d, 2))
    got = {r.g: r.q0 for r in O.exact_quantiles(df, "v", [0.5], ["g"]).collect()}
    assert got == pytest.approx(pdf.groupby("g").v.median().to_dict())
    flagged = O.flag_top_k(df, ["g"], [F.asc("id")], 10).groupBy("g").agg(F.sum("flag").alias("n")).collect()
    assert {r.g: r.n for r in flagged} == {g: int(len(p) * 0.10) for g, p in pdf.groupby("g")}
