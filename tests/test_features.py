from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from areapanel.operators import features as FE
from areapanel.plans import scoring


def test_label_edges(values):
    rows = [(f"t{i}", y, float(i + 10 * (y == 2012))) for i in range(10) for y in (2010, 2011)]
    rows += [("gap", 2010, 99.0), ("gap", 2012, 99.0), ("none", 2011, None)]
    df = FE.create_label(values(rows, "tract string, year int, rate double"), "rate")
    got = {(r.tract, r.year): (r.label, r.label_prev_year) for r in df.collect()}
    assert got[("t9", 2010)] == (1, 1) and got[("t8", 2010)] == (0, 0)
    assert got[("gap", 2010)] == (0, 1) and got[("gap", 2012)] == (0, 1)
    assert got[("none", 2011)] == (0, 0)
    assert all(v[0] == 0 for (t, y), v in got.items() if y == 2012)
    assert len(got) == len(rows)


def test_unlabelled_years_can_be_dropped(values):
    df = values([(t, y, 1.0) for t in "ab" for y in (2010, 2011)], "tract string, year int, rate double")
    assert {r.year for r in FE.create_label(df, "rate", drop_unlabelled=True).collect()} == {2010}


@pytest.mark.parametrize("data", [[0, 1, 2, 3, None], [5, 5, 5, None], [0, 0, 0], [-3, 4, 10, 11.5, 2]])
def test_bins_match_equal_width_cut(values, data):
    got = FE.discretize(values([(float(v) if v is not None else None, i) for i, v in enumerate(data)], "v double, i int"),
                        ["v"], 3, ["low", "medium", "high"]).orderBy("i").toPandas().v_group
    want = pd.cut(pd.Series(data, dtype=float), 3, labels=["low", "medium", "high"], include_lowest=True)
    assert got.where(got.notna(), None).tolist() == want.astype(object).where(want.notna(), None).tolist()


def test_quantile_bins_match_and_reject_repeated_edges(values):
    data = [3.1, 8.2, 1.7, 9.9, 4.4, 6.3, 7.7, 2.2, None]
    df = values([(v, i) for i, v in enumerate(data)], "v double, i int")
    got = FE.quantile_bins(df, "v", "c", 4, list("abcd")).orderBy("i").toPandas().c
    want = pd.qcut(pd.Series(data), 4, labels=list("abcd"))
    assert got.where(got.notna(), None).tolist() == want.astype(object).where(want.notna(), None).tolist()
    with pytest.raises(Exception, match="not unique"):
        FE.quantile_bins(values([(1.0, 1), (1.0, 2), (1.0, 3), (2.0, 4)], "v double, i int"), "v", "c", 4, list("abcd")).collect()


def test_one_hot_has_absent_levels_and_missing_column(values):
    out = FE.one_hot(values([("x", 1), (None, 2)], "c string, i int"), {"c": ["x", "y"]}).orderBy("i")
    assert out.columns == ["i", "c_x", "c_y", "c_nan"]
    assert [tuple(r) for r in out.collect()] == [(1, 1, 0, 0), (2, 0, 0, 1)]


def test_one_hot_of_unlisted_values(values):
    df = values([("x", 1), (None, 2), ("z", 3)], "c string, i int")
    out = FE.one_hot(df, {"c": ["x", "y"]}, unlisted="other").orderBy("i")
    assert out.columns == ["i", "c_x", "c_y", "c_other", "c_nan"]
    assert [tuple(r) for r in out.collect()] == [(1, 1, 0, 0, 0), (2, 0, 0, 0, 1), (3, 0, 0, 1, 0)]
    with pytest.raises(Exception, match="not listed: z"):
        FE.one_hot(df, {"c": ["x", "y"]}).collect()


def test_medians_fill_per_group_and_skip_text(values):
    df = values([("a", 1.0, None), ("a", 3.0, "x"), ("a", None, None), ("b", 10.0, None), ("b", None, "y")],
                "g string, v double, t string")
    got = FE.median_impute(df, groups=["g"]).groupBy("g").agg(F.sum("v").alias("s"), F.count("t").alias("t")).orderBy("g")
    assert [tuple(r) for r in got.collect()] == [("a", 6.0, 1), ("b", 20.0, 1)]


def test_process_features_keeps_rows_and_one_level_each(values):
    df = values([(i, float(i) if i % 4 else None) for i in range(40)], "id int, v double")
    out = FE.process_features(df, ["v"])
    flags = ["v_group_low", "v_group_medium", "v_group_high", "v_group_nan"]
    assert out.count() == 40
    assert out.where(sum(F.col(c) for c in flags) != 1).count() == 0
    assert out.where("v_group_nan = 1 or v is null").count() == 0


def test_split_table_defaults():
    starts = [t[2] for t in FE.split_table("2010-01-01", "2016-01-01", 36, 12)]
    assert starts == [date(y, 1, 1) for y in (2013, 2014, 2015, 2016)]
    gapped = FE.split_table("2010-01-01", "2016-01-01", 36, 12, gap_days=30)[0]
    assert gapped[1] == date(2013, 1, 1) and gapped[2] == date(2013, 1, 31)


def test_splits_are_disjoint_and_expand(values):
    df = values([(f"{y}-0{m}-01", y) for y in range(2010, 2018) for m in (1, 6)], "d string, y int") \
        .withColumn("d", F.to_date("d"))
    out = FE.temporal_splits(df, "d", "2010-01-01", "2016-01-01").groupBy("split_date", "role").agg(
        F.count("*").alias("n"), F.min("y").alias("a"), F.max("y").alias("b")).orderBy("split_date", "role")
    got = [(r.split_date.year, r.role, r.n, r.a, r.b) for r in out.collect()]
    assert got[:2] == [(2013, "test", 2, 2013, 2013), (2013, "train", 6, 2010, 2012)]
    assert got[-1] == (2016, "train", 12, 2010, 2015)


def test_split_features_use_own_or_train_ranges(values):
    rows = [(f"{y}-01-01", float(v)) for y, vs in ((2010, range(0, 10)), (2011, range(100, 110))) for v in vs]
    df = values(rows, "d string, v double").withColumn("d", F.to_date("d"))
    splits = FE.temporal_splits(df, "d", "2010-01-01", "2011-01-01", train_months=12)
    own = scoring.split_features(splits, ["v"])
    train = scoring.split_features(splits, ["v"], fit_on="train")
    assert own.where("role = 'test' and v_group_low = 1").count() > 0
    assert train.where("role = 'test' and v_group_high = 1").count() == 10


def test_column_pickers(values):
    df = values([(i, i % 2, i % 3, 1 if i % 2 else None, str(i), 0) for i in range(40)],
                "wide int, flag int, three int, holes int, text string, label int")
    assert FE.continuous_columns(df) == ["wide"]
    assert FE.binary_columns(df) == ["flag"]


def test_pre_process_caps(values):
    out = FE.pre_process(values([(0.5,), (None,), (7.0,)], "v double"), cap="v")
    assert sorted(r.v for r in out.collect()) == [0.5, 1.0, 1.0]


def test_month_ends_are_clamped():
    from datetime import date

    from areapanel.operators.features import _add_months
    assert _add_months(date(2010, 1, 31), 1) == date(2010, 2, 28)
    assert _add_months(date(2012, 1, 31), 13) == date(2013, 2, 28)
    assert _add_months(date(2010, 11, 30), 3) == date(2011, 2, 28)
    assert _add_months(date(2010, 3, 15), 12) == date(2011, 3, 15)


@pytest.mark.parametrize("edge", [float("inf"), float("-inf")])
def test_infinite_values_have_no_equal_widths(values, edge):
    df = values([(0.0,), (1.0,), (edge,)], "x double")
    with pytest.raises(Exception, match="infinite"):
        FE.discretize(df, ["x"]).collect()
