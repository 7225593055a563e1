import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from areapanel.operators import profile as PR
from areapanel.session import scratch_path, shared_folder
from areapanel.sources import landed as L
from areapanel.sources import schemas as C

DATA = [(float(i % 7), float(i * i % 23) if i % 5 else None, "ab"[i % 2]) for i in range(60)]


@pytest.fixture(scope="module")
def both(spark):
    return spark.createDataFrame(DATA, "a double, b double, g string"), pd.DataFrame(DATA, columns=["a", "b", "g"])


def test_profiles_match_pandas(both):
    df, pdf = both
    assert [(r.column_name, r.n_missing) for r in PR.null_profile(df).collect()] == [("b", 12), ("a", 0), ("g", 0)]
    assert PR.columns_with_nulls(df) == ["b"]
    got = PR.describe_stats(df, ["a", "b"]).toPandas().set_index("column_name")
    want = pdf[["a", "b"]].describe().T
    for mine, theirs in (("n", "count"), ("mean", "mean"), ("std", "std"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")):
        assert got[mine].to_dict() == pytest.approx(want[theirs].to_dict())
    corr = {(r.a, r.b): r["corr"] for r in PR.corr_matrix(df, ["a", "b"]).collect()}
    assert len(corr) == 4 and corr[("a", "b")] == pytest.approx(pdf.a.corr(pdf.b)) and corr[("a", "a")] == 1.0
    assert PR.shape(df).first().asDict() == {"n_rows": 60, "n_columns": 3}


def test_histogram_closes_the_last_bin(values):
    got = {r.bin: r.n for r in PR.histogram(values([(0.0,), (1.0,), (9.9,), (10.0,), (None,)], "v double"), "v", 10).collect()}
    assert got == {0: 1, 1: 1, 9: 2}
    assert PR.histogram(values([(3.0,), (3.0,)], "v double"), "v", 4).first().n == 2


def test_boxplot_whiskers(values):
    df = values([("g", float(v)) for v in [1, 2, 3, 4, 100]], "g string, v double")
    r = PR.boxplot_stats(df, "v", "g").first()
    assert (r.p50, r.whisker_low, r.whisker_high, r.outliers) == (3.0, 1.0, 4.0, 1)


def test_scans_filters_and_guard(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(2010, "p"), (2012, "q"), (2015, "r")], "year int, the_geom string").write.parquet(path)
    df = L.scan(spark, path, first_year=2010, last_year=2012)
    assert df.columns == ["year", "location"] and df.count() == 2
    assert "PushedFilters: [IsNotNull(year), GreaterThanOrEqual(year,2010)" in df._jdf.queryExecution().toString()
    assert L.scan(spark, path, limit=1).count() == 1
    assert L.csv_or_none(spark, path + "-absent") is None
    L.write_csv(df, str(tmp_path / "c"))
    assert L.csv_or_none(spark, str(tmp_path / "c"), "year int, location string").count() == 2
    L.write_table(df, str(tmp_path / "p"), by=["year"])
    assert spark.read.parquet(str(tmp_path / "p")).where("year = 2010").count() == 1


def test_date_years_are_pushed_as_a_range(spark):
    df = L.between_years(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), "o_orderdate", 1996, 1997, is_date=True)
    assert "GreaterThanOrEqual(o_orderdate" in df._jdf.queryExecution().toString()
    text = spark.createDataFrame([("2010-05-01T00:00:00",), ("2012-01-01T00:00:00",)], "d string")
    assert L.between_years(text, "d", 2010, 2011, is_date=True).count() == 1


def test_fixed_lists_have_the_published_sizes():
    assert len(C.RATE_COLUMNS) == 40 and len(set(C.RATE_COLUMNS)) == 40
    for year, total in ((2010, 32), (2017, 24)):
        codes = [c for lv in C.EDUCATION_LEVELS[year] for c in L.census_codes(year, lv)]
        assert len(codes) == len(set(codes)) == total
    assert L.census_codes(2010, "associate") == ["B15002_014E", "B15002_031E"]


def test_education_shares_sum_to_one(values):
    codes = [c for lv in C.EDUCATION_LEVELS[2017] for c in L.census_codes(2017, lv)]
    row = {**{c: float(i) for i, c in enumerate(codes)}, "B15003_001E": float(sum(range(len(codes)))), "tract": "42", "county": "031"}
    df = values([tuple(row.values())], ", ".join(f"{k} {'string' if k in ('tract', 'county') else 'double'}" for k in row))
    out = L.education_shares({2017: df})
    assert out.select(sum(F.col(lv) for lv in C.EDUCATION_LEVELS[2017])).first()[0] == pytest.approx(1.0)
    assert out.columns[-4:] == ["year", "tract", "county", "pop_over_25"]
    assert L.education_base(out).first().tract == "000042"


def test_shared_folder_is_the_configured_one(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_folder(spark) == named
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_correlation_of_five_hundred_columns_against_pandas(spark, values):
    rng = np.random.default_rng(3)
    data = rng.normal(1e6, 1, (60, 500))
    data[:, 1] = data[:, 0] * -2 + 5
    data[:, 2] = 7.0
    data[rng.random((60, 500)) < 0.1] = np.nan
    data[1:, 3] = np.nan
    names = [f"a.{i}" if i == 4 else f"c{i}" for i in range(500)]
    frame = pd.DataFrame(data, columns=names)
    found = PR.corr_matrix(spark.createDataFrame(frame), names)
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 200_000
    got = found.toPandas().pivot(index="a", columns="b", values="corr").loc[names, names].to_numpy(float)
    want = frame.corr(min_periods=2).to_numpy()
    want[2] = want[:, 2] = want[3] = want[:, 3] = np.nan
    assert np.allclose(got, want, atol=1e-7, equal_nan=True)


def test_correlation_of_no_rows_is_missing(values):
    rows = PR.corr_matrix(values([], "a double, b double"), ["a", "b"]).collect()
    assert all(r["corr"] is None for r in rows)
