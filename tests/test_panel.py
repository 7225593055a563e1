import pytest
from pyspark.sql import functions as F

from areapanel.operators import panel as P


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_growth_rules(values):
    df = values([("a", 2010 + i, v) for i, v in enumerate([0, 0, 5, 10])] + [("b", 2012, 4)], "tract string, year int, n int")
    got = rows(P.growth(df, ["n"]), "tract", "year", "perc_increase_n")
    assert [g[2] for g in got] == [None, None, float("inf"), 1.0, None]
    assert P.growth(df, ["n"], inf_to_null=True).where("perc_increase_n = double('Infinity')").count() == 0


def test_pivot_drops_keys_without_a_category(values):
    df = values([("a", 1, "x", 1), ("a", 1, "y", 0), ("a", 1, None, 0), ("b", 1, None, 1), (None, 1, "x", 1)],
                "tract string, year int, kind string, flag int")
    got = P.multi_pivot(df, {"kind": ["x", "y", "z"], "flag": [0, 1]})
    assert rows(got, "tract", "total", "total_kind_x", "total_kind_y", "total_kind_z", "total_flag_0", "total_flag_1") == [
        ("a", 3, 1, 1, 0, 2, 1)]
    assert P.multi_pivot(df, {"kind": ["x"]}, keep_all=True).count() == 2


def test_pivot_columns_add_up_to_the_non_null_total(values):
    df = values([("a", 1, "x", 1), ("a", 1, "rare", 0), ("a", 1, None, 0), ("b", 1, "new", 1), ("b", 1, "new", None)],
                "tract string, year int, kind string, flag int")
    for got in (P.multi_pivot(df, {"kind": ["x", "y"], "flag": [0, 1]}, other=True), P.pivot_counts(df, "kind", ["x", "y"], other=True)):
        assert rows(got, "tract", "total_kind_x", "total_kind_y", "total_kind_other") == [("a", 1, 0, 1), ("b", 0, 0, 2)]
    assert P.pivot_counts(df, "kind", ["x"], other=True).columns == ["tract", "year", "total_kind_x", "total_kind_other"]
    for got in (P.multi_pivot(df, {"kind": ["x", "y"], "flag": [0, 1]}), P.pivot_counts(df, "kind", ["x", "y"])):
        with pytest.raises(Exception, match="rows of kind with a value that is not listed"):
            got.collect()
    with pytest.raises(ValueError, match="named other"):
        P.pivot_counts(df, "kind", ["other"], other=True)


def test_bases_blank_the_first_year_and_cap(values):
    df = values([("7", 2010, 4, 1, 3), ("7", 2011, 12, 6, 6), ("7", 2012, 6, 6, 0)],
                "tract string, year int, total_crime int, a int, b int")
    got = rows(P.crime_base(df, ["a", "b"]), "tract", "year", "perc_a", "perc_increase_total_crime", "perc_increase_b")
    assert got == [("000007", 2010, 0.25, None, None), ("000007", 2011, 0.5, 1.0, 1.0), ("000007", 2012, 1.0, -0.5, -1.0)]
    built = df.withColumnRenamed("total_crime", "total_building_violations")
    got = rows(P.building_base(built, ["a"]), "year", "a_perc", "perc_increase_bv")
    assert got == [(2010, 0.25, None), (2011, 0.5, 2.0), (2012, 1.0, -0.5)]


def test_year_expansion_and_unknown_survey(values):
    df = values([("a", "s1"), ("b", "s2")], "tract string, year string")
    got = P.expand_years(df, {"s1": [2010, 2011], "s2": [2018]})
    assert rows(got, "tract", "year") == [("a", 2010), ("a", 2011), ("b", 2018)]
    with pytest.raises(Exception, match="survey without years"):
        P.expand_years(df, {"s1": [2010]}).collect()


def test_next_year_uses_calendar_years(values):
    df = values([("a", 2010, 1), ("a", 2012, 3), ("b", 2010, 5), ("b", 2011, 6)], "tract string, year int, v int")
    assert rows(P.with_next_year(df, "v").fillna(-1), "tract", "year", "v_next_year") == [
        ("a", 2010, -1), ("a", 2012, -1), ("b", 2010, 6), ("b", 2011, -1)]


def test_group_means_skip_missing(values):
    df = values([("a", 1, 1, 2.0), ("b", 1, 1, None), ("c", 1, 1, 4.0), ("d", 2, 1, 9.0)],
                "tract string, commarea int, year int, v double")
    got = P.with_group_means(df, columns=["v"])
    assert rows(got.fillna(-1.0, ["v"]), "tract", "v_mean_by_commarea") == [("a", 3.0), ("b", 3.0), ("c", 3.0), ("d", 9.0)]


def test_join_bases_keeps_complete_keys(values):
    key = "tract string, year int, "
    base = lambda name: values([("a", 1, 1.0), ("b", 1, 2.0), ("c", 2, 3.0)], key + f"{name} double")
    partial = values([("a", 1, 1.0), ("b", 1, 2.0)], key + "crime double")
    tracts = values([("a", 10), ("b", 10), ("c", 11)], "tract string, commarea int")
    out = P.join_bases(base("rate"), base("pop"), base("edu"), partial, base("bv"), tracts)
    assert rows(out, "tract", "rate_mean_by_commarea") == [("a", 1.5), ("b", 1.5)]
    assert rows(P.join_bases(base("rate"), base("pop"), base("edu"), partial, base("bv"), tracts, tracts_first=True),
                "tract", "commarea") == [("a", 10), ("b", 10)]
    with pytest.raises(ValueError, match="rename before joining"):
        P.disjoint(base("rate"), base("rate"), P.KEY)


def test_unions(values):
    a, b = values([(1, "x")], "k int, a string"), values([(2, 0.5)], "k int, b double")
    assert P.union_by_name(a, b).columns == ["k", "a", "b"]
    assert P.union_common(a, b).columns == ["k"] and P.union_common(a, b).count() == 2


def test_outer_and_semi_join(values):
    a, b = values([("x", 1), ("y", 2)], "tract string, n int"), values([("y", 1), ("z", 0)], "tract string, p int")
    assert rows(P.outer_results(a, b).fillna(-1), "tract", "n", "p") == [("x", 1, -1), ("y", 2, 1), ("z", -1, 0)]
    assert rows(P.semi_join(a, b.where(F.col("p") == 1)), "tract") == [("y",)]
