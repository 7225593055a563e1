import pytest
from pyspark.sql import functions as F

from areapanel.functions import geometry as G
from areapanel.functions import scalar as S
from areapanel.sources import schemas as C


def column(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_ratio_follows_the_missing_value_rules(values):
    df = values([(1.0, 2.0), (1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 1.0), (1.0, None)], "a double, b double")
    assert column(df, S.ratio("a", "b")) == [0.5, float("inf"), float("-inf"), None, None, None]


def test_numbers_and_strict_integers(values):
    df = values([("1.5",), ("x",), ("nan",), (None,)], "t string")
    assert column(df, S.coerce_number("t")) == [1.5, None, None, None]
    good = values([("7",), ("0",)], "t string")
    assert column(good, S.strict_int("t")) == [7, 0]
    for bad in ([("x",)], [(None,)]):
        with pytest.raises(Exception):
            values(bad, "t string").select(S.strict_int("t")).collect()


def test_flags_accept_boolean_text(values):
    assert column(values([("true",), ("False",)], "t string"), S.flag_int("t")) == [1, 0]


def test_codes_keep_long_values(values):
    df = values([("7",), ("123456",), ("12345678",)], "t string")
    assert column(df, S.zero_pad("t")) == ["000007", "123456", "12345678"]
    assert column(df, S.code_suffix("t")) == ["7", "123456", "345678"]


def test_classify_and_unknown_code(values):
    df = values([("02",), ("05",), ("26",), ("99",), (None,)], "c string")
    assert column(df, S.classify("c", C.CRIME_CLASSES)) == [
        "Violent Crime", "Property Crime", "Less serious offences", None, None]


def test_row_sum_of_missing_is_zero(values):
    df = values([(1, None), (None, None), (2, 3)], "a int, b int")
    assert column(df, S.row_sum(["a", "b"])) == [1, 0, 5]


def test_majority_ties_minimum_and_missing(values):
    rows = [(0.5, 0.5, 0.0, 0.0), (0.3, 0.3, 0.2, 0.2), (None, 0.1, 0.1, 0.8), (None, None, None, None), (0.1, 0.4, 0.4, 0.1)]
    df = values(rows, ", ".join(f"{c} double" for _, c in C.RACE_ORDER))
    assert column(df, S.largest_share_class(C.RACE_ORDER, 0.4, "Integrated")) == ["Black", "Integrated", "Asian", None, "White"]


def test_threshold_cap_and_blank(values):
    df = values([(2010, 0.5), (2011, 3.0), (2011, None)], "year int, v double")
    assert column(df, S.threshold_flag("v", 0.6, "Poor", "Non-Poor")) == ["Non-Poor", "Poor", "Non-Poor"]
    assert column(df, S.cap_at_one("v")) == [0.5, 1.0, None]
    assert column(df, S.blank_year("v", "year", 2010)) == [None, 3.0, None]


def test_location_text_to_point(values):
    rows = [("{'latitude': '41.5', 'longitude': '-87.5', 'note': None}",), ("{'type': 'Point', 'coordinates': [-87.5, 41.5]}",),
            ("{'latitude': None, 'longitude': None}",), (None,)]
    df = values(rows, "location string").select(G.point_struct(G.parse_literal("location", G.POINT_SCHEMA)).alias("p"))
    got = [(r.p.x, r.p.y) if r.p else None for r in df.collect()]
    assert got == [(-87.5, 41.5), (-87.5, 41.5), None, None]


def test_geojson_edges_of_both_polygon_kinds(values):
    square = "[[0,0],[1,0],[1,1],[0,1],[0,0]]"
    hole = "[[0.2,0.2],[0.4,0.2],[0.2,0.4],[0.2,0.2]]"
    rows = [("{'type': 'Polygon', 'coordinates': [%s]}" % square,),
            ("{'type': 'MultiPolygon', 'coordinates': [[%s, %s], [%s]]}" % (square, hole, square),), (None,)]
    df = values(rows, "t string").select(F.size(G.geojson_edges("t")).alias("n"))
    assert [r.n for r in df.collect()] == [4, 11, None]
