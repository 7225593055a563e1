"""Labels, imputation, bins, one-hot, splits and the feature bases."""

from __future__ import annotations

from pyspark.sql import functions as F

from areapanel.catalog import base as B
from areapanel.catalog.aggregates import rounded, split_sql
from areapanel.catalog.base import query, table
from areapanel.catalog.joins import crime_home
from areapanel.functions import scalar as S
from areapanel.operators import features as FE
from areapanel.operators import panel as P
from areapanel.plans import panel_build
from areapanel.plans.scoring import LEVELS, split_features

LABELS = list(LEVELS)


@query("create_label", "SELECT * FROM labelled", views="panel_s cuts labelled")
def create_label(spark, folder):
    return FE.create_label(B.panel_table(spark, folder), "filings_rate")


@query("median_impute", """
SELECT tract, year, round(coalesce(filings_rate, (SELECT median(filings_rate) FROM panel_h)), 6) AS filings_rate FROM panel_h""",
       views="panel_s panel_h")
def median_impute(spark, folder):
    filled = FE.median_impute(B.panel_table(spark, folder, holes=True), ["filings_rate"])
    return rounded(filled.select("tract", "year", "filings_rate"), ["filings_rate"])


def bin_sql(value: str, low: str, high: str, out: tuple = (0, 1, 2)) -> str:
    """Right-closed equal-width bin of a non-constant column in three classes."""
    a, b, c = (repr(o) for o in out)
    return (f"CASE WHEN {value} IS NULL THEN NULL WHEN {value} <= {low} + 1 * ({high} - {low}) / 3 THEN {a} "
            f"WHEN {value} <= {low} + 2 * ({high} - {low}) / 3 THEN {b} ELSE {c} END")


RANGE_SQL = "(SELECT min(filings_rate) AS lo, max(filings_rate) AS hi FROM panel_h)"


@query("equal_width_codes", f"SELECT tract, year, {bin_sql('filings_rate', 'lo', 'hi')} AS filings_rate_group FROM panel_h, {RANGE_SQL}",
       views="panel_s panel_h")
def equal_width_codes(spark, folder):
    return FE.discretize(B.panel_table(spark, folder, holes=True), ["filings_rate"], 3).select("tract", "year", "filings_rate_group")


@query("equal_width_bins", f"""
SELECT tract, year, {bin_sql('filings_rate', 'lo', 'hi', tuple(LABELS))} AS rate_class FROM panel_h, {RANGE_SQL}""",
       views="panel_s panel_h")
def equal_width_bins(spark, folder):
    return FE.cut_column(B.panel_table(spark, folder, holes=True), "filings_rate", "rate_class", 3, LABELS).select("tract", "year", "rate_class")


@query("quantile_bins", """
SELECT o_orderkey, CASE WHEN o_totalprice <= q1 THEN 'low' WHEN o_totalprice <= q2 THEN 'medium'
  WHEN o_totalprice <= q3 THEN 'high' ELSE 'top' END AS price_class
FROM orders, (SELECT round(quantile_cont(o_totalprice, 0.25), 9) AS q1, round(quantile_cont(o_totalprice, 0.5), 9) AS q2,
  round(quantile_cont(o_totalprice, 0.75), 9) AS q3 FROM orders)""")
def quantile_bins(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return FE.quantile_bins(orders, "o_totalprice", "price_class", 4, [*LABELS, "top"]).select("o_orderkey", "price_class")


@query("one_hot", """
SELECT o_orderkey, coalesce(cast(s = 'F' AS int), 0) AS "status_F", coalesce(cast(s = 'O' AS int), 0) AS "status_O",
  coalesce(cast(s = 'P' AS int), 0) AS "status_P", coalesce(cast(s = 'X' AS int), 0) AS "status_X", cast(s IS NULL AS int) AS status_nan
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS s FROM orders)""")
def one_hot(spark, folder):
    status = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("status")
    return FE.one_hot(table(spark, folder, "orders").select("o_orderkey", status), {"status": ["F", "O", "P", "X"]})


def one_hot_sql(c: str) -> str:
    flags = [f"coalesce(cast({c}_group = '{v}' AS int), 0) AS {c}_group_{v}" for v in LABELS]
    return ", ".join([*flags, f"cast({c}_group IS NULL AS int) AS {c}_group_nan"])


@query("process_features", f"""
, s AS (SELECT round(median(filings_rate), 9) AS m, min(filings_rate) AS lo, max(filings_rate) AS hi,
  min(filings_total)::double AS tlo, max(filings_total)::double AS thi FROM panel_h),
f AS (SELECT tract, year, filings_total::double AS filings_total, coalesce(filings_rate, m) AS filings_rate, lo, hi, tlo, thi FROM panel_h, s),
g AS (SELECT *, {bin_sql('filings_rate', 'lo', 'hi', tuple(LABELS))} AS filings_rate_group,
  {bin_sql('filings_total', 'tlo', 'thi', tuple(LABELS))} AS filings_total_group FROM f)
SELECT tract, year, filings_total, round(filings_rate, 6) AS filings_rate, {one_hot_sql('filings_rate')}, {one_hot_sql('filings_total')} FROM g""",
       views="panel_s panel_h")
def process_features(spark, folder):
    columns = ["filings_rate", "filings_total"]
    panel = B.panel_table(spark, folder, holes=True).drop("commarea")
    return rounded(FE.process_features(panel, columns, 3, LABELS, impute=columns), ["filings_rate"])


@query("process_splits", f"""
, d AS (SELECT tract, make_date(year, 1, 1) AS day, filings_rate FROM panel_h),
p AS {split_sql('d', 'day')},
s AS (SELECT split_date, role, round(median(filings_rate), 9) AS m, min(filings_rate) AS lo, max(filings_rate) AS hi FROM p GROUP BY ALL),
g AS (SELECT p.split_date, p.role, tract, day, coalesce(filings_rate, m) AS filings_rate, lo, hi
      FROM p JOIN s ON p.split_date = s.split_date AND p.role = s.role),
b AS (SELECT *, {bin_sql('filings_rate', 'lo', 'hi', tuple(LABELS))} AS filings_rate_group FROM g)
SELECT split_date, role, tract, day, round(filings_rate, 6) AS filings_rate, {one_hot_sql('filings_rate')} FROM b""",
       views="panel_s panel_h")
def process_splits(spark, folder):
    panel = B.panel_table(spark, folder, holes=True).select("tract", F.make_date("year", F.lit(1), F.lit(1)).alias("day"), "filings_rate")
    splits = FE.temporal_splits(panel, "day", "1995-01-01", "2001-01-01")
    return rounded(split_features(splits, ["filings_rate"], labels=LABELS), ["filings_rate"])


@query("year_expand", f"""
SELECT tract, unnest(CASE year WHEN 1995 THEN {B.CENSUS_YEARS[1995]} ELSE {B.CENSUS_YEARS[2000]} END) AS year, population_total
FROM raw_census""", views="raw_census")
def year_expand(spark, folder):
    return P.expand_years(B.raw_census(spark, folder).select("tract", "year", "population_total"), B.CENSUS_YEARS)


@query("pre_process", """
SELECT tract, year, CASE WHEN r >= 1 THEN 1 ELSE r END AS share FROM (
  SELECT tract, year, round(coalesce(filings_rate / 2000, (SELECT median(filings_rate / 2000) FROM panel_h)), 9) AS r FROM panel_h)""",
       views="panel_s panel_h")
def pre_process(spark, folder):
    panel = B.panel_table(spark, folder, holes=True).select("tract", "year", (F.col("filings_rate") / 2000).alias("share"))
    return rounded(FE.pre_process(panel, cap="share", columns=["share"]), ["share"], 9)


@query("temporal_splits", f"SELECT o_orderkey, split_date, role FROM {split_sql('orders', 'o_orderdate')}")
def temporal_splits(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return FE.temporal_splits(orders, "o_orderdate", "1995-01-01", "2001-01-01").select("o_orderkey", "split_date", "role")


@query("holdout_split", "SELECT tract, year, CASE WHEN year <> 2001 THEN 'train' ELSE 'test' END AS role FROM panel_s",
       views="panel_s")
def holdout_split(spark, folder):
    return B.panel_dense(spark, folder).select(
        "tract", "year", F.when(F.col("year") != 2001, F.lit("train")).otherwise(F.lit("test")).alias("role"))


_GROWN = [f"perc_increase_{c}" for c in ["total_crime", *B.CLASS_COLUMNS]]
_SHARES = [f"perc_{c}" for c in B.CLASS_COLUMNS]


@query("crime_base", "SELECT tract, year, total_crime, " + ", ".join(f'"{c}"' for c in B.CLASS_COLUMNS) + ", "
       + ", ".join(f'round("{c}", 9) AS "{c}"' for c in [*_SHARES, *_GROWN]) + " FROM crime_features",
       views="incidents crime_home crime_features")
def crime_base(spark, folder):
    return rounded(P.crime_base(crime_home(spark, folder), B.CLASS_COLUMNS, first_year=B.FIRST_YEAR), [*_SHARES, *_GROWN], 9)


_STATUS_SHARES = [f"{c}_perc" for c in B.STATUS_COLUMNS]


@query("building_base", "SELECT tract, year, total_building_violations, "
       + ", ".join(f'round("{c}", 9) AS "{c}"' for c in [*_STATUS_SHARES, "perc_increase_bv"]) + " FROM building_features",
       views="violations edges violation_hits violation_panel building_features")
def building_base(spark, folder):
    panel = panel_build.violation_panel(B.violations(spark, folder), B.tract_polygons(spark, folder), B.VIOLATION_CATEGORIES)
    out = P.building_base(panel, B.STATUS_COLUMNS, first_year=B.FIRST_YEAR)
    return rounded(out.select("tract", "year", "total_building_violations", *_STATUS_SHARES, "perc_increase_bv"),
                   [*_STATUS_SHARES, "perc_increase_bv"], 9)
