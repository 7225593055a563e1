"""Aggregations, pivots and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from areapanel.catalog import base as B
from areapanel.catalog.base import query, table
from areapanel.operators import features as FE
from areapanel.operators import metrics as M
from areapanel.operators import ordering as O
from areapanel.operators import panel as P
from areapanel.operators import profile as PR
from areapanel.plans import panel_build
from areapanel.plans.scoring import split_bounds as bounds_of


def rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("group_count", "SELECT tract, year, count(*) AS total FROM incidents GROUP BY ALL", views="incidents")
def group_count(spark, folder):
    return P.group_count(B.incidents(spark, folder))


@query("pivot_counts", f"SELECT tract, year, {B.pivot_sql({'primary_type': B.PART_TYPES})} FROM incidents "
       "GROUP BY tract, year HAVING count(primary_type) > 0", views="incidents")
def pivot_counts(spark, folder):
    return P.pivot_counts(B.incidents(spark, folder), "primary_type", B.PART_TYPES)


@query("multi_pivot_panel", f"SELECT tract, year, count(*) AS total, {B.pivot_sql(B.CRIME_CATEGORIES)} FROM incidents "
       f"GROUP BY tract, year HAVING {B.having_sql(B.CRIME_CATEGORIES)}", views="incidents")
def multi_pivot_panel(spark, folder):
    return P.multi_pivot(B.incidents(spark, folder), B.CRIME_CATEGORIES)


@query("crime_panel", f"SELECT h.tract, year, count(*) AS total_crime, {B.pivot_sql(B.CRIME_CATEGORIES)} "
       "FROM incidents i JOIN incident_hits h ON i.x = h.x AND i.y = h.y "
       f"GROUP BY h.tract, year HAVING {B.having_sql(B.CRIME_CATEGORIES)}", views="incidents edges incident_hits")
def crime_panel(spark, folder):
    return panel_build.crime_panel(B.incidents(spark, folder), B.tract_polygons(spark, folder), B.CRIME_CATEGORIES)


@query("violation_panel", "SELECT * FROM violation_panel", views="violations edges violation_hits violation_panel")
def violation_panel(spark, folder):
    return panel_build.violation_panel(B.violations(spark, folder), B.tract_polygons(spark, folder), B.VIOLATION_CATEGORIES)


@query("group_means", """
SELECT commarea, year, round(avg(filings_total), 6) AS filings_total, round(avg(filings_rate), 6) AS filings_rate
FROM panel_h GROUP BY ALL""", views="panel_s panel_h")
def group_means(spark, folder):
    return rounded(P.group_means(B.panel_holes(spark, folder), ["commarea", "year"]), ["filings_total", "filings_rate"])


@query("group_sum", "SELECT tract, sum(label)::bigint AS times FROM labelled GROUP BY tract", views="panel_s cuts labelled")
def group_sum(spark, folder):
    labelled = FE.create_label(B.panel_table(spark, folder), "filings_rate")
    return labelled.groupBy("tract").agg(F.sum("label").alias("times"))


@query("random_baseline_mean", """
SELECT split_date, round(avg(b), 9) AS p_at_10 FROM (SELECT model, split_date, avg(label) AS b FROM scored_runs GROUP BY ALL) GROUP BY split_date""",
       views="scored scored_runs")
def random_baseline_mean(spark, folder):
    runs = M.random_baseline(B.scored_runs(spark, folder), "label", ["model", "split_date"])
    return rounded(runs.groupBy("split_date").agg(F.avg("random_baseline").alias("p_at_10")), ["p_at_10"], 9)


@query("leaderboard_max", """
SELECT model, split_date, coalesce(max(CASE WHEN model <> 'B' THEN score END), 0) AS best_score, max(doc_id) AS last_doc
FROM scored_runs GROUP BY ALL""", views="scored scored_runs")
def leaderboard_max(spark, folder):
    runs = B.scored_runs(spark, folder).select(
        "model", "split_date", F.when(F.col("model") != "B", F.col("score")).alias("best_score"), F.col("doc_id").alias("last_doc"))
    return M.best_per_run(runs, ["best_score", "last_doc"], ["model", "split_date"])


@query("yearly_threshold", "SELECT * FROM cuts", views="panel_s cuts")
def yearly_threshold(spark, folder):
    return FE.yearly_threshold(B.panel_table(spark, folder), "filings_rate", 0.9)


@query("median_by_column", """
SELECT round(median(l_quantity), 9) AS l_quantity_median, round(median(l_extendedprice), 9) AS l_extendedprice_median,
  round(median(CASE WHEN l_partkey % 7 <> 0 THEN l_discount END), 9) AS l_discount_median FROM lineitem""")
def median_by_column(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_quantity", "l_extendedprice", F.when(F.col("l_partkey") % 7 != 0, F.col("l_discount")).alias("l_discount"))
    return FE.column_medians(lines, ["l_quantity", "l_extendedprice", "l_discount"])


SPLIT_ARGS = ("1995-01-01", "2001-01-01")


def split_orders(spark, folder):
    return FE.temporal_splits(table(spark, folder, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", *SPLIT_ARGS)


def split_sql(source: str, day: str) -> str:
    """Rows of `source` with split_date and role for the four expanding windows."""
    starts = ", ".join(f"(DATE '{y}-01-01')" for y in (1998, 1999, 2000, 2001))
    return (f"(SELECT t.*, s.split_date, CASE WHEN {day} < s.split_date THEN 'train' ELSE 'test' END AS role "
            f"FROM {source} t JOIN (VALUES {starts}) s(split_date) ON {day} >= DATE '1995-01-01' "
            f"AND {day} < s.split_date + INTERVAL 12 MONTH)")


@query("split_bounds", f"""
SELECT split_date, cast(min(y) FILTER (WHERE role = 'train') AS int) AS min_year_in_train,
  cast(max(y) FILTER (WHERE role = 'train') AS int) AS max_year_in_train,
  cast(min(y) FILTER (WHERE role = 'test') AS int) AS min_year_in_test,
  cast(max(y) FILTER (WHERE role = 'test') AS int) AS max_year_in_test
FROM (SELECT *, year(o_orderdate) AS y FROM {split_sql('orders', 'o_orderdate')}) GROUP BY split_date""")
def split_bounds(spark, folder):
    return bounds_of(split_orders(spark, folder).withColumn("year", F.year("o_orderdate")))


@query("distinct_count", "SELECT c AS column_name, n AS n_distinct FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS c, count(DISTINCT {c}) AS n FROM lineitem"
    for c in ("l_quantity", "l_discount", "l_returnflag", "l_suppkey")) + ")")
def distinct_count(spark, folder):
    return FE.distinct_counts(table(spark, folder, "lineitem"), ["l_quantity", "l_discount", "l_returnflag", "l_suppkey"])


@query("null_profile", "SELECT c AS column_name, n AS n_missing FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS c, count(*) - count({c}) AS n FROM panel_h"
    for c in ("tract", "year", "commarea", "filings_total", "filings_rate")) + ")", views="panel_s panel_h")
def null_profile(spark, folder):
    return PR.null_profile(B.panel_holes(spark, folder))


def _describe_sql(source: str, columns) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
        f"min({c})::double AS min, max({c})::double AS max, round(quantile_cont({c}::double, 0.25), 6) AS p25, "
        f"round(quantile_cont({c}::double, 0.5), 6) AS p50, round(quantile_cont({c}::double, 0.75), 6) AS p75 FROM {source}"
        for c in columns)


@query("describe_stats", _describe_sql("orders", ["o_orderkey", "o_totalprice"]) + " UNION ALL "
       + _describe_sql("panel_h", ["filings_total", "filings_rate"]), views="panel_s panel_h")
def describe_stats(spark, folder):
    orders = PR.describe_stats(table(spark, folder, "orders"), ["o_orderkey", "o_totalprice"])
    panel = PR.describe_stats(B.panel_table(spark, folder, holes=True), ["filings_total", "filings_rate"])
    return rounded(orders.unionByName(panel), ["mean", "std", "p25", "p50", "p75"])


CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("corr_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM "
    "(SELECT l_quantity, l_extendedprice, l_discount, CASE WHEN l_partkey % 7 <> 0 THEN l_tax END AS l_tax FROM lineitem)"
    for a in CORR for b in CORR))
def corr_matrix(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        *CORR[:3], F.when(F.col("l_partkey") % 7 != 0, F.col("l_tax")).alias("l_tax"))
    return rounded(PR.corr_matrix(lines, CORR), ["corr"])


@query("histogram_bins", """
SELECT bin, round(lo + bin * w, 6) AS bin_start, count(*) AS n FROM (
  SELECT cast(least(floor((o_totalprice - lo) / w), 49) AS int) AS bin, lo, w FROM orders,
    (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 50 AS w FROM orders)) GROUP BY bin, lo, w""")
def histogram_bins(spark, folder):
    return rounded(PR.histogram(table(spark, folder, "orders"), "o_totalprice"), ["bin_start"])


@query("boxplot_stats", """
WITH q AS (SELECT p_brand, quantile_cont(p_retailprice, 0.25) AS p25, quantile_cont(p_retailprice, 0.5) AS p50,
    quantile_cont(p_retailprice, 0.75) AS p75 FROM part GROUP BY p_brand),
j AS (SELECT p.p_brand, p_retailprice AS v, p25, p50, p75, p25 - (p75 - p25) * 1.5::double AS lo, p75 + (p75 - p25) * 1.5::double AS hi
      FROM part p JOIN q ON p.p_brand = q.p_brand)
SELECT p_brand, count(*) AS n, min(v) AS min, max(v) AS max, round(min(p25), 6) AS p25, round(min(p50), 6) AS p50,
  round(min(p75), 6) AS p75, min(v) FILTER (WHERE v BETWEEN lo AND hi) AS whisker_low,
  max(v) FILTER (WHERE v BETWEEN lo AND hi) AS whisker_high, count(*) FILTER (WHERE NOT (v BETWEEN lo AND hi)) AS outliers
FROM j GROUP BY p_brand""")
def boxplot_stats(spark, folder):
    return rounded(PR.boxplot_stats(table(spark, folder, "part"), "p_retailprice", "p_brand"), ["p25", "p50", "p75"])


@query("row_count", "SELECT count(*) AS n_rows, 11 AS n_columns FROM lineitem")
def row_count(spark, folder):
    return PR.shape(table(spark, folder, "lineitem"))


@query("quantile_classes", """
, e AS (SELECT """ + ", ".join(f"round(quantile_cont(filings_rate, {q}), 9) AS q{i}" for i, q in enumerate((0.2, 0.4, 0.6, 0.8, 1.0)))
       + """ FROM panel_h WHERE year = 1999)
SELECT tract, filings_rate, CASE WHEN filings_rate <= q0 THEN 0 WHEN filings_rate <= q1 THEN 1 WHEN filings_rate <= q2 THEN 2
    WHEN filings_rate <= q3 THEN 3 ELSE 4 END AS class_no,
  round(CASE WHEN filings_rate <= q0 THEN q0 WHEN filings_rate <= q1 THEN q1 WHEN filings_rate <= q2 THEN q2
    WHEN filings_rate <= q3 THEN q3 ELSE q4 END, 6) AS upper_limit
FROM panel_h, e WHERE year = 1999 AND filings_rate IS NOT NULL""", views="panel_s panel_h")
def quantile_classes(spark, folder):
    one_year = B.panel_table(spark, folder, holes=True).where(F.col("year") == 1999).select("tract", "filings_rate")
    return rounded(O.quantile_classes(one_year, "filings_rate"), ["upper_limit"])
