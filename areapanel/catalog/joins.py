"""Joins, the panel chain and the spatial join."""

from __future__ import annotations

from pyspark.sql import functions as F

from areapanel.catalog import base as B
from areapanel.catalog.base import query, table
from areapanel.functions import scalar as S
from areapanel.operators import metrics as M
from areapanel.operators.selection import flag_first
from areapanel.operators import panel as P
from areapanel.operators.spatial import spatial_join as join_points
from areapanel.plans.panel_build import violation_panel
from areapanel.session import stage
from areapanel.sources import landed as L


def crime_home(spark, folder):
    return P.multi_pivot(B.incidents(spark, folder), {"crime_class": B.CLASS_NAMES}, total="total_crime")


def predictions(spark, folder):
    """Top decile of the last year as predictions per tract."""
    last = B.panel_table(spark, folder).where(F.col("year") == 2001)
    return flag_first(last, [], M.score_rank("filings_rate", ["tract"]), 10, name="prediction") \
        .select("tract", "year", "prediction")


PREDICTIONS_SQL = """(SELECT tract, year, cast(row_number() OVER (ORDER BY filings_rate DESC, tract) - 1
  < floor(count(*) OVER () * (10 / 100.0::double)) AS int) AS prediction FROM panel_s WHERE year = 2001)"""


@query("inner_join_two_keys", """
SELECT s.tract, s.year, s.filings_rate, c.filings_total AS orders_total FROM panel_s s JOIN panel_c c
ON s.tract = c.tract AND s.year = c.year""", views="panel_s panel_c")
def inner_join_two_keys(spark, folder):
    orders = B.panel_sparse(spark, folder).select("tract", "year", F.col("filings_total").alias("orders_total"))
    return P.disjoint(B.panel_dense(spark, folder).select("tract", "year", "filings_rate"), orders, P.KEY)


@query("dimension_join", "SELECT c.tract, c.year, c.filings_total, t.commarea FROM panel_c c JOIN tracts t ON c.tract = t.tract",
       views="panel_c tracts")
def dimension_join(spark, folder):
    return P.dimension_join(B.panel_sparse(spark, folder).drop("commarea"), B.tract_dimension(spark, folder))


@query("next_year_left_join", """
SELECT p.tract, p.year, p.filings_total, p.year + 1 AS next_year, n.filings_total AS filings_total_next_year
FROM panel_c p LEFT JOIN panel_c n ON n.tract = p.tract AND n.year = p.year + 1""", views="panel_c")
def next_year_left_join(spark, folder):
    return P.with_next_year(stage(B.panel_sparse(spark, folder).drop("commarea")), "filings_total")


@query("full_outer_results", f"""
SELECT coalesce(e.tract, p.tract) AS tract, e.n_edges, p.prediction
FROM (SELECT tract, count(*) AS n_edges FROM edges GROUP BY tract) e FULL OUTER JOIN {PREDICTIONS_SQL} p ON e.tract = p.tract""",
       views="panel_s edges")
def full_outer_results(spark, folder):
    shapes = B.tract_polygons(spark, folder).where(F.col("edges").isNotNull()) \
        .select("tract", F.size("edges").cast("long").alias("n_edges"))
    return P.outer_results(shapes, predictions(spark, folder).drop("year"))


@query("group_mean_features", """
SELECT tract, year, commarea, filings_total, round(avg(filings_total) OVER w, 6) AS filings_total_mean_by_commarea,
  round(avg(filings_rate) OVER w, 6) AS filings_rate_mean_by_commarea
FROM panel_h WINDOW w AS (PARTITION BY commarea, year)""", views="panel_s panel_h")
def group_mean_features(spark, folder):
    out = P.with_group_means(B.panel_table(spark, folder, holes=True), columns=["filings_total", "filings_rate"])
    return out.select("tract", "year", "commarea", "filings_total",
                      *[F.round(f"{c}_mean_by_commarea", 6).alias(f"{c}_mean_by_commarea")
                        for c in ("filings_total", "filings_rate")])


MODEL_COLUMNS = ["filings_rate", "population_poverty_above", "graduate", "total_crime", "total_building_violations"]


def modelling_table(spark, folder):
    rates = B.panel_dense(spark, folder).drop("commarea")
    census = P.expand_years(L.census_base(B.raw_census(spark, folder)), B.CENSUS_YEARS)
    schooling = L.education_base(L.education_shares(B.raw_education(spark, folder)))
    schooling = P.expand_years(schooling, B.EDUCATION_YEARS)
    crime = P.crime_base(crime_home(spark, folder), B.CLASS_COLUMNS, first_year=B.FIRST_YEAR)
    buildings = violation_panel(B.violations(spark, folder), B.tract_polygons(spark, folder), B.VIOLATION_CATEGORIES)
    buildings = P.building_base(buildings, B.STATUS_COLUMNS, first_year=B.FIRST_YEAR)
    return P.join_bases(rates, census, schooling, crime, buildings, B.tract_dimension(spark, folder),
                        mean_columns=MODEL_COLUMNS)


_KEPT = ["tract", "year", "commarea", "race", "poor", "filings_total", "filings_rate", "total_crime",
         "total_building_violations", "bachelor", "perc_increase_total_crime", "perc_increase_bv",
         *[f"{c}_mean_by_commarea" for c in MODEL_COLUMNS]]
_ROUNDED = {"bachelor", "perc_increase_total_crime", "perc_increase_bv", *[f"{c}_mean_by_commarea" for c in MODEL_COLUMNS]}


@query("join_bases", f"""
, joined AS (
SELECT r.tract, r.year, t.commarea, race, poor, filings_total, filings_rate, total_crime, total_building_violations,
  bachelor, graduate, population_poverty_above, perc_increase_total_crime, perc_increase_bv
FROM (SELECT tract, year, filings_total, filings_rate FROM panel_s) r
JOIN (SELECT * EXCLUDE (year), unnest(CASE year WHEN 1995 THEN {B.CENSUS_YEARS[1995]} ELSE {B.CENSUS_YEARS[2000]} END) AS year
      FROM census) c USING (tract, year)
JOIN (SELECT {B.pad_sql('tract')} AS tract, bachelor, graduate,
        unnest(CASE year WHEN 2010 THEN {B.EDUCATION_YEARS[2010]} ELSE {B.EDUCATION_YEARS[2017]} END) AS year
      FROM education) e USING (tract, year)
JOIN crime_features USING (tract, year) JOIN building_features USING (tract, year) JOIN tracts t ON t.tract = r.tract)
SELECT {', '.join(f'round({c}, 6) AS {c}' if c in _ROUNDED else c for c in _KEPT if not c.endswith('_by_commarea'))},
  {', '.join(f'round(avg({c}) OVER w, 6) AS {c}_mean_by_commarea' for c in MODEL_COLUMNS)}
FROM joined WINDOW w AS (PARTITION BY commarea, year)""",
       views="panel_s incidents crime_home crime_features raw_census census education edges violations violation_hits "
             "violation_panel building_features tracts")
def join_bases(spark, folder):
    return modelling_table(spark, folder).select(
        *[F.round(c, 6).alias(c) if c in _ROUNDED else F.col(c) for c in _KEPT])


@query("spatial_join", "SELECT id, tract FROM violations JOIN violation_hits USING (x, y)",
       views="violations edges violation_hits")
def spatial_join(spark, folder):
    points = B.violations(spark, folder).select("id", "x", "y")
    return join_points(points, B.tract_polygons(spark, folder).select("tract", "edges")).select("id", "tract")


@query("semi_join_topk", """
SELECT tract, year, filings_rate FROM panel_s
WHERE tract IN (SELECT tract FROM panel_s WHERE filings_rate > 2000 GROUP BY tract HAVING count(*) > 1)""", views="panel_s")
def semi_join_topk(spark, folder):
    panel = B.panel_table(spark, folder).select("tract", "year", "filings_rate")
    chosen = panel.where(F.col("filings_rate") > 2000).groupBy("tract").agg(F.count("*").alias("n")).where("n > 1")
    return P.semi_join(panel, chosen)


@query("aligned_assign", """
SELECT doc_id, cast(pos < floor(n * (10 / 100.0::double)) AS int) AS score, label AS label_value, lang, source
FROM (SELECT *, row_number() OVER (ORDER BY s.score DESC, label DESC, doc_id) - 1 AS pos, count(*) OVER () AS n FROM scored s)""",
       views="scored")
def aligned_assign(spark, folder):
    order = [("score", False), ("label", False), ("doc_id", True)]
    return flag_first(B.scored(spark, folder), [], order, 10).select(
        "doc_id", F.col("flag").alias("score"), F.col("label").alias("label_value"), "lang", "source")


@query("horizontal_concat", """
SELECT tract, year, housing_units_total, housing_units_rental, housing_units_rental / nullif(housing_units_total, 0) AS perc_housing_units_rental
FROM raw_census""", views="raw_census")
def horizontal_concat(spark, folder):
    raw = B.raw_census(spark, folder).select("tract", "year", "housing_units_total", "housing_units_rental")
    return raw.select("*", *S.shares(["housing_units_rental"], "housing_units_total", prefix="perc_"))
