"""Projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from areapanel.catalog import base as B
from areapanel.catalog.base import query, table
from areapanel.catalog.ingest import raw_incidents
from areapanel.functions import geometry as G
from areapanel.functions import scalar as S
from areapanel.operators import features as FE
from areapanel.operators import panel as P
from areapanel.sources import landed as L
from areapanel.sources import schemas as C


@query("project_columns", "SELECT l_suppkey, l_quantity FROM lineitem")
def project_columns(spark, folder):
    return table(spark, folder, "lineitem").select("l_suppkey", "l_quantity")


@query("rename_columns", "SELECT s_suppkey AS tract, s_nationkey AS commarea, s_name, s_acctbal FROM supplier")
def rename_columns(spark, folder):
    return table(spark, folder, "supplier").withColumnsRenamed({"s_suppkey": "tract", "s_nationkey": "commarea"})


@query("prefix_columns", """
SELECT tract, year, commarea, filings_total AS total_filings_total, filings_rate AS total_filings_rate FROM panel_s""",
       views="panel_s")
def prefix_columns(spark, folder):
    return S.rename_affixed(B.panel_dense(spark, folder), ["filings_total", "filings_rate"], prefix="total_")


@query("drop_columns", "SELECT c_custkey, c_nationkey FROM customer")
def drop_columns(spark, folder):
    return table(spark, folder, "customer").drop("c_name", "c_acctbal", "c_mktsegment")


@query("coerce_numeric", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 NOT IN (0, 1) THEN o_totalprice END AS price FROM orders""")
def coerce_numeric(spark, folder):
    text = F.when(F.col("o_orderkey") % 5 == 0, F.lit("unknown")).when(F.col("o_orderkey") % 5 == 1, F.lit("NaN")) \
        .otherwise(F.col("o_totalprice").cast("string"))
    return table(spark, folder, "orders").select("o_orderkey", S.coerce_number(text).alias("price"))


@query("strict_int_flags", """
SELECT o_orderkey, cast(o_orderstatus = 'F' AS int) AS is_final, cast(o_custkey AS int) AS customer FROM orders""")
def strict_int_flags(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", S.flag_int((F.col("o_orderstatus") == "F").cast("string")).alias("is_final"),
        S.strict_int(F.col("o_custkey").cast("string")).alias("customer"))


@query("parse_dates", "SELECT o_orderkey, o_orderdate AS at FROM orders")
def parse_dates(spark, folder):
    text = F.date_format("o_orderdate", "yyyy/MM/dd HH:mm:ss")
    return table(spark, folder, "orders").select("o_orderkey", S.parse_timestamp(text, "yyyy/MM/dd HH:mm:ss").alias("at"))


@query("year_extract", "SELECT o_orderkey, cast(year(o_orderdate) AS int) AS year FROM orders")
def year_extract(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", S.year_of("o_orderdate").alias("year"))


@query("zero_pad_code", f"""
SELECT c_custkey, {B.pad_sql('c_custkey')} AS code, {B.pad_sql('c_custkey * 10000019')} AS long_code FROM customer""")
def zero_pad_code(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", S.zero_pad("c_custkey").alias("code"), S.zero_pad(F.col("c_custkey") * 10000019).alias("long_code"))


@query("code_suffix", "SELECT c_custkey, right(c_name, 6) AS code FROM customer")
def code_suffix(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", S.code_suffix("c_name").alias("code"))


@query("map_classify", f"SELECT p_partkey, {B.CODE_SQL} AS code, {B.CLASS_SQL} AS crime_class FROM part")
def map_classify(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", B.offence_code().alias("code"), S.classify(B.offence_code(), C.CRIME_CLASSES).alias("crime_class"))


@query("share_of_total", """
SELECT tract, year, housing_units_rental / nullif(housing_units_total, 0) AS housing_units_rental_share,
  housing_units_other / nullif(housing_units_total, 0) AS housing_units_other_share FROM raw_census""", views="raw_census")
def share_of_total(spark, folder):
    raw = B.raw_census(spark, folder)
    return raw.select("tract", "year", *S.shares(["housing_units_rental", "housing_units_other"],
                                                 "housing_units_total", suffix="_share"))


@query("row_sum", """
SELECT p_partkey, coalesce(CASE WHEN p_partkey % 7 <> 0 THEN p_size END, 0) + coalesce(CASE WHEN p_partkey % 5 <> 0 THEN p_size * 2 END, 0) AS total
FROM part""")
def row_sum(spark, folder):
    parts = table(spark, folder, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).alias("a"),
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_size") * 2).alias("b"))
    return parts.select("p_partkey", S.row_sum(["a", "b"]).alias("total"))


@query("literal_column", "SELECT tract, year, 'Baseline' AS model_type FROM panel_s", views="panel_s")
def literal_column(spark, folder):
    return B.panel_dense(spark, folder).select("tract", "year", F.lit("Baseline").alias("model_type"))


@query("majority_class", "SELECT tract, year, race FROM census", views="raw_census census")
def majority_class(spark, folder):
    shares = {c: S.ratio(c, "population_total") for _, c in C.RACE_ORDER}
    return B.raw_census(spark, folder).withColumns(shares).select(
        F.right("tract", F.lit(6)).alias("tract"), "year",
        S.largest_share_class(C.RACE_ORDER, C.MAJORITY_MINIMUM, "Integrated").alias("race"))


@query("threshold_flag", """
SELECT tract, year, CASE WHEN population_poverty_above / population_total > 0.66::double THEN 'Poor' ELSE 'Non-Poor' END AS poor
FROM raw_census""", views="raw_census")
def threshold_flag(spark, folder):
    share = S.ratio("population_poverty_above", "population_total")
    return B.raw_census(spark, folder).select("tract", "year", S.threshold_flag(share, 0.66, "Poor", "Non-Poor").alias("poor"))


@query("cap_at_one", """
SELECT tract, year, CASE WHEN filings_rate / 2500 >= 1 THEN 1 ELSE filings_rate / 2500 END AS capped FROM panel_h""",
       views="panel_s panel_h")
def cap_at_one(spark, folder):
    return B.panel_holes(spark, folder).select("tract", "year", S.cap_at_one(F.col("filings_rate") / 2500).alias("capped"))


@query("blank_first_year", f"""
SELECT tract, year, CASE WHEN year <> {B.FIRST_YEAR} THEN filings_rate END AS filings_rate FROM panel_s""", views="panel_s")
def blank_first_year(spark, folder):
    return B.panel_dense(spark, folder).select(
        "tract", "year", S.blank_year("filings_rate", "year", B.FIRST_YEAR).alias("filings_rate"))


@query("next_year_key", "SELECT tract, year, year + 1 AS next_year FROM panel_c", views="panel_c")
def next_year_key(spark, folder):
    return B.panel_sparse(spark, folder).select("tract", "year", (F.col("year") + 1).alias("next_year"))


@query("flag_product", "SELECT tract, year, label * label_prev_year AS correct_with_baseline FROM labelled",
       views="panel_s cuts labelled")
def flag_product(spark, folder):
    labelled = FE.create_label(B.panel_table(spark, folder), "filings_rate")
    return labelled.select("tract", "year", (F.col("label") * F.col("label_prev_year")).alias("correct_with_baseline"))


@query("parse_struct", """
SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN cast(json_extract(props, '$.k') AS bigint) END AS k FROM events""")
def parse_struct(spark, folder):
    quoted = F.regexp_replace("props", '"', "'")
    text = F.when(F.col("event_id") % 14 == 0, F.lit("{'k': None}")).when(F.col("event_id") % 7 != 0, quoted)
    return table(spark, folder, "events").select("event_id", G.parse_literal(text, "k bigint")["k"].alias("k"))


@query("point_from_struct", f"""
SELECT (l_orderkey * 10 + l_linenumber)::varchar AS id, {B.LINE_X_SQL} AS x, {B.LINE_Y_SQL} AS y FROM lineitem""")
def point_from_struct(spark, folder):
    parsed = raw_incidents(spark, folder).select("id", G.parse_literal("location", G.POINT_SCHEMA).alias("l"))
    return parsed.select("id", G.point_struct("l").alias("p")).select("id", "p.x", "p.y")


@query("continuous_columns", """
SELECT name AS column_name FROM (
  SELECT 'c_custkey' AS name, count(DISTINCT c_custkey) AS n FROM customer UNION ALL
  SELECT 'c_nationkey', count(DISTINCT c_nationkey) FROM customer UNION ALL
  SELECT 'c_acctbal', count(DISTINCT c_acctbal) FROM customer) WHERE n > 30""")
def continuous_columns(spark, folder):
    customer = table(spark, folder, "customer")
    names = FE.continuous_columns(customer, more_than=30)
    return spark.createDataFrame([(c,) for c in names], "column_name string")


@query("binary_columns", """
SELECT name AS column_name FROM (
  SELECT 'is_f' AS name, true AS b UNION ALL SELECT 'l_linenumber', bool_and(l_linenumber IN (0, 1)) FROM lineitem
  UNION ALL SELECT 'holes', bool_and(l_partkey % 7 <> 0) FROM lineitem) WHERE b""")
def binary_columns(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        (F.col("l_linestatus") == "F").cast("int").alias("is_f"), "l_linenumber",
        F.when(F.col("l_partkey") % 7 != 0, 1).alias("holes"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return spark.createDataFrame([(c,) for c in FE.binary_columns(lines)], "column_name string")


@query("acs_base", "SELECT * FROM census", views="raw_census census")
def acs_base(spark, folder):
    return L.census_base(B.raw_census(spark, folder))
