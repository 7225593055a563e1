"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from areapanel.catalog import base as B
from areapanel.catalog.base import query, table
from areapanel.functions import scalar as S
from areapanel.operators.selection import sample_exact
from areapanel.session import scratch_path
from areapanel.sources import landed as L
from areapanel.sources import schemas as C


def raw_incidents(spark, folder):
    """Incidents as landed: everything is text, coordinates partly unreadable, location a literal."""
    x, y = B.line_x(), B.line_y()
    by_name = F.concat(F.lit("{'latitude': '"), y.cast("string"), F.lit("', 'longitude': '"), x.cast("string"),
                       F.lit("', 'human_address': None}"))
    by_type = F.concat(F.lit("{'type': 'Point', 'coordinates': ["), x.cast("string"), F.lit(", "), y.cast("string"), F.lit("]}"))
    return B.line_parts(spark, folder).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("id"),
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss").alias("date"),
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss").alias("updated_on"),
        F.year("l_shipdate").cast("string").alias("year"),
        F.when(F.col("l_partkey") % 13 == 0, F.lit("n/a")).otherwise(y.cast("string")).alias("latitude"),
        F.when(F.col("l_partkey") % 13 == 1, F.lit("nan")).otherwise(x.cast("string")).alias("longitude"),
        (F.col("l_returnflag") == "R").cast("string").alias("arrest"),
        (F.col("l_linestatus") == "F").cast("string").alias("domestic"),
        "fbi_code", F.col("p_type").alias("primary_type"),
        F.when(F.col("l_orderkey") % 2 == 0, by_name).otherwise(by_type).alias("location"))


def raw_violations(spark, folder):
    x, y = B.order_x(), B.order_y()
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("inspection_number"), F.lit("12").alias("street_number"),
        F.col("o_custkey").cast("string").alias("property_group"),
        y.cast("string").alias("latitude"), x.cast("string").alias("longitude"),
        day.alias("violation_date"), day.alias("violation_status_date"), day.alias("violation_last_modified_date"),
        F.col("o_orderstatus").alias("violation_status"),
        F.concat(F.lit("{'latitude': '"), y.cast("string"), F.lit("', 'longitude': '"), x.cast("string"), F.lit("'}")).alias("location"))


@query("scan_range_filter", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'""")
def scan_range_filter(spark, folder):
    return L.scan(spark, f"{folder}/orders.parquet", first_year=1996, last_year=1998, date_column="o_orderdate",
                  is_date=True).select("o_orderkey", "o_custkey", "o_totalprice")


@query("ingest_incidents", f"""
SELECT (l_orderkey * 10 + l_linenumber)::double AS id, l_shipdate AS date, year(l_shipdate)::double AS year,
  CASE WHEN l_partkey % 13 <> 0 THEN {B.LINE_Y_SQL} END AS latitude,
  CASE WHEN l_partkey % 13 <> 1 THEN {B.LINE_X_SQL} END AS longitude,
  cast(l_returnflag = 'R' AS int) AS arrest, cast(l_linestatus = 'F' AS int) AS domestic,
  {B.CODE_SQL} AS fbi_code, {B.CLASS_SQL} AS crime_class
FROM lineitem JOIN part ON l_partkey = p_partkey""")
def ingest_incidents(spark, folder):
    out = L.ingest_incidents(raw_incidents(spark, folder).drop("location", "updated_on", "primary_type"))
    return out.select("id", "date", "year", "latitude", "longitude", "arrest", "domestic", "fbi_code", "crime_class")


@query("ingest_violations", f"""
SELECT o_orderkey::double AS inspection_number, 12::double AS street_number, o_custkey::double AS property_group,
  {B.ORDER_Y_SQL} AS latitude, {B.ORDER_X_SQL} AS longitude, o_orderdate AS violation_date,
  o_orderdate AS violation_status_date, o_orderdate AS violation_last_modified_date,
  o_orderstatus AS violation_status, cast(year(o_orderdate) AS int) AS year FROM orders""")
def ingest_violations(spark, folder):
    return L.ingest_violations(raw_violations(spark, folder).drop("location"))


@query("education_shares", "SELECT " + ", ".join(f"round({c}, 9) AS {c}" for c in B.LEVEL_NAMES)
       + ", year, tract, county, pop_over_25 FROM education", views="education")
def education_shares(spark, folder):
    out = L.education_shares(B.raw_education(spark, folder))
    return out.withColumns({c: F.round(c, 9) for c in B.LEVEL_NAMES})


@query("load_polygons", """
SELECT cast(s_suppkey AS varchar) AS tract, s_nationkey AS commarea, s_suppkey % 13 <> 12 AS has_location FROM supplier""")
def load_polygons(spark, folder):
    path = scratch_path(spark, "tracts")
    B.raw_tracts(spark, folder).write.json(path)
    landed = L.scan(spark, path, "json", "the_geom string, tractce10 string, commarea int")
    return L.tract_table(landed).select("tract", "commarea", F.col("location").isNotNull().alias("has_location"))


CUSTOMER_CSV = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("csv_scan", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def csv_scan(spark, folder):
    path = scratch_path(spark, "customer-csv")
    L.write_csv(table(spark, folder, "customer"), path)
    return L.csv_scan(spark, path, CUSTOMER_CSV, ["c_custkey", "c_mktsegment", "c_acctbal"])


@query("load_rates_base", "SELECT " + B.pad_sql("l_suppkey") + """ AS tract, date_trunc('year', l_shipdate)::timestamp AS filing_year,
  cast(year(l_shipdate) AS int) AS year, count(*)::double AS eviction_filings_total, sum(l_quantity) AS eviction_filings_rate,
  (count(*) FILTER (WHERE l_returnflag = 'R'))::double AS eviction_order_yes
FROM lineitem GROUP BY ALL""")
def load_rates_base(spark, folder):
    cells = table(spark, folder, "lineitem").groupBy("l_suppkey", F.date_trunc("year", "l_shipdate").alias("day")).agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("rate"),
        F.count_if(F.col("l_returnflag") == "R").alias("yes"))
    filled = {"eviction_filings_total": F.col("n"), "eviction_filings_rate": F.col("rate"), "eviction_order_yes": F.col("yes")}
    wide = cells.select(F.date_format("day", "yyyy-MM-dd").alias("filing_year"),
                        F.concat(F.lit("17031"), S.zero_pad("l_suppkey")).alias("tract"),
                        *[filled.get(c, F.lit(None).cast("double")).alias(c) for c in C.RATE_COLUMNS],
                        F.lit("unused").alias("note"))
    path = scratch_path(spark, "rates-csv")
    L.write_csv(wide, path)
    return L.load_rates(spark, path).select("tract", "filing_year", "year", "eviction_filings_total",
                                            "eviction_filings_rate", "eviction_order_yes")


@query("missing_path_scan", """
SELECT 'landed' AS source, true AS found, count(*) AS n FROM customer UNION ALL SELECT 'absent', false, 0""")
def missing_path_scan(spark, folder):
    path = scratch_path(spark, "guarded-csv")
    L.write_csv(table(spark, folder, "customer"), path)
    out = None
    for name, at in (("landed", path), ("absent", path + "-absent")):
        found = L.csv_or_none(spark, at, CUSTOMER_CSV)
        rows = spark.range(1).select(F.lit(0).cast("long").alias("n")) if found is None else found.agg(F.count("*").alias("n"))
        part = rows.select(F.lit(name).alias("source"), F.lit(found is not None).alias("found"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("csv_roundtrip", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def csv_roundtrip(spark, folder):
    path = scratch_path(spark, "orders-csv")
    L.write_csv(table(spark, folder, "orders").drop("o_orderpriority"), path)
    return L.csv_scan(spark, path, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
                                   "o_totalprice double, o_orderdate timestamp_ntz")


@query("sample_5pct", """
SELECT * FROM orders QUALIFY row_number() OVER (ORDER BY ('0x' || substr(md5('7:' || o_orderkey), 1, 13))::BIGINT, o_orderkey)
  <= floor(count(*) OVER () * 0.05::DOUBLE)""")
def sample_5pct(spark, folder):
    return sample_exact(table(spark, folder, "orders"), ["o_orderkey"], 0.05, seed=7)


@query("load_polygons_join", """
SELECT tract, commarea, coalesce(n, 0) AS n_edges, x_low, y_high FROM tracts
LEFT JOIN (SELECT tract, count(*) AS n, min(x1) AS x_low, max(y1) AS y_high FROM edges GROUP BY tract) USING (tract)""",
       views="tracts edges")
def load_polygons_join(spark, folder):
    return B.tract_polygons(spark, folder).select(
        "tract", "commarea", F.coalesce(F.size("edges"), F.lit(0)).cast("long").alias("n_edges"),
        F.array_min("edges.x1").alias("x_low"), F.array_max("edges.y1").alias("y_high"))


@query("load_points_violations", f"""
SELECT o_orderkey::double AS inspection_number, o_orderdate AS violation_date, {B.ORDER_X_SQL} AS x, {B.ORDER_Y_SQL} AS y
FROM orders""")
def load_points_violations(spark, folder):
    return L.violation_points(raw_violations(spark, folder)).select("inspection_number", "violation_date", "x", "y")


@query("load_points_incidents", f"""
SELECT (l_orderkey * 10 + l_linenumber)::double AS id, cast(l_returnflag = 'R' AS int) AS arrest, l_shipdate AS updated_on,
  {B.LINE_X_SQL} AS x, {B.LINE_Y_SQL} AS y FROM lineitem JOIN part ON l_partkey = p_partkey""")
def load_points_incidents(spark, folder):
    return L.incident_points(raw_incidents(spark, folder)).select("id", "arrest", "updated_on", "x", "y")


@query("load_tract_dim", "SELECT tract, commarea FROM tracts", views="tracts")
def load_tract_dim(spark, folder):
    return B.tract_dimension(spark, folder)


@query("load_education", "SELECT " + B.pad_sql("tract")
       + " AS tract, year, county, pop_over_25, round(graduate, 9) AS graduate FROM education", views="education")
def load_education(spark, folder):
    raw = L.education_shares(B.raw_education(spark, folder)).withColumn("_c0", F.lit("0"))
    return L.education_base(raw).select("tract", "year", "county", "pop_over_25", F.round("graduate", 9).alias("graduate"))
