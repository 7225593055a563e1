"""Query registry, and the views the queries share in DataFrame and in SQL form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areapanel.functions import scalar as S
from areapanel.operators import panel as P
from areapanel.session import stage
from areapanel.sources import landed as L
from areapanel.sources import schemas as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register a query under `name`; `views` are the shared views its SQL starts with."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            parts = [f"{v} AS ({VIEW_SQL[v]})" for v in views.split()]
            SQL[name] = (f"WITH {', '.join(parts)} " if parts else "") + sql.strip()
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pad_sql(c: str) -> str:
    text = f"cast({c} AS varchar)"
    return f"(CASE WHEN length({text}) < 6 THEN lpad({text}, 6, '0') ELSE {text} END)"


YEARS = list(range(1995, 2002))
FIRST_YEAR = 1995
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
STATUSES = ["F", "O", "P"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
CLASS_NAMES = sorted(C.CRIME_CLASSES)
CRIME_CATEGORIES = {"crime_class": CLASS_NAMES, "primary_type": PART_TYPES, "domestic": [0, 1], "arrest": [0, 1]}
VIOLATION_CATEGORIES = {"violation_status": STATUSES, "inspection_category": PRIORITIES,
                        "department_bureau": SEGMENTS}
CLASS_COLUMNS = [P.pivot_name("crime_class", c) for c in CLASS_NAMES]
STATUS_COLUMNS = [P.pivot_name("violation_status", s) for s in STATUSES]
CENSUS_YEARS = {1995: [1995, 1996, 1997, 1998, 1999], 2000: [2000, 2001]}
EDUCATION_YEARS = {2010: [1995, 1996, 1997, 1998, 1999], 2017: [2000, 2001]}


def panel_dense(spark: SparkSession, folder: str) -> DataFrame:
    """Supplier x ship year: counted before the supplier join, so the join sees one row per cell."""
    cells = table(spark, folder, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(
        F.count("*").alias("filings_total"), F.sum("l_quantity").alias("filings_rate"))
    supplier = table(spark, folder, "supplier")
    return cells.join(supplier, cells.l_suppkey == supplier.s_suppkey).select(
        S.zero_pad("l_suppkey").alias("tract"), "year", F.col("s_nationkey").alias("commarea"),
        "filings_total", "filings_rate")


def panel_sparse(spark: SparkSession, folder: str) -> DataFrame:
    """Customer x order year; many customers skip years."""
    cells = table(spark, folder, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(
        F.count("*").alias("filings_total"))
    customer = table(spark, folder, "customer")
    return cells.join(customer, cells.o_custkey == customer.c_custkey).select(
        S.zero_pad("o_custkey").alias("tract"), "year", F.col("c_nationkey").alias("commarea"), "filings_total")


def panel_holes(spark: SparkSession, folder: str) -> DataFrame:
    """The dense panel with every seventh rate missing."""
    hole = (F.col("tract").cast("int") + F.col("year")) % 7 == 0
    return panel_dense(spark, folder).withColumn("filings_rate", F.when(~hole, F.col("filings_rate")))


def panel_table(spark: SparkSession, folder: str, holes: bool = False) -> DataFrame:
    """The dense panel as a written table, for operators that pass over it more than once."""
    return stage((panel_holes if holes else panel_dense)(spark, folder), "panel")


def offence_code() -> Column:
    """Two-digit code from the brand number; three brands get one no class lists."""
    number = F.regexp_extract("p_brand", r"#(\d+)", 1).cast("int")
    text = F.lpad(number.cast("string"), 2, "0")
    return F.when(number.isin(1, 4, 8), F.concat(text, F.lit("A"))).otherwise(text)


def line_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with their part; the code and class are worked out once per part."""
    part = table(spark, folder, "part").select(
        "p_partkey", "p_type", offence_code().alias("fbi_code"),
        S.classify(offence_code(), C.CRIME_CLASSES).alias("crime_class"))
    lines = table(spark, folder, "lineitem")
    return lines.join(part, lines.l_partkey == part.p_partkey)


def line_x() -> Column:
    x = F.col("l_suppkey") % 100 + F.col("l_quantity") / 32 - 0.25
    return F.when(F.col("l_partkey") % 11 != 0, x)


def line_y() -> Column:
    y = F.expr("l_suppkey div 100") + (F.col("l_linenumber") * 4 + F.col("l_quantity") % 4) / 32 - 0.125
    return F.when(F.col("l_partkey") % 11 != 0, y)


def incidents(spark: SparkSession, folder: str) -> DataFrame:
    return line_parts(spark, folder).select(
        S.zero_pad("l_suppkey").alias("tract"), F.year("l_shipdate").alias("year"),
        "crime_class",
        F.when(F.col("l_partkey") % 7 != 0, F.col("p_type")).alias("primary_type"),
        (F.col("l_linestatus") == "F").cast("int").alias("domestic"),
        (F.col("l_returnflag") == "R").cast("int").alias("arrest"),
        line_x().alias("x"), line_y().alias("y"))


def order_x() -> Column:
    return F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey") % 100 + F.col("o_orderkey") % 32 / 32)


def order_y() -> Column:
    return F.when(F.col("o_orderkey") % 11 != 0,
                  F.expr("o_custkey div 1500") + F.expr("o_orderkey div 32") % 32 / 32)


def violations(spark: SparkSession, folder: str) -> DataFrame:
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"),
        F.col("o_orderstatus").alias("violation_status"), F.col("o_orderpriority").alias("inspection_category"),
        F.col("c_mktsegment").alias("department_bureau"), order_x().alias("x"), order_y().alias("y"))


# Boundary shapes by supplier key modulo 3, relative to the supplier's grid square:
# a full square, a notched shape, and a square with a hole. Each ring is closed.
SHAPES = {
    0: [[(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]],
    1: [[(0.125, 0.125), (0.875, 0.125), (0.875, 0.875), (0.5, 0.5), (0.125, 0.875), (0.125, 0.125)]],
    2: [[(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)],
        [(0.25, 0.25), (0.25, 0.75), (0.75, 0.75), (0.75, 0.25), (0.25, 0.25)]],
}


def raw_tracts(spark: SparkSession, folder: str) -> DataFrame:
    """Boundary table as landed: GeoJSON text, unpadded code; every thirteenth has no shape."""
    gx, gy = F.col("s_suppkey") % 100, F.expr("s_suppkey div 100")

    def ring(points) -> Column:
        return F.array(*[F.array((gx + F.lit(float(x))).cast("double"), (gy + F.lit(float(y))).cast("double"))
                         for x, y in points])

    shape = F
    for kind, rings in SHAPES.items():
        shape = shape.when(F.col("s_suppkey") % 3 == kind, F.array(F.array(*[ring(r) for r in rings])))
    text = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), shape.alias("coordinates")))
    return table(spark, folder, "supplier").select(
        F.when(F.col("s_suppkey") % 13 != 12, text).alias("the_geom"),
        F.col("s_suppkey").cast("string").alias("tractce10"), F.col("s_nationkey").alias("commarea"))


def tract_polygons(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed boundaries as a written table; a spatial join reads them twice."""
    return stage(L.tract_polygons(L.tract_table(raw_tracts(spark, folder))), "polygons")


def tract_dimension(spark: SparkSession, folder: str) -> DataFrame:
    return L.tract_dimension(L.tract_table(raw_tracts(spark, folder)))


def raw_census(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per tract and survey; the two smallest types go to one group chosen by the tract."""
    kind, extra = F.col("p_type"), F.col("l_suppkey") % 5
    rest = kind.isin("SMALL", "STANDARD")
    survey = F.when(F.year("l_shipdate") < 2000, 1995).otherwise(2000)
    rented = (F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "A")
    counted = line_parts(spark, folder).groupBy("l_suppkey", survey.alias("year")).agg(
        F.count_if(F.col("l_linestatus") == "F").alias("housing_units_total"),
        F.count_if(rented).alias("housing_units_rental"),
        F.count_if((F.col("l_linestatus") == "F") & (F.col("l_returnflag") != "A")).alias("housing_units_other"),
        F.count("*").alias("population_total"),
        F.count_if(F.col("l_returnflag") == "R").alias("population_poverty_below"),
        F.count_if(F.col("l_returnflag") != "R").alias("population_poverty_above"),
        F.count_if((kind == "LARGE") | (rest & (extra == 2))).alias("population_race_white"),
        F.count_if((kind == "ECONOMY") | (rest & (extra == 1))).alias("population_race_black"),
        F.count_if((kind == "MEDIUM") | (rest & (extra == 3))).alias("population_race_latinx"),
        F.count_if((kind == "PROMO") | (rest & (extra == 4))).alias("population_race_asian"),
        F.count_if(rest & (extra == 0)).alias("population_race_other"))
    return counted.select(F.concat(F.lit("17031"), S.zero_pad("l_suppkey")).alias("tract"),
                          *[c for c in counted.columns if c != "l_suppkey"])


def education_number(year: int) -> tuple[int, str]:
    """How many variables a year's table has, and the table."""
    return (35, C.EDUCATION_TABLES[2010]) if year == 2010 else (25, C.EDUCATION_TABLES[2017])


def raw_education(spark: SparkSession, folder: str) -> dict[int, DataFrame]:
    """One count table per survey with a column per census variable."""
    lines = table(spark, folder, "lineitem")
    early = F.year("l_shipdate") < 2000
    out = {}
    for year, rows in ((2010, lines.where(early)), (2017, lines.where(~early))):
        last, name = education_number(year)
        pick = F.col("l_quantity").cast("int") % (last - 1)
        counts = rows.groupBy("l_suppkey").agg(
            F.count("*").alias(f"{name}_001E"),
            *[F.count_if(pick == n - 2).alias(f"{name}_{n:03d}E") for n in range(2, last + 1)])
        out[year] = counts.select(F.col("l_suppkey").cast("string").alias("tract"), F.lit("031").alias("county"),
                                  *[c for c in counts.columns if c != "l_suppkey"])
    return out


def scored(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", F.col("n_chars").alias("score"))
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return labels.join(docs, "doc_id")


def scored_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Three models scored over two splits."""
    runs = F.array(F.struct(F.lit("A").alias("model"), F.col("score").cast("double").alias("score")),
                   F.struct(F.lit("B").alias("model"), (-F.col("score")).cast("double").alias("score")),
                   F.struct(F.lit("C").alias("model"), F.col("doc_id").cast("double").alias("score")))
    split = F.when(F.col("doc_id") % 2 == 0, F.lit("2013-01-01")).otherwise(F.lit("2014-01-01"))
    return scored(spark, folder).select("doc_id", "label", split.alias("split_date"), F.explode(runs).alias("r")) \
        .select("doc_id", "label", "split_date", F.col("r.model").alias("model"), F.col("r.score").alias("score"))


def score_table(spark: SparkSession, folder: str) -> DataFrame:
    return stage(scored_runs(spark, folder), "scores")


def _class_sql(code: str) -> str:
    cases = " ".join(f"WHEN {code} IN ({', '.join(repr(x) for x in codes)}) THEN '{name}'"
                     for name, codes in C.CRIME_CLASSES.items())
    return f"CASE {cases} END"


_NUMBER = "cast(regexp_extract(p_brand, '#([0-9]+)', 1) AS int)"
CODE_SQL = (f"(CASE WHEN {_NUMBER} IN (1, 4, 8) THEN lpad(cast({_NUMBER} AS varchar), 2, '0') || 'A' "
            f"ELSE lpad(cast({_NUMBER} AS varchar), 2, '0') END)")
CLASS_SQL = _class_sql(CODE_SQL)
LINE_X_SQL = "CASE WHEN l_partkey % 11 <> 0 THEN l_suppkey % 100 + l_quantity / 32.0::double - 0.25::double END"
LINE_Y_SQL = ("CASE WHEN l_partkey % 11 <> 0 THEN l_suppkey // 100 + (l_linenumber * 4 + l_quantity % 4) "
              "/ 32.0::double - 0.125::double END")
ORDER_X_SQL = "CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey % 100 + (o_orderkey % 32) / 32.0::double END"
ORDER_Y_SQL = "CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey // 1500 + ((o_orderkey // 32) % 32) / 32.0::double END"


def pivot_sql(categories: dict) -> str:
    """Comma-separated count columns for every category value."""
    return ", ".join(
        f"count(*) FILTER (WHERE {c} = {v!r}) AS \"{P.pivot_name(c, v)}\"" for c, vs in categories.items() for v in vs)


def having_sql(categories: dict) -> str:
    return " AND ".join(f"count({c}) > 0" for c in categories)


def _edges_sql() -> str:
    rows = []
    for kind, rings in SHAPES.items():
        for r, points in enumerate(rings):
            for i, ((ax, ay), (bx, by)) in enumerate(zip(points, points[1:])):
                rows.append(f"({kind}, {r}, {i}, {ax}::double, {ay}::double, {bx}::double, {by}::double)")
    return (f"SELECT {pad_sql('s_suppkey')} AS tract, s_suppkey % 100 AS gx, s_suppkey // 100 AS gy, "
            "s_suppkey % 100 + ax AS x1, s_suppkey // 100 + ay AS y1, s_suppkey % 100 + bx AS x2, "
            "s_suppkey // 100 + by_ AS y2 FROM supplier JOIN "
            f"(VALUES {', '.join(rows)}) v(kind, ring, i, ax, ay, bx, by_) ON s_suppkey % 3 = kind "
            "WHERE s_suppkey % 13 <> 12")


def hits_sql(points: str) -> str:
    """Pairs (x, y, tract) for the distinct points of a view."""
    return f"""
SELECT p.x, p.y, e.tract
FROM (SELECT DISTINCT x, y FROM {points} WHERE x IS NOT NULL) p
JOIN edges e ON p.x >= e.gx AND p.x <= e.gx + 1 AND p.y >= e.gy AND p.y <= e.gy + 1
GROUP BY p.x, p.y, e.tract
HAVING sum(CASE WHEN (y1 > p.y) <> (y2 > p.y)
                 AND p.x < (x2 - x1) * (p.y - y1) / nullif(y2 - y1, 0) + x1 THEN 1 ELSE 0 END) % 2 = 1
    OR bool_or((x2 - x1) * (p.y - y1) = (y2 - y1) * (p.x - x1)
               AND p.x BETWEEN least(x1, x2) AND greatest(x1, x2)
               AND p.y BETWEEN least(y1, y2) AND greatest(y1, y2))"""


def _race_count(kind: str, slot: int) -> str:
    return f"count(*) FILTER (WHERE p_type = '{kind}' OR (p_type IN ('SMALL', 'STANDARD') AND l_suppkey % 5 = {slot}))"


def _education_sql(year: int, period: str) -> str:
    last, name = education_number(year)
    cols = ", ".join(f"count(*) FILTER (WHERE cast(l_quantity AS int) % {last - 1} = {n - 2}) AS {name}_{n:03d}E"
                     for n in range(2, last + 1))
    levels = []
    for level in C.EDUCATION_LEVELS[year]:
        total = " + ".join(f"{c}::double / {name}_001E" for c in L.census_codes(year, level))
        levels.append(f"{total} AS {level}")
    return (f"SELECT {', '.join(levels)}, {year} AS year, cast(l_suppkey AS varchar) AS tract, '031' AS county, "
            f"{name}_001E::double AS pop_over_25 FROM (SELECT l_suppkey, count(*) AS {name}_001E, {cols} "
            f"FROM lineitem WHERE year(l_shipdate) {period} GROUP BY l_suppkey)")


LEVEL_NAMES = list(C.EDUCATION_LEVELS[2017])

_GROWN = ", ".join(
    f'"{c}" / total_crime AS "perc_{c}"' for c in CLASS_COLUMNS)


def _increase_sql(c: str) -> str:
    before = f'lag("{c}") OVER (PARTITION BY tract ORDER BY year)'
    g = (f'CASE WHEN {before} = 0 THEN CASE WHEN "{c}" > 0 THEN \'inf\'::double END '
         f'ELSE ("{c}" - {before})::double / {before} END')
    return f"({g})"


VIEW_SQL = {
    "panel_s": f"SELECT {pad_sql('l_suppkey')} AS tract, cast(year(l_shipdate) AS int) AS year, "
               "s_nationkey AS commarea, count(*) AS filings_total, sum(l_quantity) AS filings_rate "
               "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL",
    "panel_c": f"SELECT {pad_sql('o_custkey')} AS tract, cast(year(o_orderdate) AS int) AS year, "
               "c_nationkey AS commarea, count(*) AS filings_total "
               "FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
    "panel_h": "SELECT tract, year, commarea, filings_total, "
               "CASE WHEN (cast(tract AS int) + year) % 7 <> 0 THEN filings_rate END AS filings_rate FROM panel_s",
    "incidents": f"SELECT {pad_sql('l_suppkey')} AS tract, cast(year(l_shipdate) AS int) AS year, "
                 f"{CLASS_SQL} AS crime_class, CASE WHEN l_partkey % 7 <> 0 THEN p_type END AS primary_type, "
                 "cast(l_linestatus = 'F' AS int) AS domestic, cast(l_returnflag = 'R' AS int) AS arrest, "
                 f"{LINE_X_SQL} AS x, {LINE_Y_SQL} AS y FROM lineitem JOIN part ON l_partkey = p_partkey",
    "violations": "SELECT o_orderkey AS id, cast(year(o_orderdate) AS int) AS year, o_orderstatus AS violation_status, "
                  "o_orderpriority AS inspection_category, c_mktsegment AS department_bureau, "
                  f"{ORDER_X_SQL} AS x, {ORDER_Y_SQL} AS y FROM orders JOIN customer ON o_custkey = c_custkey",
    "edges": _edges_sql(),
    "incident_hits": hits_sql("incidents"),
    "violation_hits": hits_sql("violations"),
    "tracts": f"SELECT {pad_sql('s_suppkey')} AS tract, s_nationkey AS commarea FROM supplier",
    "raw_census": f"""
SELECT '17031' || {pad_sql('l_suppkey')} AS tract, CASE WHEN year(l_shipdate) < 2000 THEN 1995 ELSE 2000 END AS year,
  count(*) FILTER (WHERE l_linestatus = 'F') AS housing_units_total,
  count(*) FILTER (WHERE l_linestatus = 'F' AND l_returnflag = 'A') AS housing_units_rental,
  count(*) FILTER (WHERE l_linestatus = 'F' AND l_returnflag <> 'A') AS housing_units_other,
  count(*) AS population_total,
  count(*) FILTER (WHERE l_returnflag = 'R') AS population_poverty_below,
  count(*) FILTER (WHERE l_returnflag <> 'R') AS population_poverty_above,
  {_race_count('LARGE', 2)} AS population_race_white, {_race_count('ECONOMY', 1)} AS population_race_black,
  {_race_count('MEDIUM', 3)} AS population_race_latinx, {_race_count('PROMO', 4)} AS population_race_asian,
  count(*) FILTER (WHERE p_type IN ('SMALL', 'STANDARD') AND l_suppkey % 5 = 0) AS population_race_other
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, l_suppkey""",
    "census": """
SELECT right(tract, 6) AS tract, year, housing_units_total,
  housing_units_rental / nullif(housing_units_total, 0) AS housing_units_rental,
  housing_units_other / nullif(housing_units_total, 0) AS housing_units_other,
  population_total, population_poverty_below / population_total AS population_poverty_below,
  population_poverty_above / population_total AS population_poverty_above,
  population_race_white / population_total AS population_race_white,
  population_race_black / population_total AS population_race_black,
  population_race_latinx / population_total AS population_race_latinx,
  population_race_asian / population_total AS population_race_asian,
  population_race_other / population_total AS population_race_other,
  CASE WHEN greatest(population_race_black, population_race_white, population_race_latinx, population_race_asian)
            / population_total < 0.4::double THEN 'Integrated'
       WHEN population_race_black >= greatest(population_race_white, population_race_latinx, population_race_asian) THEN 'Black'
       WHEN population_race_white >= greatest(population_race_latinx, population_race_asian) THEN 'White'
       WHEN population_race_latinx >= population_race_asian THEN 'Latin' ELSE 'Asian' END AS race,
  CASE WHEN population_poverty_above / population_total > 0.3::double THEN 'Poor' ELSE 'Non-Poor' END AS poor
FROM raw_census""",
    "education": f"{_education_sql(2010, '< 2000')} UNION ALL {_education_sql(2017, '>= 2000')}",
    "crime_home": f"SELECT tract, year, count(*) AS total_crime, {pivot_sql({'crime_class': CLASS_NAMES})} "
                  "FROM incidents GROUP BY tract, year HAVING count(crime_class) > 0",
    "crime_features": f"SELECT *, {_GROWN}, " + ", ".join(
        f'CASE WHEN year <> {FIRST_YEAR} THEN CASE WHEN {_increase_sql(c)} >= 1 THEN 1 ELSE {_increase_sql(c)} END END '
        f'AS "perc_increase_{c}"' for c in ["total_crime", *CLASS_COLUMNS]) + " FROM crime_home",
    "violation_panel": "SELECT tract, year, count(*) AS total_building_violations, "
                       f"{pivot_sql(VIOLATION_CATEGORIES)} FROM violations JOIN violation_hits USING (x, y) "
                       f"GROUP BY tract, year HAVING {having_sql(VIOLATION_CATEGORIES)}",
    "building_features": "SELECT *, " + ", ".join(
        f'"{c}" / total_building_violations AS "{c}_perc"' for c in STATUS_COLUMNS)
        + f", CASE WHEN year <> {FIRST_YEAR} THEN {_increase_sql('total_building_violations')} END AS perc_increase_bv "
        "FROM violation_panel",
    "scored": "SELECT l.doc_id, quality AS label, lang, source, n_chars AS score "
              "FROM labels l JOIN documents d ON l.doc_id = d.doc_id",
    "scored_runs": "SELECT doc_id, label, CASE WHEN doc_id % 2 = 0 THEN '2013-01-01' ELSE '2014-01-01' END AS split_date, "
                   "model, CASE model WHEN 'A' THEN score WHEN 'B' THEN -score ELSE doc_id END::double AS score "
                   "FROM scored, (VALUES ('A'), ('B'), ('C')) m(model)",
    "cuts": "SELECT year, round(quantile_cont(filings_rate, 0.9), 9) AS threshold FROM panel_s GROUP BY year",
    "labelled": """
SELECT p.*, p.year + 1 AS next_year, n.filings_rate AS filings_rate_next_year,
  cast(coalesce(n.filings_rate >= a.threshold, false) AS int) AS label,
  cast(coalesce(p.filings_rate >= o.threshold, false) AS int) AS label_prev_year
FROM panel_s p LEFT JOIN panel_s n ON n.tract = p.tract AND n.year = p.year + 1
LEFT JOIN cuts o ON o.year = p.year LEFT JOIN cuts a ON a.year = p.year + 1""",
}
