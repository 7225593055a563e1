"""Scans of landed files, typed loaders for each base, and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areapanel.functions import geometry as G
from areapanel.functions import scalar as S
from areapanel.sources import schemas as C


def between_years(df: DataFrame, column: str, first: int | None, last: int | None,
                  is_date: bool = False) -> DataFrame:
    """Inclusive year filter in a form the file source can push down.

    On a date column the years become a range of dates.
    """
    if first is None or last is None:
        return df
    if is_date:
        # Literals in the column's own type reach the file source; ISO text compares as text.
        low, high = (F.lit(f"{y:04d}-01-01").cast(dict(df.dtypes)[column]) for y in (first, last + 1))
        return df.where((F.col(column) >= low) & (F.col(column) < high))
    return df.where(F.col(column).between(first, last))


def scan(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None,
         first_year: int | None = None, last_year: int | None = None, date_column: str = "year",
         is_date: bool = False, limit: int | None = None) -> DataFrame:
    """Landed table with an optional year range and row limit; `the_geom` is read as `location`."""
    reader = spark.read.format(fmt)
    if schema:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    df = between_years(reader.load(path), date_column, first_year, last_year, is_date)
    df = df.withColumnRenamed("the_geom", "location")
    return df if limit is None else df.limit(limit)


def csv_scan(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.select(*columns) if columns else df


def csv_or_none(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The table, or None when nothing is at the path."""
    try:
        return csv_scan(spark, path, schema) if schema else spark.read.option("header", True).csv(path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Parquet, laid out by the given columns so later scans prune."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def sample_share(df: DataFrame, share: float = 0.05, seed: int | None = None) -> DataFrame:
    return df.sample(fraction=share, seed=seed)


def typed(df: DataFrame, numbers: Sequence[str] = (), flags: Sequence[str] = (), dates: Sequence[str] = (),
          integers: Sequence[str] = ()) -> DataFrame:
    """Cast named columns: lenient numbers, strict 0/1 flags and integers, strict timestamps."""
    return df.withColumns({**{c: S.coerce_number(c) for c in numbers}, **{c: S.strict_int(c) for c in integers},
                           **{c: S.flag_int(c) for c in flags}, **{c: S.parse_timestamp(c) for c in dates}})


def ingest_incidents(raw: DataFrame, code: str = "fbi_code") -> DataFrame:
    """Typed incidents with the class of each offence code."""
    return typed(raw, C.CRIME_NUMBERS, C.CRIME_FLAGS, ["date"]) \
        .withColumn("crime_class", S.classify(code, C.CRIME_CLASSES))


def ingest_violations(raw: DataFrame) -> DataFrame:
    return typed(raw, C.VIOLATION_NUMBERS, (), C.VIOLATION_DATES) \
        .withColumn("year", S.year_of("violation_date"))


def _located(df: DataFrame) -> DataFrame:
    # Parsed in a projection of its own, so that each text is read once.
    parsed = df.withColumn("_l", G.parse_literal("location", G.POINT_SCHEMA)).withColumn("_p", G.point_struct("_l"))
    return parsed.withColumns({"x": F.col("_p.x"), "y": F.col("_p.y")}).drop("_l", "_p", "location")


def incident_points(raw: DataFrame) -> DataFrame:
    """Typed incidents with x, y from the location text."""
    return _located(typed(raw, C.CRIME_NUMBERS, C.CRIME_FLAGS, ["date", "updated_on"]))


def violation_points(raw: DataFrame) -> DataFrame:
    return _located(typed(raw, C.VIOLATION_NUMBERS, (), C.VIOLATION_DATES))


def tract_table(raw: DataFrame) -> DataFrame:
    """Boundary table with the panel's names."""
    return raw.withColumnsRenamed({"the_geom": "location", "tractce10": "tract"})


def tract_polygons(raw: DataFrame) -> DataFrame:
    """tract, commarea and the polygon's edges."""
    return raw.select(S.zero_pad("tract").alias("tract"), "commarea", G.geojson_edges("location").alias("edges"))


def tract_dimension(raw: DataFrame, keep_geometry: bool = False) -> DataFrame:
    geometry = [F.col("location")] if keep_geometry else []
    return raw.select(S.zero_pad("tract").alias("tract"), "commarea", *geometry)


def census_codes(year: int, level: str, levels: Mapping = C.EDUCATION_LEVELS) -> list[str]:
    """Census variable names of a level."""
    return list(levels[year][level])


def education_shares(surveys: Mapping[int, DataFrame], codes: Mapping[int, Mapping[str, Sequence[str]]] | None = None,
                     totals: Mapping[int, str] | None = None) -> DataFrame:
    """Share of each attainment level in the population over 25, all surveys in one table."""
    codes = codes or {y: {lv: census_codes(y, lv) for lv in C.EDUCATION_LEVELS[y]} for y in surveys}
    totals = totals or {y: f"{C.EDUCATION_TABLES[y]}_001E" for y in surveys}
    parts = []
    for year, raw in surveys.items():
        total = F.col(totals[year]).cast("double")
        level = [S.row_sum([S.ratio(c, total) for c in names]).alias(name) for name, names in codes[year].items()]
        parts.append(raw.select(*level, F.lit(year).alias("year"), "tract", "county", total.alias("pop_over_25")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def census_base(raw: DataFrame, poor_column: str = "population_poverty_above") -> DataFrame:
    """Housing and population shares, majority group and poverty class per tract.

    `poor` marks areas where the chosen share exceeds the limit; by default that is the
    share above the poverty line, as the published results use it.
    """
    housing = ["housing_units_rental", "housing_units_other"]
    people = [c for c in raw.columns if c.startswith(("population_poverty_", "population_race_"))]
    shared = raw.withColumns({"tract": S.code_suffix("tract"),
                              **{c: S.ratio(c, "housing_units_total") for c in housing},
                              **{c: S.ratio(c, "population_total") for c in people}})
    return shared.withColumns({
        "race": S.largest_share_class(C.RACE_ORDER, C.MAJORITY_MINIMUM, "Integrated"),
        "poor": S.threshold_flag(poor_column, C.POOR_LIMIT, "Poor", "Non-Poor")})


def education_base(raw: DataFrame, drop: Sequence[str] = ("_c0", "Unnamed: 0", "Unnamed: 0.1")) -> DataFrame:
    return raw.drop(*drop).withColumn("tract", S.zero_pad(S.strict_int("tract")))


def rates_base(raw: DataFrame) -> DataFrame:
    """The declared columns, with year and the six-character tract code."""
    day: Column = S.parse_timestamp("filing_year")
    return raw.select(day.alias("filing_year"), S.code_suffix("tract").alias("tract"), *C.RATE_COLUMNS) \
              .withColumn("year", S.year_of("filing_year"))


def load_rates(spark: SparkSession, path: str) -> DataFrame:
    """Rates base from CSV, reading only the declared columns by header name."""
    wide = spark.read.option("header", True).csv(path)
    return rates_base(wide.select("filing_year", "tract", *[S.coerce_number(c).alias(c) for c in C.RATE_COLUMNS]))
