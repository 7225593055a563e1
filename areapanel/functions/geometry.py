"""Nested location text to points and polygon edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from areapanel.functions.scalar import as_column, coerce_number

POINT_SCHEMA = "type string, coordinates array<double>, latitude string, longitude string"
POLYGON_SCHEMA = "type string, coordinates array<array<array<double>>>"
MULTIPOLYGON_SCHEMA = "type string, coordinates array<array<array<array<double>>>>"
EDGE_TYPE = "array<struct<x1:double,y1:double,x2:double,y2:double>>"


def parse_literal(c: Column | str, schema: str) -> Column:
    """Nested literal text (single or double quotes, None for missing) to a struct."""
    text = F.regexp_replace(as_column(c), r"([:,\[]\s*)None\b", "$1null")
    return F.from_json(text, schema, {"allowSingleQuotes": "true"})


def point_struct(location: Column | str) -> Column:
    """Parsed location to struct<x,y>: GeoJSON when it has a type, else longitude/latitude."""
    loc = as_column(location)
    geo = loc["type"].isNotNull()
    x = F.when(geo, F.get(loc["coordinates"], F.lit(0))).otherwise(coerce_number(loc["longitude"]))
    y = F.when(geo, F.get(loc["coordinates"], F.lit(1))).otherwise(coerce_number(loc["latitude"]))
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def ring_edges(ring: Column) -> Column:
    """Consecutive vertices of a closed ring as edges."""
    def edge(a: Column, b: Column) -> Column:
        return F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))

    heads = F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0)))
    return F.transform(heads, lambda point, i: edge(point, ring[i + 1]))


def multipolygon_edges(coordinates: Column | str) -> Column:
    """All edges of all rings; inside means an odd number of crossings."""
    rings = F.flatten(as_column(coordinates))
    return F.flatten(F.transform(rings, ring_edges))


def geojson_edges(text: Column | str) -> Column:
    """Edges of a Polygon or MultiPolygon given as literal text; missing stays missing."""
    multi = parse_literal(text, MULTIPOLYGON_SCHEMA)
    single = parse_literal(text, POLYGON_SCHEMA)
    return F.when(multi["type"] == "MultiPolygon", multipolygon_edges(multi["coordinates"])) \
            .when(single["type"] == "Polygon", F.flatten(F.transform(single["coordinates"], ring_edges)))


def crossings_odd(edges: Column, x: Column, y: Column) -> Column:
    """True when a ray from (x, y) to the right crosses an odd number of edges."""
    def crosses(e: Column) -> Column:
        spans = (e["y1"] > y) != (e["y2"] > y)
        height = F.nullif(e["y2"] - e["y1"], F.lit(0.0))
        return spans & F.coalesce(x < (e["x2"] - e["x1"]) * (y - e["y1"]) / height + e["x1"], F.lit(False))

    return F.size(F.filter(edges, crosses)) % 2 == 1


def on_an_edge(edges: Column, x: Column, y: Column) -> Column:
    """True when (x, y) lies on one of the edges."""
    def touches(e: Column) -> Column:
        aligned = (e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"])
        return (aligned & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
                & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])))

    return F.exists(edges, touches)
