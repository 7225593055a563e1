"""Incident points to area-by-year panels, and the joined modelling table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from areapanel.operators import panel as P
from areapanel.operators.spatial import spatial_join
from areapanel.sources.landed import write_table


def crime_panel(incidents: DataFrame, polygons: DataFrame, categories: Mapping[str, Sequence],
                keep_all: bool = False, output: str | None = None, other: bool = False) -> DataFrame:
    """Counts per (tract, year): total, and one column per category value (unlisted ones raise, or `other` counts them)."""
    return _panel(incidents, polygons, categories, "total_crime", keep_all, output, other)


def violation_panel(violations: DataFrame, polygons: DataFrame, categories: Mapping[str, Sequence],
                    keep_all: bool = False, output: str | None = None, other: bool = False) -> DataFrame:
    return _panel(violations, polygons, categories, "total_building_violations", keep_all, output, other)


def _panel(points, polygons, categories, total, keep_all, output, other):
    located = spatial_join(points.select("x", "y", "year", *categories), polygons.select("tract", "edges"))
    out = P.multi_pivot(located, categories, total=total, keep_all=keep_all, other=other)
    if output:
        write_table(out, output, by=["year"])
        return out.sparkSession.read.parquet(output)
    return out
