"""Point-in-polygon join on a hierarchical cover of cells.

Cells of level L have the side 4^-L, so a cell holds sixteen of the next level and every border is exact. A polygon starts with
the few cells of the level that fits its own extent; a cell that more than `MAX_EDGES` edges touch is split again. Edges are rows
from the start and go to the cells they touch only, so neither a huge boundary nor its edges end up in one task or in every cell.

A cell without edges is wholly inside or outside; outside ones are dropped, inside ones need no geometry. Any other cell keeps
its edges and one bit, `odd`, for all edges elsewhere. The bit can be one because of how edges are counted: an edge counts for a
point if a ray to the right meets it, and each of its ends right of the cell's right border and above the point counts once more.
Ends meet in pairs, as rings are closed, so these extra counts cancel over a polygon; and an edge that does not
touch the cell then counts the same for each point of it. A split carries the bit on by one exclusive-or over the cell's edges.

The cells of a polygon do not overlap: a point meets a polygon in one cell, and the join needs no distinct.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areapanel.functions.geometry import EDGE_TYPE, on_an_edge
from areapanel.operators.sizing import broadcast_by_bytes
from areapanel.session import stage

MAX_EDGES = 32
# No cell is smaller than this share of the polygon's largest coordinate: below, rounding would decide what touches it.
FINEST = 2.0 ** -28
PAD = 1e-5
CELL = ["_id", "level", "cx", "cy"]
EDGE = ["x1", "y1", "x2", "y2"]


def cell_side(level: Column) -> Column:
    return F.pow(F.lit(4.0), -level)


def cell_index(c: Column, side: Column) -> Column:
    return F.floor(c / side)


def _crosses(x: Column, y: Column, e) -> Column:
    """A ray from (x, y) to the right meets the edge."""
    height = F.nullif(e("y2") - e("y1"), F.lit(0.0))
    meets = F.coalesce(x < (e("x2") - e("x1")) * (y - e("y1")) / height + e("x1"), F.lit(False))
    return ((e("y1") > y) != (e("y2") > y)) & meets


def _ends(right: Column, y: Column, e) -> Column:
    """An odd number of the edge's ends is right of `right` and above y."""
    return ((e("x1") > right) & (e("y1") > y)) != ((e("x2") > right) & (e("y2") > y))


def edge_rows(polygons: DataFrame) -> DataFrame:
    """One row per edge, with its polygon's first level, deepest level and range of first cells."""
    xs, ys = F.concat("edges.x1", "edges.x2"), F.concat("edges.y1", "edges.y2")
    boxed = polygons.where(F.size("edges") > 0).select("_id", "edges", *[
        f(v).alias(n) for n, f, v in (("x_lo", F.array_min, xs), ("x_hi", F.array_max, xs), ("y_lo", F.array_min, ys), ("y_hi", F.array_max, ys))])
    reach = F.greatest(*[F.abs(c) for c in ("x_lo", "x_hi", "y_lo", "y_hi")], F.lit(1e-300))
    extent = F.greatest(F.col("x_hi") - F.col("x_lo"), F.col("y_hi") - F.col("y_lo"), reach * FINEST)
    boxed = boxed.withColumn("deepest", F.floor(-F.log(reach * FINEST) / F.log(F.lit(4.0)))) \
        .withColumn("level", F.least(F.floor(1 - F.log(extent) / F.log(F.lit(4.0))), "deepest"))
    side = cell_side(F.col("level"))
    cells = [cell_index(F.col(c), side).alias(c) for c in ("x_lo", "x_hi", "y_lo", "y_hi")]
    rows = boxed.select("_id", "level", "deepest", *cells, F.explode("edges").alias("e"))
    return rows.select("_id", "level", "deepest", "x_lo", "x_hi", "y_lo", "y_hi", *[F.col(f"e.{c}").alias(c) for c in EDGE])


def _counted(pairs: DataFrame, before: Column) -> DataFrame:
    """Edge and cell pairs with `touch` and `bit`, what the edge adds to the cell's bit. `before` is what the edge was in the cell above."""
    side = cell_side(F.col("level"))
    x, y, right = (F.col("cx") + 0.5) * side, (F.col("cy") + 0.5) * side, (F.col("cx") + 1) * side
    dx, dy, half = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), side * (0.5 + PAD)
    boxes = ((F.greatest("x1", "x2") >= x - half) & (F.least("x1", "x2") <= x + half)
             & (F.greatest("y1", "y2") >= y - half) & (F.least("y1", "y2") <= y + half))
    touch = boxes & (F.abs(dx * (y - F.col("y1")) - dy * (x - F.col("x1"))) <= (F.abs(dx) + F.abs(dy)) * half)
    now = F.when(F.col("touch"), _ends(right, y, F.col)).otherwise(_crosses(x, y, F.col))
    return pairs.withColumn("touch", touch).withColumn("bit", (before != now).cast("int"))


def _first_cells(edges: DataFrame) -> DataFrame:
    steps = [F.explode(F.sequence(f"{a}_lo", f"{a}_hi")) for a in "xy"]
    pairs = edges.withColumn("cx", steps[0]).withColumn("cy", steps[1]).withColumn("odd", F.lit(0))
    return _counted(pairs.select(*CELL, "deepest", "odd", *EDGE), F.lit(False))


def _split(overfull: DataFrame) -> DataFrame:
    """The sixteen cells within each cell, each with all edges of it."""
    right = (F.col("cx") + 1) * cell_side(F.col("level"))
    step = F.explode(F.sequence(F.lit(0), F.lit(3)))
    pairs = overfull.withColumn("above", right).withColumn("i", step).withColumn("j", step)
    pairs = pairs.select("_id", (F.col("level") + 1).alias("level"), (F.col("cx") * 4 + F.col("i")).alias("cx"),
                         (F.col("cy") * 4 + F.col("j")).alias("cy"), "deepest", "odd", "above", *EDGE)
    y = (F.col("cy") + 0.5) * cell_side(F.col("level"))
    return _counted(pairs, _ends(F.col("above"), y, F.col))


def polygon_cells(polygons: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """(_id, level, cx, cy, odd, edges) of polygons (_id, edges): the cells that are inside (no edges) or on a border.

    Each round is one aggregation over (edge, cell) pairs, combined map-side, and one join of edges to the cells they touch.
    At the finest level a cell keeps all edges that still meet in it.
    """
    edges = stage(edge_rows(polygons).repartition("x1", "y1", "x2", "y2"), "edges")
    pairs, done = _first_cells(edges), []
    while True:
        cells = stage(pairs.groupBy(*CELL, "deepest").agg(
            F.count_if("touch").alias("n"), F.bit_xor("bit").bitwiseXOR(F.max("odd")).alias("odd")), "cells")
        done.append(cells.where("n = 0 and odd = 1").select(*CELL, "odd", F.lit(None).cast(EDGE_TYPE).alias("edges")))
        touching = pairs.where("touch").select(*CELL, *EDGE).join(cells.select(*CELL, "deepest", "odd", "n"), CELL)
        split = (F.col("n") > max_edges) & (F.col("level") < F.col("deepest"))
        more = not cells.where(split).isEmpty()
        if more:  # read by two branches then
            touching = stage(touching, "touching")
        done.append(touching.where(~split).groupBy(*CELL).agg(F.max("odd").alias("odd"), F.collect_list(F.struct(*EDGE)).alias("edges")))
        if not more:
            return reduce(DataFrame.unionByName, done)
        pairs = _split(touching.where(split).drop("n"))


def spatial_join(points: DataFrame, polygons: DataFrame, x: str = "x", y: str = "y", max_edges: int = MAX_EDGES) -> DataFrame:
    """Inner join of points to every polygon they intersect, borders included.

    `polygons` has an `edges` column of closed rings and its own attributes, none named as a column of the points; points
    without finite coordinates drop out. A point asks once for each level in use. The cells are broadcast if their bytes allow it,
    otherwise points and cells meet in a shuffle join, and so do the pairs with the polygons' attributes.
    """
    shapes = stage(polygons.withColumn("_id", F.monotonically_increasing_id()), "polygons")
    cells = stage(polygon_cells(shapes.select("_id", "edges"), max_edges).withColumnRenamed("_id", "_polygon"), "cover")
    levels = [r.level for r in cells.select("level").distinct().orderBy("level").collect()]
    px, py = F.col(f"_point.`{x}`"), F.col(f"_point.`{y}`")
    finite = (F.abs(px.cast("double")) < float("inf")) & (F.abs(py.cast("double")) < float("inf"))
    kept = points.select(F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("_point")).where(finite)
    asks = [F.struct(F.lit(v).cast("long").alias("level"), cell_index(px, F.lit(4.0 ** -v)).alias("cx"),
                     cell_index(py, F.lit(4.0 ** -v)).alias("cy")) for v in levels]
    places = F.array(*asks) if asks else F.expr("cast(array() as array<struct<level:bigint,cx:bigint,cy:bigint>>)")
    placed = kept.select("_point", F.inline(places))
    right = (F.col("cx") + 1) * cell_side(F.col("level"))

    def counts(e: Column) -> Column:
        return _crosses(px, py, lambda c: e[c]) != _ends(right, py, lambda c: e[c])

    odd = F.col("odd").bitwiseXOR((F.size(F.filter("edges", counts)) % 2).cast("int")) == 1
    hit = F.col("edges").isNull() | odd | on_an_edge(F.col("edges"), px, py)
    pairs = placed.join(broadcast_by_bytes(cells), ["level", "cx", "cy"]).where(hit).select("_point", "_polygon")
    others = [c for c in polygons.columns if c != "edges"]
    attributes = shapes.select(F.col("_id").alias("_polygon"), F.struct(*[F.col(f"`{c}`") for c in others], F.lit(0).alias("_")).alias("_shape"))
    met = pairs.join(broadcast_by_bytes(attributes), "_polygon")
    return met.select(*[F.col(f"_point.`{c}`").alias(c) for c in points.columns], *[F.col(f"_shape.`{c}`").alias(c) for c in others])
