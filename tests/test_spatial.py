import math
import random

from pyspark.sql import functions as F

from areapanel.functions import geometry as G
from areapanel.operators import spatial as SP

SQUARE = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
HOLE = [[1, 1], [1, 3], [3, 3], [3, 1], [1, 1]]
NEXT = [[4, 0], [8, 0], [8, 4], [4, 4], [4, 0]]
NOTCH = [[10, 0], [14, 0], [14, 4], [12, 1], [10, 4], [10, 0]]


def polygons(values):
    rows = [("ring", [[SQUARE, HOLE]]), ("next", [[NEXT]]), ("notch", [[NOTCH]])]
    raw = values([(k, [[[[float(x), float(y)] for x, y in r] for r in p] for p in ps]) for k, ps in rows],
                 "tract string, coordinates array<array<array<array<double>>>>")
    return raw.select("tract", G.multipolygon_edges("coordinates").alias("edges")), rows


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            on_line = (bx - ax) * (y - ay) == (by - ay) * (x - ax)
            if on_line and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                return True
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def brute(points, raw):
    return {(i, k) for i, x, y in points for k, ps in raw if inside(x, y, [r for p in ps for r in p])}


def pairs_of(found):
    got = [(r.id, r.tract) for r in found.select("id", "tract").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_join_matches_brute_force_for_any_number_of_edges_a_cell(values):
    shapes, raw = polygons(values)
    rng = random.Random(5)
    points = [(i, rng.randint(-8, 120) / 8, rng.randint(-8, 40) / 8) for i in range(500)]
    df = values(points + [(900, None, 1.0), (901, float("nan"), 1.0), (902, float("inf"), 1.0)], "id int, x double, y double")
    for most in (2, 5, 32):
        assert pairs_of(SP.spatial_join(df, shapes, max_edges=most)) == brute(points, raw)


def star(corners, x, y, inner, outer, rng):
    ring = []
    for i in range(corners):
        reach = outer if i % 2 else inner * rng.uniform(0.8, 1)
        ring.append([x + reach * math.cos(2 * math.pi * i / corners), y + reach * math.sin(2 * math.pi * i / corners)])
    return ring + ring[:1]


def shapes_of(values, rows):
    raw = values([(k, [[[[float(x), float(y)] for x, y in r] for r in p] for p in ps]) for k, ps in rows],
                 "tract string, coordinates array<array<array<array<double>>>>")
    return raw.select("tract", G.multipolygon_edges("coordinates").alias("edges"))


def test_one_huge_boundary_around_many_small_ones(values):
    rng = random.Random(8)
    huge = ("huge", [[star(6000, 0, 0, 80, 100, rng)]])
    small = [(f"s{i}", [[[[x, y], [x + 1, y], [x + 1, y + 1], [x, y + 1], [x, y]]]])
             for i, (x, y) in enumerate((i % 50 - 25, i // 50 - 25) for i in range(2500))]
    shapes = shapes_of(values, [huge, *small])
    cells = SP.polygon_cells(shapes.select(F.xxhash64("tract").alias("_id"), "edges"))
    size = cells.agg(F.max(F.size("edges")).alias("most"), F.sum(F.greatest(F.size("edges"), F.lit(0))).alias("all")).first()
    # no cell has more than a few edges, and an edge is in a few cells only
    assert size.most <= SP.MAX_EDGES and size.all < 4 * (6000 + 4 * 9 * 2500)
    points = [(i, rng.uniform(-110, 110), rng.uniform(-110, 110)) for i in range(200)]
    points += [(1000 + i, rng.uniform(-26, 26), rng.uniform(-26, 26)) for i in range(50)]
    points += [(2000, -25.0, -25.0), (2001, 0.0, 0.0), (2002, -25.0, -24.5)]
    assert pairs_of(SP.spatial_join(values(points, "id int, x double, y double"), shapes)) == brute(points, [huge, *small])


def test_odd_sizes_and_degenerate_shapes(values):
    flat = ("flat", [[[[1, 1], [5, 1], [1, 1]]]])
    dot = ("dot", [[[[3, 3], [3, 3], [3, 3]]]])
    tiny = ("tiny", [[[[7, 7], [7 + 1e-7, 7], [7, 7 + 1e-7], [7, 7]]]])
    vast = ("vast", [[[[-1e12, -1e12], [1e12, -1e12], [1e12, 1e12], [-1e12, 1e12], [-1e12, -1e12]]]])
    rows = [flat, dot, tiny, vast]
    points = [(1, 2.0, 1.0), (2, 3.0, 3.0), (3, 7.0, 7.0), (4, 7 + 2e-8, 7 + 2e-8), (5, -1e12, 5.0), (6, 2e12, 0.0), (7, 1e300, 1.0)]
    assert pairs_of(SP.spatial_join(values(points, "id int, x double, y double"), shapes_of(values, rows))) == brute(points, rows)


def test_names_used_inside_and_no_polygon_at_all(values):
    shapes, _ = polygons(values)
    df = values([(1, 2.5, 0.5, "a", "b")], "id int, x double, y double, level string, _polygon string")
    assert pairs_of(SP.spatial_join(df, shapes)) == {(1, "ring")}
    assert SP.spatial_join(df, shapes.where("tract = 'none'")).count() == 0


def test_shared_border_hole_and_corner(values):
    shapes, _ = polygons(values)
    df = values([(1, 4.0, 2.0), (2, 2.0, 2.0), (3, 1.0, 2.0), (4, 12.0, 3.0), (5, 12.0, 1.0)], "id int, x double, y double")
    got = {}
    for r in SP.spatial_join(df, shapes).collect():
        got.setdefault(r.id, set()).add(r.tract)
    assert got == {1: {"ring", "next"}, 3: {"ring"}, 5: {"notch"}}


def test_shuffled_join_gives_the_same_pairs(values, monkeypatch):
    shapes, _ = polygons(values)
    df = values([(i, i % 13 + 0.5, i % 4 + 0.25) for i in range(200)], "id int, x double, y double")
    small = pairs_of(SP.spatial_join(df, shapes, max_edges=2))
    monkeypatch.setattr(SP, "broadcast_by_bytes", lambda table: table)
    assert pairs_of(SP.spatial_join(df, shapes, max_edges=2)) == small
