"""Rings, parts in a grid and unions of areas, against brute force."""

import math
import random

import pytest

from tessera.operators import rings, spatial
from tessera.sources import osm


def line(nodes, at):
    nodes = list(nodes)
    return (list(nodes), [at[n] for n in nodes])


AT = {1: (0, 0), 2: (4, 0), 3: (4, 4), 4: (0, 4), 8: (6, 6), 9: (-3, -3), 5: (6, 4), 6: (6, 7), 7: (4, 6), 10: (3, 3), 11: (3, 2), 12: (2, 3)}


@pytest.mark.parametrize("ways, want", [
    ([[1, 2, 3], [3, 8], [3, 4, 1]], [[1, 2, 3, 4]]),
    ([[9, 1], [1, 2, 3], [3, 4, 1]], [[1, 2, 3, 4]]),
    ([[1, 2, 3], [3, 5, 6], [6, 7, 3], [3, 4, 1]], [[1, 2, 3, 4], [3, 5, 6, 7]]),
    ([[1, 2, 3], [3, 11, 10], [10, 12, 3], [3, 4, 1]], [[1, 2, 3, 4], [3, 12, 10, 11]]),
    ([[1, 2, 3, 4, 1], [3, 5, 6, 7, 3], [10, 11, 12, 10]], [[1, 2, 3, 4], [3, 5, 6, 7], [10, 12, 11]]),
    ([[1, 2], [3, 2], [1, 4, 3], [1, 3]], [[1, 2, 3], [1, 3, 4]]),
    ([[1, 2, 3], [3, 4]], []),
    ([[1, 1], [1, 2, 1], [3]], []),
    ([[10, 11, 12, 10], [10, 3], [3, 5, 6, 7, 3]], [[3, 5, 6, 7], [10, 12, 11]]),
])
def test_faces(ways, want):
    for turned in (False, True):
        found = rings.faces([line(reversed(w) if turned else w, AT) for w in ways])
        assert [names for names, _ in found] == want


@pytest.mark.parametrize("seed", range(25))
def test_faces_of_random_grids(seed):
    """Borders between unit cells, some missing: each group of cells that is closed off is one ring, around its holes too."""
    rng, n = random.Random(seed), 5
    borders = [((x, y), (x + 1, y)) for x in range(n) for y in range(n + 1)] + [((x, y), (x, y + 1)) for x in range(n + 1) for y in range(n)]
    kept = {b for b in borders if rng.random() < 0.75}
    beside = {}
    for (ax, ay), (bx, by) in borders:
        beside[(ax, ay), (bx, by)] = ((ax, ay), (ax, ay - 1)) if ay == by else ((ax, ay), (ax - 1, ay))
    cells = {(x, y) for x in range(-1, n + 1) for y in range(-1, n + 1)}
    near = {c: [] for c in cells}
    for b, (c, d) in beside.items():
        if b not in kept:
            near[c].append(d)
            near[d].append(c)
    for x, y in cells:  # beyond the grid all is open
        for d in ((x + 1, y), (x, y + 1)):
            if d in cells and not all(0 <= v < n for v in (x, y)) and not all(0 <= v < n for v in d):
                near[x, y].append(d)
                near[d].append((x, y))

    def reach(start, blocked=None):
        seen, todo = {start}, [start]
        while todo:
            c = todo.pop()
            around = near[c] if blocked is None else [d for d in ((c[0] + 1, c[1]), (c[0] - 1, c[1]), (c[0], c[1] + 1), (c[0], c[1] - 1)) if d in cells and d not in blocked]
            for d in around:
                if d not in seen:
                    seen.add(d)
                    todo.append(d)
        return seen

    outside, want, left = reach((-1, -1)), [], set(cells)
    left -= outside
    while left:
        group = reach(min(left))
        left -= group
        want.append(len(cells) - len(reach((-1, -1), group)))
    lines = [line([a, b] if rng.random() < 0.5 else [b, a], {a: a, b: b}) for a, b in kept]
    rng.shuffle(lines)
    found = rings.faces(lines)
    assert sorted(round(rings.signed_area(at)) for _, at in found) == sorted(want)


def test_rings_touch_and_have_spurs(spark):
    members = spark.createDataFrame([(1, k, "outer") for k in range(6)] + [(1, 9, "inner")], "relation long, way long, role string")
    ways = spark.createDataFrame([(0, [1, 2, 3]), (1, [3, 8]), (2, [3, 4, 1]), (3, [3, 5, 6]), (4, [6, 7, 3]), (5, [9, 1]), (9, [10, 12, 11, 10])], "id long, nodes array<long>")
    nodes = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in AT.items()], "id long, x double, y double")
    found = osm.multipolygons(osm.assemble_rings(members, ways, nodes)).collect()
    assert [[len(r) for r in p] for p in found[0].polygons] == [[4, 3], [4]]


SHAPE = "id long, polygon array<array<struct<x: double, y: double>>>"


def shapes(spark, *polygons):
    return spark.createDataFrame([(i, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in p]) for i, p in enumerate(polygons)], SHAPE)


def area(polygon):
    return sum(abs(rings.signed_area(r)) * (1 if i == 0 else -1) for i, r in enumerate(polygon))


def star(rng, cx, cy, low, high, n):
    radii = [rng.uniform(low, high) for _ in range(n)]
    return [(cx + r * math.cos(2 * math.pi * k / n), cy + r * math.sin(2 * math.pi * k / n)) for k, r in enumerate(radii)]


def test_parts_add_up(spark):
    rng = random.Random(4)
    polygons = [
        [[(0, 0), (10, 0), (10, 10), (0, 10)], [(4, 4), (4, 6), (6, 6), (6, 4)]],
        [[(0, 0), (0, 10), (10, 10), (10, 0)]],
        [[(0, 5.01), (10, 5.01), (10, 5.02), (0, 5.02)]],  # a strip between the cells' middles
        [[(0, 0), (10, 9.99), (10, 10), (0, 0.01)]],
        [star(rng, 5, 5, 4, 9, 60), star(rng, 5, 5, 0.5, 3, 30)[::-1]],
        [star(rng, 0, 0, 1, 9, 200)],
        [[(0, 0), (5, 5), (10, 0), (10, 10), (5, 5.5), (0, 10)]],  # corners on lines of the grid
        [[(0, 0), (5, 0), (5, 5), (10, 5), (10, 10), (0, 10)]],
    ]
    for n in (1, 2, 7):
        found = spatial.split_grid(shapes(spark, *polygons), "id", "polygon", n).collect()
        for i, p in enumerate(polygons):
            mine = [r for r in found if r.id == i]
            assert sum(r.area for r in mine) == pytest.approx(area(p), rel=1e-9)
            assert all(r.area > 0 and r.area <= (r.x1 - r.x0) * (r.y1 - r.y0) * (1 + 1e-9) for r in mine)
            assert len({(r.cell_x, r.cell_y) for r in mine}) == len(mine)
    strip = [r for r in found if r.id == 2]
    assert len(strip) == 49 and not any(r.inside for r in found if r.id == 3)
    hole = [r for r in found if r.id == 0 and not r.inside]
    assert {(r.cell_x, r.cell_y) for r in hole} == {(x, y) for x in (2, 3, 4) for y in (2, 3, 4)} - {(3, 3)}


def test_parts_hold_the_points_of_the_shape(spark):
    rng = random.Random(9)
    shape = [star(rng, 5, 5, 2, 9, 80), star(rng, 5, 5, 0.3, 1.9, 20)[::-1]]

    def within(polygon, x, y):
        return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for r in polygon for a, b in zip(r, r[1:] + r[:1])) % 2 == 1

    cells = spatial.split_grid(shapes(spark, shape), "id", "polygon", 9).collect()
    for _ in range(3000):
        x, y = rng.uniform(-4, 14), rng.uniform(-4, 14)
        own = [r for r in cells if r.x0 < x < r.x1 and r.y0 < y < r.y1]
        parts = [[[(p.x, p.y) for p in ring] for ring in polygon] for r in own for polygon in r.parts]
        assert sum(within(p, x, y) for p in parts) == within(shape, x, y)


def test_union_of_cells(spark):
    rng = random.Random(2)
    cells = [(x, y) for x in range(8) for y in range(8) if rng.random() < 0.7]
    # Some squares run clockwise.
    squares = [[[(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)][:: rng.choice((1, -1))]] for x, y in cells]
    rows = shapes(spark, *squares).selectExpr("id", "polygon", "'all' AS key")
    (found,) = spatial.coverage_union(rows, "id", "polygon", ["key"]).collect()
    parts = [[[(p.x, p.y) for p in ring] for ring in polygon] for polygon in found.polygons]
    assert sum(area(p) for p in parts) == len(cells)
    left = set(cells)
    groups = 0
    while left:
        groups += 1
        todo = [left.pop()]
        while todo:
            x, y = todo.pop()
            for c in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if c in left:
                    left.remove(c)
                    todo.append(c)
    assert len(parts) == groups
    border = sum((x + dx, y + dy) not in cells for x, y in cells for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))
    assert sum(len(r) for p in parts for r in p) == border


def test_bounds_that_parts_share(spark):
    squares = [[[(0, 0), (1, 0), (1, 1), (0, 1)]], [[(2, 0), (3, 0), (3, 1), (2, 1)]]]
    rows = shapes(spark, *squares)
    whole = spark.createDataFrame([(i, 0.0, 0.0, 3.0, 1.0) for i in (0, 1)], "id long, x0 double, y0 double, x1 double, y1 double")
    found = spatial.split_grid(rows, "id", "polygon", 3, whole).collect()
    assert {(r.id, r.cell_x): round(r.area, 9) for r in found if r.cell_y == 0} == {(0, 0): round(1 / 3, 9), (1, 2): round(1 / 3, 9)}
    assert all(r.inside for r in found)


def test_no_shapes(spark):
    none = shapes(spark).selectExpr("id", "polygon", "'k' AS key")
    assert spatial.split_grid(none, "id", "polygon", 3).count() == 0
    assert spatial.coverage_union(none, "id", "polygon", ["key"]).count() == 0
