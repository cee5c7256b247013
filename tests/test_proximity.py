"""Searches by distance to polygons and by edits of names, against brute force."""

import itertools
import math
import random

from pyspark.sql import functions as F

from tessera.operators import names, proximity, spatial

SHAPE = "id long, polygon array<array<struct<x: double, y: double>>>"
POINT = "p long, x double, y double"


def shapes(spark, polygons):
    return spark.createDataFrame([(i, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in p]) for i, p in polygons.items()], SHAPE)


def star(rng, cx, cy, low, high, n):
    radii = [rng.uniform(low, high) for _ in range(n)]
    return [(cx + r * math.cos(2 * math.pi * k / n), cy + r * math.sin(2 * math.pi * k / n)) for k, r in enumerate(radii)]


def exact(polygon, x, y):
    """Distance by brute force: 0 inside."""
    odd, best = False, math.inf
    for ring in polygon:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
            square = (bx - ax) ** 2 + (by - ay) ** 2
            t = max(0, min(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / square)) if square else 0
            best = min(best, math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
    return 0.0 if odd else best


def world(seed):
    rng = random.Random(seed)
    polygons = {i: [star(rng, rng.uniform(-20, 20), rng.uniform(-20, 20), 0.2, 2, rng.randint(3, 30))] for i in range(40)}
    polygons[40] = [star(rng, 0, 0, 6, 9, 40), star(rng, 0, 0, 2, 4, 20)[::-1]]
    polygons[41] = [[(100, 100), (130, 101), (100, 102)]]  # far from all others, and thin
    points = [(k, rng.uniform(-25, 25), rng.uniform(-25, 25)) for k in range(150)]
    return polygons, points + [(150, 0.0, 0.0), (151, 500.0, -300.0), (152, -1e4, 1e4), (153, 130.0, 101.0)]


def test_nearest(spark):
    for seed, size in ((1, 0.5), (2, 3.0), (3, 400.0)):
        polygons, points = world(seed)
        found = {r.p: (r.id, r.distance) for r in proximity.nearest_areas(spark.createDataFrame(points, POINT), shapes(spark, polygons), "p", "id", size).collect()}
        for k, x, y in points:
            all_of = {i: exact(p, x, y) for i, p in polygons.items()}
            assert math.isclose(found[k][1], min(all_of.values()), rel_tol=1e-9, abs_tol=1e-12)
            assert math.isclose(all_of[found[k][0]], found[k][1], rel_tol=1e-9, abs_tol=1e-12)
        assert len(found) == len(points)


def test_nearest_with_shuffled_cells(spark, monkeypatch):
    polygons, points = world(5)
    given = spark.createDataFrame(points, POINT), shapes(spark, polygons), "p", "id", 0.7
    one = proximity.nearest_areas(*given).collect()
    monkeypatch.setattr(proximity, "BROADCAST_CELLS", 0)
    assert sorted(proximity.nearest_areas(*given).collect()) == sorted(one)


def test_within(spark):
    polygons, points = world(4)
    for limit, size in ((1.5, 1.0), (0.0, 5.0)):
        found = proximity.areas_within(spark.createDataFrame(points, POINT), shapes(spark, polygons), "p", "id", limit, size).collect()
        want = {(k, i): d for k, x, y in points for i, p in polygons.items() if (d := exact(p, x, y)) <= limit}
        assert {(r.p, r.id) for r in found} == set(want) and len(found) == len(want)
        assert all(math.isclose(r.distance, want[r.p, r.id], rel_tol=1e-9, abs_tol=1e-12) for r in found)


def test_odd_points_and_ties(spark):
    square = lambda x: [[(x, 0), (x + 1, 0), (x + 1, 1), (x, 1)]]
    areas = shapes(spark, {7: square(0), 3: square(3), 9: square(0), 5: [[(2, 2)]]}).withColumn("p", F.lit("extra")).withColumn("x", F.lit("extra"))
    nan = float("nan")
    points = spark.createDataFrame([(1, 2.0, 0.5), (2, None, 0.5), (3, 0.5, None), (None, 0.5, 0.5), (4, nan, 0.0), (5, math.inf, 0.0), (6, 0.5, 0.5), (6, 0.5, 0.5), (8, 9.0, 9.0), (8, 1.25, 0.5)], POINT)
    points = points.withColumn("id", F.lit("extra"))
    found = proximity.nearest_areas(points, areas, "p", "id", 0.5)
    assert sorted(map(tuple, found.collect())) == [(1, 3, 1.0), (6, 7, 0.0), (8, 7, 0.25)]
    near = proximity.areas_within(points, areas, "p", "id", 1.0, 0.5)
    assert sorted(map(tuple, near.collect())) == [(1, 3, 1.0), (1, 7, 1.0), (1, 9, 1.0), (6, 7, 0.0), (6, 9, 0.0), (8, 7, 0.25), (8, 9, 0.25)]
    for none in (proximity.nearest_areas(points, areas.where("id < 0"), "p", "id", 0.5), proximity.nearest_areas(points.where("p < 0"), areas, "p", "id", 0.5), proximity.areas_within(points, areas.where("id < 0"), "p", "id", 1.0, 0.5)):
        assert none.count() == 0 and none.columns == ["p", "id", "distance"]


def test_located(spark):
    polygons, points = world(7)
    points = points[:-1]  # a corner, which has no distance but isn't inside
    for size in (0.3, 5.0, 1000.0):
        cover = spatial.covering(spatial.directed_edges(shapes(spark, polygons), "id", "polygon"), size)
        rows = spatial.located(spark.createDataFrame(points, POINT), cover, size, "x", "y").collect()
        assert {(r.p, r.id) for r in rows} == {(k, i) for k, x, y in points for i, p in polygons.items() if exact(p, x, y) == 0} and len(rows) == len({(r.p, r.id) for r in rows})


def test_located_on_borders(spark):
    """Corners, edges and points on the lines of the grid: the same side as contains()."""
    polygons = {
        0: [[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (1, 3), (3, 3), (3, 1)]],
        1: [[(0, 2), (2, 0), (4, 2), (2, 4)]],
        2: [[(0, 0), (4, 4), (0, 4)]],
        3: [[(4, 0), (4, 4), (0, 0)]],
        4: [[(-2, -1), (1, -2), (2, 1), (1, 3), (1, 1), (-1, 1), (-1, 3), (-2, 2)]],
    }
    points = [(k, x / 2, y / 2) for k, (x, y) in enumerate(itertools.product(range(-6, 11), repeat=2))] + [(999, None, 1.0)]
    rows, areas = spark.createDataFrame(points, POINT), shapes(spark, polygons)
    want = {(r.p, r.id) for r in rows.crossJoin(F.broadcast(areas)).where(spatial.contains(F.col("polygon"), F.col("x"), F.col("y"))).collect()}
    for size in (0.5, 1.0, 2.0, 16.0):
        cover = spatial.covering(spatial.directed_edges(areas, "id", "polygon"), size)
        assert {(r.p, r.id) for r in spatial.located(rows, cover, size, "x", "y").collect()} == want


def test_distance_column(spark):
    polygons, points = world(6)
    both = spark.createDataFrame(points, POINT).crossJoin(F.broadcast(shapes(spark, polygons)))
    for r in both.withColumn("d", proximity.distance_to(F.col("polygon"), F.col("x"), F.col("y"))).collect():
        assert math.isclose(r.d, exact(polygons[r.id], r.x, r.y), rel_tol=1e-9, abs_tol=1e-12)
    assert spark.sql("SELECT CAST(NULL AS array<array<struct<x: double, y: double>>>) AS g").select(proximity.distance_to(F.col("g"), F.lit(0.0), F.lit(0.0))).first()[0] is None


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_close_names(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abç") for _ in range(rng.randint(0, 5))) for _ in range(120)]
    left = [(rng.choice("kl"), w) for w in words[:70]] + [("k", None), (None, "ab"), ("k", "ab"), ("k", "ab")]
    right = [(rng.choice("kl"), w) for w in words[50:]] + [("k", None), (None, "ab"), ("l", "")]
    rows = [spark.createDataFrame(r, "key string, name string").withColumn("other", F.lit("extra")) for r in (left, right)]
    for limit in (0, 1, 2):
        found = names.close_names(*rows, "name", ["key"], limit).collect()
        want = {(k, a, b, edits(a, b)) for (k, a), (m, b) in itertools.product(left, right) if k and k == m and a is not None and b is not None and edits(a, b) <= limit}
        assert len(found) == len(want) and set(map(tuple, found)) == want
    assert names.close_names(rows[0].where("key = 'z'"), rows[1], "name").count() == 0


def test_close_names_broadcast_nothing(spark, tmp_path):
    spark.createDataFrame([("k", "ab"), ("k", "ac")], "key string, name string").write.parquet(str(tmp_path / "names"))
    rows = spark.read.parquet(str(tmp_path / "names"))
    found = names.close_names(rows, rows, "name", ["key"])
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.where("name < other").collect())) == [("k", "ab", "ac", 1)]
