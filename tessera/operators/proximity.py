"""Distances between points and polygons, and searches by them that compare a point with edges close to it only.

Polygons are as in `spatial`. Shuffles hold edges and cells; no shape is copied to cells but for the test of what contains a point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.spatial import all_edges, contains, covering, directed_edges, located, spread_edges
from tessera.plans.store import written

#: Tables of cells are broadcast while they can't have more rows than this (five numbers each), else shuffled.
BROADCAST_CELLS = 200_000


def segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """From a point to the nearest place of an edge, whose ends may be one place."""
    dx, dy = bx - ax, by - ay
    along = F.coalesce(F.try_divide((x - ax) * dx + (y - ay) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return F.hypot(x - (ax + t * dx), y - (ay + t * dy))


def distance_to(polygon: Column, x: Column, y: Column) -> Column:
    """From a point to a polygon: 0 inside and on its borders, holes are outside; null if the point or the polygon is null or has no edge."""
    far = F.array_min(F.transform(all_edges(polygon), lambda e: segment_distance(x, y, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"])))
    return F.when(contains(polygon, x, y), 0.0).otherwise(far)


def _asked(points: DataFrame, point_id: str, x: str, y: str) -> DataFrame:
    """The points that have an id and a finite position, as __p, __x, __y."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = points.select(F.col(point_id).alias("__p"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    return rows.where(F.col("__p").isNotNull() & finite("__x") & finite("__y")).distinct()


def _inside(asked: DataFrame, edges: DataFrame, size: float) -> DataFrame:
    found = located(asked, covering(edges, size), size, "__x", "__y")
    return found.select("__p", F.col("id").alias("__area"), F.lit(0.0).alias("distance"))


def _gap() -> Column:
    return segment_distance(*[F.col(c) for c in ("__x", "__y", "ax", "ay", "bx", "by")])


def areas_within(points: DataFrame, polygons: DataFrame, point_id: str, area_id: str, limit: float, size: float, x: str = "x", y: str = "y", polygon_col: str = "polygon") -> DataFrame:
    """point_id, area_id, distance: all areas at most `limit` from each point, 0 from those that hold it.

    An edge goes to the cells (of `size`) that its bounds come within the limit of, a point to its own, so an area's distance is the least of
    some edges' in one partial aggregation. Points without id or finite position, and areas without edges, are in no pair; an id that repeats is one
    point with several places.
    """
    asked = _asked(points, point_id, x, y)
    edges = directed_edges(polygons, area_id, polygon_col)
    here = lambda c: F.floor(F.col(c) / size).cast("long")
    near = asked.withColumn("cx", here("__x")).withColumn("cy", here("__y")).join(spread_edges(edges, size, margin=limit), ["cx", "cy"])
    near = near.select("__p", F.col("id").alias("__area"), _gap().alias("distance")).where(F.col("distance") <= limit)
    pairs = near.unionByName(_inside(asked, edges, size)).groupBy("__p", "__area").agg(F.min("distance").alias("distance"))
    return pairs.select(F.col("__p").alias(point_id), F.col("__area").alias(area_id), "distance")


def nearest_areas(points: DataFrame, polygons: DataFrame, point_id: str, area_id: str, size: float, x: str = "x", y: str = "y", polygon_col: str = "polygon") -> DataFrame:
    """point_id, area_id, distance: the nearest area of each point, at any distance; ties go to the smaller id.

    Cells of `size` that edges touch are halved in number level by level up to a single one, and points come down from it: of the
    cells below those that a point still has, it keeps the ones whose nearest corner isn't further than some place that is
    known to lie on an edge. So a point meets a few cells a level, wherever it is, and the edges of the last ones only. Points without id or
    finite position have no row; without areas there are no rows. An id that repeats is one point with several places.
    """
    asked = _asked(points, point_id, x, y)
    edges = directed_edges(polygons, area_id, polygon_col)
    ends = {f"{f.__name__}_{c}": f(g(f"a{c}", f"b{c}")) for c in "xy" for f, g in ((F.min, F.least), (F.max, F.greatest))}
    box = edges.agg(*[v.alias(k) for k, v in ends.items()]).first()
    if box["min_x"] is None:
        return asked.join(edges, F.lit(False)).select(F.col("__p").alias(point_id), F.col("id").alias(area_id), F.col("__x").alias("distance"))
    x0, y0 = box["min_x"], box["min_y"]
    wide, high = box["max_x"] - x0, box["max_y"] - y0
    levels = 0
    while size * 2**levels <= max(wide, high):
        levels += 1

    in_cells = spread_edges(edges, size, x0, y0)
    # What is known of a cell: the place of one of its edges that is nearest to the middle.
    mx, my = x0 + (F.col("cx") + 0.5) * size, y0 + (F.col("cy") + 0.5) * size
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((mx - F.col("ax")) * dx + (my - F.col("ay")) * dy) / (dx * dx + dy * dy)))
    place = F.struct((F.col("ax") + t * dx).alias("wx"), (F.col("ay") + t * dy).alias("wy"))
    touched = written(in_cells.groupBy("cx", "cy").agg(F.min(place).alias("w")).select("cx", "cy", "w.wx", "w.wy"), "cells")
    known = touched.count()

    # Places of doubles are off by less than this.
    slack = 1e-9 * (size + wide + high + abs(x0) + abs(y0))
    mine = W.partitionBy("__p", "__x", "__y")
    left = asked.withColumn("cx", F.lit(0).cast("long")).withColumn("cy", F.lit(0).cast("long"))
    for level in reversed(range(levels)):
        step = size * 2**level
        up = lambda c, level=level: F.shiftright(c, level).alias(c)
        cells = touched if level == 0 else touched.groupBy(up("cx"), up("cy")).agg(F.min(F.struct("wx", "wy")).alias("w")).select("cx", "cy", "w.wx", "w.wy")
        if min(known, (wide // step + 1) * (high // step + 1)) <= BROADCAST_CELLS:
            cells = F.broadcast(cells)
        below = F.array(*[F.struct((2 * F.col("cx") + i).alias("cx"), (2 * F.col("cy") + j).alias("cy")) for i in (0, 1) for j in (0, 1)])
        left = left.select("__p", "__x", "__y", F.inline(below)).join(cells, ["cx", "cy"])
        beyond = lambda v, c, origin, step=step: F.greatest(origin + F.col(c) * step - F.col(v), F.col(v) - (origin + (F.col(c) + 1) * step), F.lit(0.0))
        left = left.withColumn("least", F.hypot(beyond("__x", "cx", x0), beyond("__y", "cy", y0)))
        left = left.withColumn("best", F.min(F.hypot(F.col("__x") - F.col("wx"), F.col("__y") - F.col("wy"))).over(mine))
        left = left.where(F.col("least") <= F.col("best") + slack + 1e-9 * F.col("best")).select("__p", "__x", "__y", "cx", "cy")
    met = left.join(in_cells, ["cx", "cy"]).select("__p", F.col("id").alias("__area"), _gap().alias("distance"))
    found = met.unionByName(_inside(asked, edges, size)).groupBy("__p").agg(F.min(F.struct("distance", "__area")).alias("n"))
    return found.select(F.col("__p").alias(point_id), F.col("n.__area").alias(area_id), "n.distance")
