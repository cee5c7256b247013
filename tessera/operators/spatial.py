"""Points and polygons without a spatial index: a grid cell is the equi-join key, the exact test follows on its rows.

A polygon is a list of rings, a ring a list of (x, y), outer ring first; holes follow. Coordinates are plain numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import capitalize, slugify
from tessera.operators.rings import clipped, nested, outline


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(F.pow(x1 - x2, 2) + F.pow(y1 - y2, 2))


def bounds(polygon: Column) -> Column:
    """struct(x0, y0, x1, y1) of a polygon's outer ring."""
    ring = F.element_at(polygon, 1)
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def contains(polygon: Column, x: Column, y: Column) -> Column:
    """Ray casting over all rings: a hole takes away what it covers. Lower and left borders are inside, others outside."""

    def crossings(ring: Column) -> Column:
        following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
        edges = F.arrays_zip(ring.alias("a"), following.alias("b"))

        def crosses(e: Column) -> Column:
            a, b = e["a"], e["b"]
            at = (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]
            return ((a["y"] > y) != (b["y"] > y)) & (x < at)

        return F.size(F.filter(edges, crosses))

    return F.aggregate(F.transform(polygon, crossings), F.lit(0), lambda s, n: s + n) % 2 == 1


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def with_cells(polygons: DataFrame, polygon_col: str, size: float, margin: float = 0.0) -> DataFrame:
    """A row for each cell that a polygon's bounds (and margin) touch."""
    b = bounds(F.col(polygon_col))
    axis = lambda lo, hi: F.explode(F.sequence(_cell(lo - margin, size), _cell(hi + margin, size)))
    return polygons.withColumn("__b", b).withColumn("__cx", axis(F.col("__b.x0"), F.col("__b.x1"))).withColumn("__cy", axis(F.col("__b.y0"), F.col("__b.y1")))


def point_in_polygon_join(points: DataFrame, polygons: DataFrame, x: str, y: str, polygon_col: str, size: float, how: str = "inner") -> DataFrame:
    """Points with the polygons that contain them. how: "inner", or "left" to keep points outside all."""
    cells = with_cells(polygons, polygon_col, size)
    keyed = points.withColumn("__px", _cell(F.col(x), size)).withColumn("__py", _cell(F.col(y), size))
    px, py, b = F.col(x), F.col(y), F.col("__b")
    inside = (px >= b["x0"]) & (px <= b["x1"]) & (py >= b["y0"]) & (py <= b["y1"]) & contains(F.col(polygon_col), px, py)
    on = (F.col("__px") == F.col("__cx")) & (F.col("__py") == F.col("__cy")) & inside
    return keyed.join(cells, on, how).drop("__b", "__cx", "__cy", "__px", "__py")


def within_distance(left: DataFrame, right: DataFrame, limit: float, x: str = "x", y: str = "y") -> DataFrame:
    """Pairs of points at most `limit` apart; both sides have x and y. A right point goes to the nine cells around it."""
    near = F.explode(F.array(*[F.lit(d) for d in (-1, 0, 1)]))
    spread = right.select(*[F.col(c).alias(f"right_{c}") for c in right.columns]).withColumn("__dx", near).withColumn("__dy", near)
    spread = spread.withColumn("__cx", _cell(F.col(f"right_{x}"), limit) + F.col("__dx")).withColumn("__cy", _cell(F.col(f"right_{y}"), limit) + F.col("__dy"))
    keyed = left.withColumn("__px", _cell(F.col(x), limit)).withColumn("__py", _cell(F.col(y), limit))
    gap = distance(F.col(x), F.col(y), F.col(f"right_{x}"), F.col(f"right_{y}"))
    joined = keyed.join(spread, (F.col("__px") == F.col("__cx")) & (F.col("__py") == F.col("__cy")))
    return joined.withColumn("distance", gap).where(F.col("distance") <= limit).drop("__cx", "__cy", "__px", "__py", "__dx", "__dy")


def directed_edges(polygons: DataFrame, id_col: str, polygon_col: str) -> DataFrame:
    """(id, ax, ay, bx, by): each edge of each polygon with the inside on its left, whatever the direction of its rings."""
    rings = polygons.select(F.col(id_col).alias("id"), F.posexplode(polygon_col).alias("k", "ring"))
    edges = _edges(F.col("ring"))
    area = F.aggregate(edges, F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    turned = F.when((area > 0) == (F.col("k") == 0), edges).otherwise(F.transform(edges, lambda e: F.struct(e["b"].alias("a"), e["a"].alias("b"))))
    one = rings.select("id", F.explode(turned).alias("e")).select("id", *[F.col(f"e.{p}.{c}").alias(f"{p}{c}") for p in "ab" for c in "xy"])
    return one.where("ax <> bx OR ay <> by")


def grid_cells(edges: DataFrame, grids: DataFrame, n: int) -> DataFrame:
    """directed_edges() and grids (id, x0, y0, x1, y1: bounds) -> the n x n cells of each grid that its polygon touches: id, cell_x,
    cell_y, x0, y0, x1, y1, corner_in, edges (null in cells that lie inside whole).

    A cell's edges are those whose bounds touch it; no shape is copied to cells. Whether a cell's lower left corner is inside is
    the parity of the edges right of it on the line through it, which all cells of a row share.
    """
    at = lambda axis, k: F.col(f"g{axis}0") + (F.col(f"g{axis}1") - F.col(f"g{axis}0")) * k / float(n)
    grid = grids.select("id", *[F.col(c).alias(f"g{c}") for c in ("x0", "y0", "x1", "y1")])
    known = edges.join(grid, "id")
    # A first guess of the cells between two places, one wider on each side; lines' places, by one formula each time, decide.
    place = lambda axis, v: F.floor((v - F.col(f"g{axis}0")) / (F.col(f"g{axis}1") - F.col(f"g{axis}0")) * n).cast("int")
    low, high = (lambda axis: F.least(f"a{axis}", f"b{axis}")), (lambda axis: F.greatest(f"a{axis}", f"b{axis}"))
    first, last = (lambda axis: F.greatest(place(axis, low(axis)) - 1, F.lit(0))), (lambda axis: F.least(place(axis, high(axis)) + 1, F.lit(n - 1)))
    near = lambda axis: F.when(first(axis) <= last(axis), F.sequence(first(axis), last(axis)))
    touches = lambda axis: (at(axis, F.col(f"cell_{axis}")) <= high(axis)) & (at(axis, F.col(f"cell_{axis}") + 1) >= low(axis))
    edge = F.struct("ax", "ay", "bx", "by")
    of_cells = known.withColumn("cell_x", F.explode(near("x"))).withColumn("cell_y", F.explode(near("y"))).where(touches("x") & touches("y")).groupBy("id", "cell_x", "cell_y").agg(F.collect_list(edge).alias("edges"))
    crossing = known.withColumn("cell_y", F.explode(near("y"))).where((F.col("ay") > at("y", F.col("cell_y"))) != (F.col("by") > at("y", F.col("cell_y"))))
    crossing = crossing.select("id", "cell_y", ((F.col("bx") - F.col("ax")) * (at("y", F.col("cell_y")) - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax")).alias("cut"))
    rows = crossing.groupBy("id", "cell_y").agg(F.collect_list("cut").alias("cuts"))
    corners = rows.join(grid, "id").withColumn("cell_x", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    corners = corners.select("id", "cell_x", "cell_y", (F.size(F.filter("cuts", lambda c: c > at("x", F.col("cell_x")))) % 2 == 1).alias("corner_in")).where("corner_in")
    cells = of_cells.join(corners, ["id", "cell_x", "cell_y"], "full").join(grid, "id")
    box = [at("x", F.col("cell_x")).alias("x0"), at("y", F.col("cell_y")).alias("y0"), at("x", F.col("cell_x") + 1).alias("x1"), at("y", F.col("cell_y") + 1).alias("y1")]
    return cells.select("id", "cell_x", "cell_y", *box, F.coalesce("corner_in", F.lit(False)).alias("corner_in"), "edges")


def spread_edges(edges: DataFrame, size: float, x0: float = 0.0, y0: float = 0.0, margin: float = 0.0) -> DataFrame:
    """A row for each cell (cx, cy), counted from (x0, y0), that an edge's bounds and margin touch."""
    place = lambda v, origin: _cell(v - origin, size)
    along = lambda a, b, origin: F.explode(F.sequence(place(F.least(a, b) - margin, origin), place(F.greatest(a, b) + margin, origin)))
    return edges.withColumn("cx", along("ax", "bx", x0)).withColumn("cy", along("ay", "by", y0))


def covering(edges: DataFrame, size: float) -> DataFrame:
    """directed_edges() -> the cells of `size` that their polygons touch: id, cx, cy, corner_in (the lower left corner is inside), edges (null
    in cells that lie inside whole). A cell has the edges whose bounds touch it and nothing else of its polygon."""
    of_cells = spread_edges(edges, size).groupBy("id", "cx", "cy").agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("edges"))
    line = F.col("cy") * size
    lines = edges.withColumn("cy", F.explode(F.sequence(_cell(F.least("ay", "by"), size), _cell(F.greatest("ay", "by"), size) + 1))).where((F.col("ay") > line) != (F.col("by") > line))
    cuts = lines.groupBy("id", "cy").agg(F.sort_array(F.collect_list((F.col("bx") - F.col("ax")) * (line - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax"))).alias("cuts"))
    # From an odd cut to the next one a line is inside.
    stretch = F.transform(F.sequence(F.lit(0), F.size("cuts") - 2, F.lit(2)), lambda i: F.struct(F.get("cuts", i).alias("a"), F.get("cuts", i + 1).alias("b")))
    inside = cuts.select("id", "cy", F.inline(stretch)).withColumn("cx", F.explode(F.sequence(_cell(F.col("a"), size), _cell(F.col("b"), size))))
    corners = inside.where((F.col("cx") * size >= F.col("a")) & (F.col("cx") * size < F.col("b"))).select("id", "cx", "cy", F.lit(True).alias("corner_in"))
    return of_cells.join(corners, ["id", "cx", "cy"], "full").select("id", "cx", "cy", F.coalesce("corner_in", F.lit(False)).alias("corner_in"), "edges")


def located(points: DataFrame, cover: DataFrame, size: float, x: str, y: str) -> DataFrame:
    """points with the `id` of each polygon of a covering() of the same size that contains them, borders as in contains(). Points without
    position are in none.

    The way from a cell's corner goes up its left border, then right, and each edge on it changes sides; in cells without edges
    nothing is tested. A place on an edge counts as right of it, so on the way up an edge that rises is passed behind it, and one that falls at it.
    """
    px, py, x0, y0 = F.col(x), F.col(y), F.col("cx") * size, F.col("cy") * size

    def passed(e: Column) -> Column:
        ax, ay, bx, by = (e[c] for c in ("ax", "ay", "bx", "by"))
        cut = (by - ay) * (x0 - ax) / F.nullif(bx - ax, F.lit(0.0)) + ay
        at = (bx - ax) * (py - ay) / F.nullif(by - ay, F.lit(0.0)) + ax
        rises = (bx > ax) == (by > ay)
        upward = ((ax > x0) != (bx > x0)) & F.when(rises & (ay != by), (cut >= y0) & (cut < py)).otherwise((cut > y0) & (cut <= py))
        across = ((ay > py) != (by > py)) & (at > x0) & (at <= px)
        return F.coalesce(upward, F.lit(False)) != F.coalesce(across, F.lit(False))

    keyed = points.withColumn("cx", _cell(px, size)).withColumn("cy", _cell(py, size)).join(cover, ["cx", "cy"])
    odd = F.coalesce(F.size(F.filter("edges", passed)), F.lit(0)) % 2 == 1
    return keyed.where(F.col("corner_in") != F.when(F.col("edges").isNull(), False).otherwise(odd)).drop("cx", "cy", "corner_in", "edges")


def ring_area(ring: Column) -> Column:
    """Positive if the ring runs counter-clockwise."""
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + (e["a"]["x"] - ring[0]["x"]) * (e["b"]["y"] - ring[0]["y"]) - (e["b"]["x"] - ring[0]["x"]) * (e["a"]["y"] - ring[0]["y"])) / 2


def n_points(polygons: Column) -> Column:
    """Points of all rings, each with its first point at the end again."""
    return F.aggregate(F.flatten(polygons), F.lit(0), lambda s, ring: s + F.size(ring) + 1)


_PARTS = "array<array<array<struct<x: double, y: double>>>>"


def split_grid(polygons: DataFrame, id_col: str, polygon_col: str, n: int, whole: DataFrame | None = None) -> DataFrame:
    """The parts of each polygon in the n x n cells of its bounds, or of the bounds `whole` (id, x0, y0, x1, y1): id, cell_x, cell_y, x0, y0,
    x1, y1, inside (the cell lies in the polygon), parts (polygons), n_points, area.

    Cells that no edge touches are taken as they are. In the others the edges that touch them are cut at the cell's borders and
    closed along those stretches of them that are inside. Holes may be there; rings must not cross. Parts without area are left out.
    """
    grids = whole if whole is not None else polygons.select(F.col(id_col).alias("id"), bounds(F.col(polygon_col)).alias("b")).select("id", "b.*")
    cells = grid_cells(directed_edges(polygons, id_col, polygon_col), grids, n)
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    box = F.array(F.array(F.array(point("x0", "y0"), point("x1", "y0"), point("x1", "y1"), point("x0", "y1"))))

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for r in rows.itertuples():
                edges = [((e["ax"], e["ay"]), (e["bx"], e["by"])) for e in r.edges]
                found.append([[[{"x": x, "y": y} for x, y in ring] for ring in polygon] for polygon in nested(clipped((r.x0, r.y0, r.x1, r.y1), r.corner_in, edges))])
            yield rows.drop(columns=["edges", "corner_in"]).assign(parts=pd.Series(found, dtype=object, index=rows.index))

    kind = dict(cells.dtypes)["id"]
    cut = cells.where("edges IS NOT NULL").mapInPandas(parts, f"id {kind}, cell_x int, cell_y int, x0 double, y0 double, x1 double, y1 double, parts {_PARTS}").where(F.size("parts") > 0)
    plain = cells.where("edges IS NULL").select("id", "cell_x", "cell_y", "x0", "y0", "x1", "y1", box.alias("parts"))
    area = F.aggregate(F.flatten("parts"), F.lit(0.0), lambda s, ring: s + ring_area(ring))
    both = cut.unionByName(plain).withColumn("n_points", n_points(F.col("parts"))).withColumn("area", area)
    full = (F.col("n_points") == 5) & (F.abs(F.col("area") - (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))) <= 1e-12 * F.col("area"))
    return both.select("id", "cell_x", "cell_y", "x0", "y0", "x1", "y1", full.alias("inside"), "parts", "n_points", "area")


def coverage_union(polygons: DataFrame, id_col: str, polygon_col: str, by: list[str]) -> DataFrame:
    """The union of the polygons of each key in `by`: by, polygons. They must not overlap, and share corners where they share borders.

    An edge that two polygons of a key have, in opposite directions as the inside is on its left, lies within the union; one
    aggregation finds the edges that are left, and only those of a key's outline meet in one task.
    """
    keys = polygons.select(F.col(id_col).alias("id"), *by).distinct()
    edges = directed_edges(polygons, id_col, polygon_col).join(keys, "id")
    ahead = (F.col("ax") < F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") < F.col("by")))
    ends = [F.when(ahead, F.col(a)).otherwise(F.col(b)).alias(c) for a, b, c in (("ax", "bx", "ax"), ("ay", "by", "ay"), ("bx", "ax", "bx"), ("by", "ay", "by"))]
    left = edges.select(*by, *ends, F.when(ahead, 1).otherwise(-1).alias("way")).groupBy(*by, "ax", "ay", "bx", "by").agg(F.sum("way").alias("way")).where("way <> 0")

    def traced(group: pd.DataFrame) -> pd.DataFrame:
        edges = [((r.ax, r.ay), (r.bx, r.by)) if r.way > 0 else ((r.bx, r.by), (r.ax, r.ay)) for r in group.itertuples()]
        found = [[[{"x": x, "y": y} for x, y in ring] for ring in polygon] for polygon in nested(outline(edges))]
        return pd.DataFrame([(*(group[c].iloc[0] for c in by), found)], columns=[*by, "polygons"])

    kinds = dict(polygons.dtypes)
    return left.groupBy(*by).applyInPandas(traced, ", ".join([*(f"{c} {kinds[c]}" for c in by), f"polygons {_PARTS}"]))


def _edges(ring: Column) -> Column:
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.arrays_zip(ring.alias("a"), following.alias("b"))


def all_edges(polygon: Column) -> Column:
    return F.flatten(F.transform(polygon, _edges))


def interior_point(polygon: Column) -> Column:
    """A point inside a polygon of any shape: in the middle of the first stretch that it has on a line between its two lowest corners."""
    ys = F.array_sort(F.array_distinct(F.transform(F.flatten(polygon), lambda p: p["y"])))
    y = (ys[0] + F.get(ys, F.lit(1))) / 2
    crossed = F.filter(all_edges(polygon), lambda e: (e["a"]["y"] > y) != (e["b"]["y"] > y))
    xs = F.array_sort(F.transform(crossed, lambda e: (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]))
    return F.struct(((F.get(xs, F.lit(0)) + F.get(xs, F.lit(1))) / 2).alias("x"), y.alias("y"))


def _turn(a: Column, b: Column, c: Column) -> Column:
    return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))


def _on_edge(p: Column, e: Column) -> Column:
    a, b = e["a"], e["b"]
    between = lambda c: (p[c] >= F.least(a[c], b[c])) & (p[c] <= F.greatest(a[c], b[c]))
    return (_turn(a, b, p) == 0) & between("x") & between("y")


def contains_polygon(outer: Column, inner: Column) -> Column:
    """Whether a polygon lies in another, borders included: a point of it does, no two edges cross, no corner or middle of an edge is
    outside, and no hole of the outer one lies in it."""
    around, own = all_edges(outer), all_edges(inner)
    crossing = F.exists(own, lambda e: F.exists(around, lambda o: (
        (_turn(e["a"], e["b"], o["a"]) * _turn(e["a"], e["b"], o["b"]) < 0) & (_turn(o["a"], o["b"], e["a"]) * _turn(o["a"], o["b"], e["b"]) < 0)
    )))
    middle = lambda e: F.struct(((e["a"]["x"] + e["b"]["x"]) / 2).alias("x"), ((e["a"]["y"] + e["b"]["y"]) / 2).alias("y"))
    marks = F.concat(F.flatten(inner), F.transform(own, middle))
    outside = F.exists(marks, lambda p: ~contains(outer, p["x"], p["y"]) & ~F.exists(around, lambda e: _on_edge(p, e)))
    hole = lambda ring: interior_point(F.array(ring))
    filled = F.exists(F.slice(outer, 2, F.size(outer)), lambda ring: contains(inner, hole(ring)["x"], hole(ring)["y"]))
    inside = interior_point(inner)
    return contains(outer, inside["x"], inside["y"]) & ~crossing & ~outside & ~filled


def assign_hierarchy(areas: DataFrame, size: float) -> DataFrame:
    """Areas (osm_id, name, admin_level, polygon, or polygons: several parts) -> parent by containment: osm_id, depth, parent_id,
    parent_name, parent_path, is_leaf.

    An area's ancestors are those of a lower level of which each part of it lies in some part. The parent is the one of the
    greatest level, then of the smallest id; parent_path holds the ancestors' names, deepest first. A cell of a grid is the
    key by which a point inside an area meets those above it; polygons are compared only then.
    """
    parts = F.col("polygons") if "polygons" in areas.columns else F.array("polygon")
    shaped = areas.select("osm_id", "name", "admin_level", parts.alias("parts"))
    own = shaped.withColumn("__at", interior_point(F.col("parts")[0])).select("osm_id", "admin_level", "parts", F.col("__at.x").alias("x"), F.col("__at.y").alias("y"))
    above = shaped.select(F.col("osm_id").alias("up_id"), F.col("name").alias("up_name"), F.col("admin_level").alias("up_level"), F.col("parts").alias("up_parts"), F.explode("parts").alias("up_part"))
    pairs = point_in_polygon_join(own, above, "x", "y", "up_part", size).where("up_level < admin_level")
    lies_in = F.forall("parts", lambda inner: F.exists("up_parts", lambda outer: contains_polygon(outer, inner)))
    pairs = pairs.where(lies_in).select("osm_id", "up_id", "up_name", "up_level").distinct()
    chain = F.array_sort(F.collect_list(F.struct((-F.col("up_level")).alias("l"), F.col("up_id").alias("i"), F.col("up_name").alias("n"))))
    found = pairs.groupBy("osm_id").agg(F.count(F.lit(1)).alias("depth"), chain.alias("chain"))
    placed = areas.select("osm_id").join(found, "osm_id", "left").select(
        "osm_id", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.col("chain")[0]["i"].alias("parent_id"), F.col("chain")[0]["n"].alias("parent_name"),
        F.array_join(F.transform("chain", lambda c: c["n"]), ", ").alias("parent_path"),
    )
    parents = placed.select(F.col("parent_id").alias("p")).where("p IS NOT NULL").distinct()
    return placed.join(parents, placed.osm_id == parents.p, "left").withColumn("is_leaf", F.col("p").isNull()).drop("p")


def area_table(areas: DataFrame, size: float) -> DataFrame:
    """assign_hierarchy() with names: admin_type by level, full_name, slug, and the slugs of the municipality and region above."""
    kind = F.when(F.col("admin_level") == 8, "locality").when(F.col("admin_level") == 7, "municipality").otherwise("region")
    placed = assign_hierarchy(areas, size).join(areas.select("osm_id", "name", "admin_level"), "osm_id")
    named = placed.select(
        "osm_id", capitalize(F.col("name")).alias("name"), "admin_level", kind.alias("admin_type"), "depth", "parent_id", capitalize(F.col("parent_name")).alias("parent_name"), "is_leaf",
        capitalize(F.col("parent_path")).alias("parent_path"), capitalize(F.concat_ws(", ", "name", "parent_path")).alias("full_name"), slugify(F.col("name"), F.col("parent_path")).alias("slug"),
    )
    up = lambda n: named.select(F.col("osm_id").alias(f"__{n}"), F.col("slug").alias(f"__slug{n}"), F.col("parent_id").alias(f"__next{n}"))
    joined = named.join(up(1), F.col("parent_id") == F.col("__1"), "left").join(up(2), F.col("__next1") == F.col("__2"), "left")
    is_kind = lambda k: F.col("admin_type") == k
    city = F.when(is_kind("locality"), F.col("__slug1")).when(is_kind("municipality"), F.col("slug"))
    region = F.when(is_kind("locality"), F.col("__slug2")).when(is_kind("municipality"), F.col("__slug1")).otherwise(F.col("slug"))
    return joined.select(*named.columns, city.alias("municipality_slug"), region.alias("region_slug"))
