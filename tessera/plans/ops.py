"""One query for each operator, over whole tables, with the SQL that it must agree with."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import similarity, text
from tessera.operators import analytics, names, postcodes, proximity, relational, spatial
from tessera.plans import checks, marts
from tessera.plans.domain import AS_OF, DOMAIN_SQL, licences, table
from tessera.plans.store import shared_dir, stored
from tessera.sources import files, osm


def latest_event(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return relational.latest_by(rows, ["user_id"], "ts", ["event_id"]).drop("ts")


def first_order(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice")
    return relational.distinct_on(rows, ["o_custkey"], [F.col("o_orderpriority"), F.col("o_totalprice").desc(), F.col("o_orderkey")])


def nearest_supplier(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    left = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("nation")).select("c_custkey", "c_acctbal", "nation", "region", (F.col("region") % 2).alias("half"))
    right = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("nation")).select("s_suppkey", "s_acctbal", "nation", "region", (F.col("region") % 2).alias("half"))
    tiers = [("nation", ["nation"]), ("region", ["region"]), ("half", ["half"])]
    return relational.nearest_within(left, right, "c_custkey", "s_suppkey", "c_acctbal", "s_acctbal", tiers).withColumn("distance", F.round("distance", 4))


def shared_positions(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.lpad(k.cast("string"), 9, "0")).alias("code"), (k % 97).alias("x"), (k * k % 89).alias("y"))
    return relational.shared_position(rows, "code", "x", "y")


def not_in_with_null(spark, sf_dir):
    other = table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") != 3, F.col("n_nationkey")).alias("k"))
    return relational.not_in_null_aware(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", other, "k")


def not_in_without_null(spark, sf_dir):
    other = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("k"))
    return relational.not_in_null_aware(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", other, "k")


def parts_never_sold_cheap(spark, sf_dir):
    """Correlated NOT EXISTS and EXISTS, as anti and semi joins."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_discount")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    out = part.join(line.where("l_quantity < 2").select("l_partkey"), part.p_partkey == F.col("l_partkey"), "left_anti")
    return out.join(line.where("l_discount > 0.05").select("l_partkey"), out.p_partkey == F.col("l_partkey"), "left_semi")


def null_safe_match(spark, sf_dir):
    side = lambda name, which: licences(spark, sf_dir).where(which).groupBy("is_building_post_1951", "house_type").agg(F.count(F.lit(1)).alias(name))
    lost, kept = side("lost", F.col("lost_in_year_month").isNotNull()), side("kept", F.col("lost_in_year_month").isNull())
    out = relational.equal_or_both_missing(kept, lost, ["is_building_post_1951", "house_type"], "left")
    return out.withColumn("is_building_post_1951", F.coalesce(F.col("is_building_post_1951").cast("string"), F.lit("unknown")))


def area_paths(spark, sf_dir):
    """Ordered text aggregate: the names above each area, deepest first."""
    a = marts.known(spark, sf_dir)
    up = analytics.ancestors(a, 2, None).where("depth > 0").join(a.select(F.col("osm_id").alias("area_id"), "name", "admin_level"), "area_id")
    return relational.ordered_text(up, ["group_id"], "name", "admin_level")


def capitalized(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit("-"), "p_brand").alias("raw"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 50 == 0, F.lit("77-8")).otherwise(F.col("o_orderpriority")).alias("raw"))
    return part.unionByName(orders).select("id", "raw", text.capitalize(F.col("raw")).alias("name"))


def slugs(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return rows.select("p_partkey", text.slugify(F.concat(F.lit("Ção "), "p_name"), F.concat_ws(", ", "p_brand", "p_type")).alias("slug"), text.fold(F.concat(F.lit("ÉÃ"), "p_name")).alias("folded"))


_K = "c_custkey"
_RAW_CODE = """CASE c_custkey % 13 WHEN 0 THEN NULL WHEN 1 THEN ' 1234-567 ' WHEN 2 THEN '1234-56' WHEN 3 THEN '1234' WHEN 4 THEN '123' WHEN 5 THEN '123-456' WHEN 6 THEN '12-345'
  WHEN 7 THEN '1-234' WHEN 8 THEN '12345' WHEN 9 THEN '1234-567, LISBOA' WHEN 10 THEN 'ABC' WHEN 11 THEN '12 34' ELSE '1234-5678' END"""


def postcodes_normalised(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_RAW_CODE).alias("raw"))
    code = text.normalize_postcode(F.col("raw"))
    return rows.select("c_custkey", code.alias("postcode"), text.postcode_number(code).alias("number"))


def name_similarity(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_name", F.lower("p_type").alias("other")).distinct()
    a, b = F.col("p_name"), F.col("other")
    return rows.select(
        "p_name", "other", similarity.levenshtein(a, b).alias("levenshtein"), similarity.damerau_levenshtein(a, b).alias("damerau"),
        F.round(similarity.jaro(a, b), 6).alias("jaro"), F.round(similarity.jaro_winkler(a, b), 6).alias("jaro_winkler"), F.round(similarity.jaccard(a, b), 6).alias("jaccard"),
    )


def _square(x0, y0, x1, y1):
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def nation_shapes(spark, sf_dir):
    """Each nation a square of a 5 x 5 grid, with a hole in its middle."""
    n = F.col("n_nationkey")
    x, y = (n % 5).cast("double"), F.floor(n / 5).cast("double")
    hole = _square(x + 0.4, y + 0.4, x + 0.6, y + 0.6)
    return table(spark, sf_dir, "nation").select(n.alias("area_id"), "n_name", F.array(_square(x, y, x + 1, y + 1), hole).alias("polygon"))


def _order_points(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 613 / 120.0).alias("x"), (F.col("o_custkey") % 617 / 120.0).alias("y"))


def orders_in_nations(spark, sf_dir):
    joined = spatial.point_in_polygon_join(_order_points(spark, sf_dir), nation_shapes(spark, sf_dir), "x", "y", "polygon", 0.5, "left")
    return joined.groupBy("area_id").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))


def close_suppliers(spark, sf_dir):
    at = lambda name: table(spark, sf_dir, name)
    left = at("supplier").select("s_suppkey", (F.col("s_suppkey") % 41 / 8.0).alias("x"), (F.col("s_suppkey") % 37 / 8.0).alias("y"))
    right = at("nation").select("n_nationkey", (F.col("n_nationkey") % 5 + 0.5).alias("x"), (F.floor(F.col("n_nationkey") / 5) + 0.5).alias("y"))
    return spatial.within_distance(left, right, 0.5).select("s_suppkey", F.col("right_n_nationkey").alias("n_nationkey"), F.round("distance", 6).alias("distance"))


#: Corners of the shapes in a nation's square: (first id, name, level, corners). The bridge spans the ring's gap.
_RING = ((0.1, 0.1), (0.9, 0.1), (0.9, 0.9), (0.7, 0.9), (0.7, 0.3), (0.3, 0.3), (0.3, 0.9), (0.1, 0.9))
_INNER = ((0.15, 0.15), (0.85, 0.15), (0.85, 0.85), (0.75, 0.85), (0.75, 0.25), (0.25, 0.25), (0.25, 0.85), (0.15, 0.85))
_GAP = ((0.35, 0.35), (0.65, 0.35), (0.65, 0.85), (0.35, 0.85))
_BRIDGE = ((0.15, 0.8), (0.85, 0.8), (0.85, 0.88), (0.15, 0.88))
_SHAPES_OF = ((100, "Ring", 7, _RING), (200, "Gap", 7, _GAP), (300, "Inner", 8, _INNER), (400, "Bridge", 8, _BRIDGE))
_LAND = ((-1.0, -1.0), (6.0, -1.0), (6.0, 6.0), (-1.0, 6.0))
_COLUMN = ((0.02, -0.5), (0.98, -0.5), (0.98, 5.5), (0.02, 5.5))


def area_shapes(spark, sf_dir):
    """A country, columns of the nations' grid as regions, and in each nation's square a ring with a ring in it, an area in its gap,
    and one that reaches over the gap."""
    n = F.col("n_nationkey")
    corner = lambda x, y, c: F.struct((x + c[0]).alias("x"), (y + c[1]).alias("y"))
    shape = lambda i, name, level, x, y, corners: F.struct(i.cast("long").alias("osm_id"), name.alias("name"), F.lit(level).alias("admin_level"), F.array(F.array(*[corner(x, y, c) for c in corners])).alias("polygon"))
    number = lambda c: c.cast("string")
    own = [shape(first + n, F.concat(F.lit(f"{name} "), number(n)), level, (n % 5).cast("double"), F.floor(n / 5).cast("double"), corners) for first, name, level, corners in _SHAPES_OF]
    zero = F.lit(0.0)
    columns = [shape(F.lit(9001 + c), F.lit(f"Column {c}"), 4, F.lit(float(c)), zero, _COLUMN) for c in range(5)]
    nations = table(spark, sf_dir, "nation").select(F.inline(F.array(*own)))
    return nations.unionByName(spark.range(1).select(F.inline(F.array(shape(F.lit(9000), F.lit("Land"), 2, zero, zero, _LAND), *columns))))


def hierarchy(spark, sf_dir):
    """Parents by containment, with names and slugs."""
    return spatial.area_table(area_shapes(spark, sf_dir), 1.0)


def nation_grid(spark, sf_dir):
    shapes = nation_shapes(spark, sf_dir).select("area_id", F.slice("polygon", 1, 1).alias("polygon"))
    return spatial.split_grid(shapes, "area_id", "polygon", 4).select("id", "cell_x", "cell_y", F.round("x0", 6).alias("x0"), F.round("y1", 6).alias("y1"), "inside")


def nation_parts(spark, sf_dir):
    """Squares with holes, cut by a grid whose lines run through the holes."""
    found = spatial.split_grid(nation_shapes(spark, sf_dir), "area_id", "polygon", 4)
    return found.select("id", "cell_x", "cell_y", "inside", F.size("parts").alias("parts"), "n_points", F.round("area", 6).alias("area"))


def shape_parts(spark, sf_dir):
    """Concave and thin shapes on a grid of seven."""
    found = spatial.split_grid(area_shapes(spark, sf_dir).where("osm_id < 1000"), "osm_id", "polygon", 7)
    return found.select("id", "cell_x", "cell_y", F.round("area", 6).alias("area"))


def _regions(spark, sf_dir):
    """The nations' squares, without holes, by region: regions are in many pieces and have holes."""
    n = F.col("n_nationkey")
    x, y = (n % 5).cast("double"), F.floor(n / 5).cast("double")
    return table(spark, sf_dir, "nation").select(n.alias("area_id"), F.col("n_regionkey").cast("long").alias("region"), F.array(_square(x, y, x + 1, y + 1)).alias("polygon"))


def region_outlines(spark, sf_dir):
    """Unions by region: borders that nations share are gone."""
    union = spatial.coverage_union(_regions(spark, sf_dir), "area_id", "polygon", ["region"])
    rings = F.flatten("polygons")
    return union.select("region", (spatial.n_points(F.col("polygons")) - F.size(rings)).cast("long").alias("edges"), F.round(F.aggregate(rings, F.lit(0.0), lambda s, r: s + spatial.ring_area(r)), 6).alias("area"))


def region_grid(spark, sf_dir):
    """Regions' unions on one grid of six by six over all of them."""
    union = spatial.coverage_union(_regions(spark, sf_dir), "area_id", "polygon", ["region"])
    pieces = union.select("region", F.explode("polygons").alias("polygon")).withColumn("id", F.col("region"))
    box = pieces.select(spatial.bounds(F.col("polygon")).alias("b")).agg(F.min("b.x0").alias("x0"), F.min("b.y0").alias("y0"), F.max("b.x1").alias("x1"), F.max("b.y1").alias("y1"))
    whole = union.select(F.col("region").alias("id")).join(F.broadcast(box), F.lit(True))
    return spatial.split_grid(pieces, "id", "polygon", 6, whole).groupBy("id", "cell_x", "cell_y").agg(F.round(F.sum("area"), 6).alias("area"))


#: Corners of a nation's ways, and the ways: a square in two, a spur, a triangle that touches it, and a bridge to a square of its own.
_RING_NODES = ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (1.3, 1.2), (1.25, 1.0), (1.0, 1.25), (0.4, 0.4), (0.6, 0.4), (0.6, 0.6), (0.4, 0.6))
_RING_WAYS = ((0, 1, 2), (2, 4), (0, 3, 2), (2, 5), (6, 5), (2, 6), (7, 8, 9, 10, 7), (0, 7))


def nation_spurs(spark, sf_dir):
    """Rings from ways that dangle, touch and bridge: ring, corners and area."""
    n = F.col("n_nationkey")
    nation = table(spark, sf_dir, "nation").select(n.cast("long").alias("n"), (n % 5).cast("double").alias("x"), F.floor(n / 5).cast("double").alias("y"))
    node = lambda k: F.col("n") * 20 + k
    nodes = nation.select(F.inline(F.array(*[F.struct(node(k).alias("id"), (F.col("x") + a).alias("x"), (F.col("y") + b).alias("y")) for k, (a, b) in enumerate(_RING_NODES)])))
    ways = nation.select(F.inline(F.array(*[F.struct(node(k).alias("id"), F.array(*[node(i) for i in path]).alias("nodes")) for k, path in enumerate(_RING_WAYS)])))
    members = ways.select(F.floor(F.col("id") / 20).cast("long").alias("relation"), F.col("id").alias("way"), F.lit("outer").alias("role"))
    rings = osm.assemble_rings(members, ways, nodes)
    return rings.select("relation", "ring", F.size("points").alias("corners"), F.round(spatial.ring_area(F.col("points")), 6).alias("area"))


def similar_customers(spark, sf_dir):
    """Customers of one nation whose names are one letter apart."""
    customer = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_name").alias("name"))
    return names.close_names(customer, customer, "name", ["c_nationkey"]).where("name < other")


def _customer_points(spark, sf_dir):
    """Customers all over the nations' grid and around it."""
    k = F.col("c_custkey").cast("double")
    return table(spark, sf_dir, "customer").select("c_custkey", (k * 0.6180339 % 7.0 - 1.0).alias("x"), (k * 0.7548776 % 9.0 - 2.0).alias("y"))


def nearest_area(spark, sf_dir):
    """The nearest concave shape of each customer, itself if the customer is in it."""
    shapes = area_shapes(spark, sf_dir).where("osm_id < 1000")
    found = proximity.nearest_areas(_customer_points(spark, sf_dir), shapes, "c_custkey", "osm_id", 0.25)
    return found.withColumn("distance", F.round("distance", 6))


def customers_in_shapes(spark, sf_dir):
    """Customers with the concave shapes that they lie in; shapes lie in and over each other."""
    edges = spatial.directed_edges(area_shapes(spark, sf_dir), "osm_id", "polygon")
    return spatial.located(_customer_points(spark, sf_dir), spatial.covering(edges, 0.25), 0.25, "x", "y").select("c_custkey", F.col("id").alias("osm_id"))


def close_areas(spark, sf_dir):
    """All nations within 0.3 of each customer; nations have holes, which are outside."""
    found = proximity.areas_within(_customer_points(spark, sf_dir), nation_shapes(spark, sf_dir), "c_custkey", "area_id", 0.3, 0.5)
    return found.withColumn("distance", F.round("distance", 6))


def lost_users(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return analytics.lost_licences(rows, "user_id", "day")


def lost_users_exact(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return analytics.lost_licences(rows, "user_id", "day", exact=True)


def month_windows(spark, sf_dir):
    """The months that orders span, as windows to fetch, with their orders."""
    out = files.month_windows_of(table(spark, sf_dir, "orders"), "o_orderdate")
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("window_start", "window_end")})


def _members(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    k = F.col("p_partkey")
    role = F.element_at(F.array(*[F.lit(r) for r in ("outer", "inner", "", "subarea")]), (F.col("p_size") % 4 + 1).cast("int"))
    own = F.floor(k / 10).cast("long")
    ways = part.select(own.alias("relation"), F.lit("w").alias("kind"), k.alias("ref"), role.alias("role"))
    # Each relation holds the one of a third of its number: they grow in number with the parts, and in depth with its logarithm.
    links = part.groupBy(own.alias("relation")).agg(F.max("p_size").alias("p_size"))
    return ways.unionByName(links.select("relation", F.lit("r").alias("kind"), F.floor(F.col("relation") / 3).cast("long").alias("ref"), role.alias("role")))


def relation_ways(spark, sf_dir):
    return files.resolve_relations(_members(spark, sf_dir))


def first_large_order(spark, sf_dir):
    """The one order that comes first by price, then number."""
    return relational.first_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")])


def rich_or_near(spark, sf_dir):
    """IN (subquery) OR a condition."""
    near = table(spark, sf_dir, "nation").where("n_regionkey = 1")
    return relational.in_or(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_nationkey", near, "n_nationkey", F.col("c_acctbal") > 9000)


def segments_twice(spark, sf_dir):
    """Distinct in each branch, then all of both."""
    kind = lambda name, column: table(spark, sf_dir, name).select(F.col(column).alias("value"))
    return relational.union_of_distinct(kind("customer", "c_mktsegment"), kind("customer", "c_mktsegment"), kind("orders", "o_orderpriority"))


def seed_events(spark, sf_dir):
    """A seed as files: written as gzip CSV with quoted commas and quotes, read back by glob under a declared schema."""
    path = f"{shared_dir(spark).rstrip('/')}/seed-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").alias("event_date"), F.when(F.col("event_type") == "purchase", F.concat(F.lit("#"), "event_type")).otherwise(F.col("event_type")).alias("event_name"))
    files.write_csv(rows.distinct().withColumn("description", F.concat(F.col("event_name"), F.lit(', "seen", on the day'))), path, "gzip")
    read = files.read_csv(spark, f"{path}/*.csv.gz", "event_date date, event_name string, description string")
    return reports_timeline(read).withColumn("event_date", F.date_format("event_date", "yyyy-MM-dd"))


def reports_timeline(events):
    """Events to show, in order: those whose name doesn't begin with #."""
    return events.where(~F.col("event_name").like("#%")).orderBy("event_date", "event_name")


def nation_rings(spark, sf_dir):
    """Areas of nations from relations: a square's two ways, one of them against the ring's direction, and a hole's way."""
    n = F.col("n_nationkey")
    nation = table(spark, sf_dir, "nation").select(n.cast("long").alias("n"), (n % 5).cast("double").alias("x"), F.floor(n / 5).cast("double").alias("y"))
    corners = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.4, 0.4), (0.6, 0.4), (0.6, 0.6), (0.4, 0.6)]
    node = lambda k: F.col("n") * 10 + k
    nodes = nation.select(F.inline(F.array(*[F.struct(node(k).alias("id"), (F.col("x") + a).alias("x"), (F.col("y") + b).alias("y")) for k, (a, b) in enumerate(corners)])))
    paths = [("outer", (0, 1, 2)), ("outer", (0, 3, 2)), ("inner", (4, 5, 6, 7, 4))]
    ways = nation.select(F.inline(F.array(*[F.struct((F.col("n") * 3 + k).alias("id"), F.array(*[node(i) for i in path]).alias("nodes")) for k, (_, path) in enumerate(paths)])))
    members = nation.select(F.inline(F.array(*[F.struct(F.col("n").alias("relation"), (F.col("n") * 3 + k).alias("way"), F.lit(role).alias("role")) for k, (role, _) in enumerate(paths)])))
    tagged = nation.select(F.col("n").alias("id"), F.create_map(F.lit("admin_level"), F.when(F.col("n") % 7 == 0, "x7").otherwise((F.col("n") % 10).cast("string"))).alias("tags"))
    kept = osm.admin_relations(tagged)
    shapes = osm.multipolygons(osm.assemble_rings(members.join(kept.select(F.col("id").alias("relation")), "relation", "left_semi"), ways, nodes))
    box = spatial.bounds(F.col("polygons")[0])
    return shapes.join(kept.select(F.col("id").alias("relation"), "admin_level"), "relation").select(
        "relation", "admin_level", F.size("polygons").alias("parts"), (F.size(F.col("polygons")[0]) - 1).alias("holes"), box["x0"].alias("x0"), box["y1"].alias("y1"),
        spatial.contains(F.col("polygons")[0], box["x0"] + 0.5, box["y0"] + 0.5).alias("middle_is_in"), spatial.contains(F.col("polygons")[0], box["x0"] + 0.2, box["y0"] + 0.2).alias("rim_is_in"),
    )


def page_titles(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", files.html_field(html, "(?s)<title>(.*?)</title>").alias("title"), files.html_field(html, "(?s)<h1>(.*?)</h1>").alias("heading"))


def nation_features(spark, sf_dir):
    return files.features(nation_shapes(spark, sf_dir), "polygon")


def nation_collections(spark, sf_dir):
    shapes = nation_shapes(spark, sf_dir).withColumn("row", F.floor(F.col("area_id") / 5))
    return files.feature_collection(shapes, "polygon", ["row"])


def _codes(spark, sf_dir):
    """Bulk codes, looked-up codes and codes in use, from keys."""
    code = lambda k: F.concat(F.lpad((1000 + k * 37 % 400).cast("string"), 4, "0"), F.lit("-"), F.lpad((k * 17 % 1000).cast("string"), 3, "0"))
    place = lambda k: [(k % 3).cast("string").alias("district"), (k % 11).cast("string").alias("municipality"), (k % 7).cast("string").alias("locality")]
    position = lambda k, m: [(k % m / 10.0).alias("lng"), (k * 7 % m / 10.0).alias("lat")]
    p, s, c = F.col("p_partkey"), F.col("s_suppkey"), F.col("c_custkey")
    bulk = table(spark, sf_dir, "part").select(code(p).alias("postcode"), *place(p), *position(p, 1499))
    api = table(spark, sf_dir, "supplier").select(code(s * 3 + 1).alias("postcode"), *place(s), *position(s, 97))
    far = F.concat(F.lpad((5000 + c % 3000).cast("string"), 4, "0"), F.lit("-"), F.lpad((c * 17 % 1000).cast("string"), 3, "0"))
    used = table(spark, sf_dir, "customer").select(F.when(F.col("c_mktsegment") == "BUILDING", far).otherwise(code(c * 5 + 2)).alias("postcode"), *place(c)[:2])
    return api, bulk, used


def clean_postcodes(spark, sf_dir):
    api, bulk, _ = _codes(spark, sf_dir)
    return postcodes.clean_codes(api, bulk)[0]


def repaired_postcodes(spark, sf_dir):
    api, bulk, used = _codes(spark, sf_dir)
    return postcodes.repair(used, *postcodes.clean_codes(api, bulk))


def postcodes_to_look_up(spark, sf_dir):
    api, bulk, used = _codes(spark, sf_dir)
    return postcodes.lookup_worklist(used, bulk, api)


def data_checks(spark, sf_dir):
    wide, known, seen = marts.wide_cube(spark, sf_dir), marts.known(spark, sf_dir), licences(spark, sf_dir)
    summary = stored(spark, "area-summary", sf_dir, lambda: analytics.area_summary(wide, known, AS_OF))
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    facts = marts.cube_base(spark, sf_dir)
    return checks.run_checks({
        "licences_unique": checks.not_unique(seen, "al_id"),
        "wide_unique": checks.not_unique(wide, "area_id", "year_month"),
        "one_parent_per_locality": checks.several_parents(seen, "locality", "municipality"),
        "one_context_per_locality": checks.several_parents(facts.where("area_type = 'locality' AND context_area_type = 'region'"), "area_id", "context_area_id"),
        "areas_known": checks.unknown(seen.select("locality"), "locality", known.select("osm_id")),
        "growth_coverage": checks.low_coverage(summary, "admin_type", "al_count_growth_pcnt"),
        "growth_range": checks.out_of_range(summary, "al_count_growth_pcnt", -1.0, 10.0),
        "growth_range_narrow": checks.out_of_range(summary, "al_count_growth_pcnt", 0.5, 1.0),
        "growth_present": checks.missing_growth(summary, wide, known, "1998-08-01"),
        "part_brand_sizes": checks.several_parents(part, "p_brand", "p_size"),
        "lines_unique": checks.not_unique(line, "l_orderkey", "l_linenumber"),
        "parts_sold": checks.unknown(part.select("p_partkey"), "p_partkey", line.where("l_quantity > 45").select("l_partkey")),
        "discount_coverage": checks.low_coverage(line.withColumn("high", F.when(F.col("l_discount") > 0.01, F.col("l_discount"))), "l_returnflag", "high", 85.0),
    })


_SHAPES = "shapes AS (SELECT n_nationkey AS area_id, n_nationkey % 5 AS x, n_nationkey // 5 AS y FROM nation)"
_CODE = "lpad((1000 + {k} * 37 % 400)::VARCHAR, 4, '0') || '-' || lpad(({k} * 17 % 1000)::VARCHAR, 3, '0')"


def _code_rows(k: str, table_name: str, key: str, m: int) -> str:
    return f"SELECT {_CODE.format(k=k)} AS postcode, ({key} % 3)::VARCHAR AS district, ({key} % 11)::VARCHAR AS municipality, ({key} % 7)::VARCHAR AS locality, {key} % {m} / 10.0::DOUBLE AS lng, {key} * 7 % {m} / 10.0::DOUBLE AS lat FROM {table_name}"


_CLEAN = f"""bulk AS ({_code_rows('p_partkey', 'part', 'p_partkey', 1499)}), api AS ({_code_rows('(s_suppkey * 3 + 1)', 'supplier', 's_suppkey', 97)}),
used AS (SELECT CASE c_mktsegment WHEN 'BUILDING' THEN lpad((5000 + c_custkey % 3000)::VARCHAR, 4, '0') || '-' || lpad((c_custkey * 17 % 1000)::VARCHAR, 3, '0')
  ELSE {_CODE.format(k='(c_custkey * 5 + 2)')} END AS postcode, (c_custkey % 3)::VARCHAR AS district, (c_custkey % 11)::VARCHAR AS municipality FROM customer),
bad_api AS (SELECT DISTINCT postcode FROM api WHERE (lng, lat) IN (SELECT (lng, lat) FROM api GROUP BY lng, lat HAVING count(DISTINCT postcode) > 1)),
bad_bulk AS (SELECT DISTINCT postcode FROM bulk WHERE (lng, lat) IN (SELECT (lng, lat) FROM bulk GROUP BY lng, lat HAVING count(DISTINCT postcode) > 1)),
good_api AS (SELECT * FROM api WHERE postcode NOT IN (SELECT postcode FROM bad_api)),
clean AS (SELECT * FROM good_api UNION SELECT * FROM bulk WHERE postcode NOT IN (SELECT postcode FROM bad_bulk) AND postcode NOT IN (SELECT postcode FROM good_api))"""

#: A square's ring as GeoJSON writes it.
_ring = "concat('[', array_to_string(list_transform([[{a}, {a}], [{b}, {a}], [{b}, {b}], [{a}, {b}]], lambda p: concat('[', (x + p[1])::DOUBLE, ',', (y + p[2])::DOUBLE, ']')), ','), ']')"

#: From each customer to each shape of `corner` (id, a, b: an edge's ends): id, distance.
_TO_SHAPES = """p AS (SELECT c_custkey, c_custkey::DOUBLE * 0.6180339::DOUBLE % 7 - 1 AS x, c_custkey::DOUBLE * 0.7548776::DOUBLE % 9 - 2 AS y FROM customer),
t AS (SELECT c_custkey, x, y, id, a, b, greatest(0, least(1, ((x - a[1]) * (b[1] - a[1]) + (y - a[2]) * (b[2] - a[2])) / (pow(b[1] - a[1], 2) + pow(b[2] - a[2], 2)))) AS t FROM p, corner),
d AS (SELECT c_custkey, id, CASE WHEN count(*) FILTER ((a[2] > y) <> (b[2] > y) AND x < (b[1] - a[1]) * (y - a[2]) / nullif(b[2] - a[2], 0) + a[1]) % 2 = 1 THEN 0
  ELSE min(sqrt(pow(x - a[1] - t * (b[1] - a[1]), 2) + pow(y - a[2] - t * (b[2] - a[2]), 2))) END AS distance FROM t GROUP BY ALL)"""
_CONCAVE = " UNION ALL ".join(f"SELECT {first} + area_id AS id, list_transform({[list(c) for c in corners]}, lambda c: [x + c[1]::DOUBLE, y + c[2]::DOUBLE]) AS corners FROM shapes" for first, _, _, corners in _SHAPES_OF)
_CORNER = "corner AS (SELECT id, corners[i] AS a, corners[i % len(corners) + 1] AS b FROM (SELECT *, unnest(range(1, len(corners) + 1)) AS i FROM shape))"

ORACLE_SQL = {
    "similar_customers": """SELECT a.c_nationkey, a.c_name AS name, b.c_name AS other, levenshtein(a.c_name, b.c_name)::INTEGER AS distance
FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_name < b.c_name WHERE levenshtein(a.c_name, b.c_name) <= 1""",
    "nearest_area": f"""WITH {_SHAPES}, shape AS ({_CONCAVE}), {_CORNER}, {_TO_SHAPES}
SELECT c_custkey, id::BIGINT AS osm_id, round(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY distance, id) = 1""",
    "customers_in_shapes": f"""WITH {_SHAPES}, shape AS ({_CONCAVE}
  UNION ALL SELECT 9000, {[list(c) for c in _LAND]} UNION ALL SELECT 9001 + i, list_transform({[list(c) for c in _COLUMN]}, lambda c: [i + c[1], c[2]]) FROM range(5) t(i)), {_CORNER}, {_TO_SHAPES}
SELECT c_custkey, id::BIGINT AS osm_id FROM d WHERE distance = 0""",
    "close_areas": f"""WITH {_SHAPES}, r(corners) AS (VALUES ([[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]), ([[0.4, 0.4], [0.6, 0.4], [0.6, 0.6], [0.4, 0.6]])),
corner AS (SELECT area_id AS id, [x + corners[i][1]::DOUBLE, y + corners[i][2]::DOUBLE] AS a, [x + corners[i % 4 + 1][1]::DOUBLE, y + corners[i % 4 + 1][2]::DOUBLE] AS b FROM shapes, r, range(1, 5) u(i)), {_TO_SHAPES}
SELECT c_custkey, id AS area_id, round(distance, 6) AS distance FROM d WHERE distance <= 0.3""",
    "latest_event": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "first_order": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_custkey, o_orderpriority, o_totalprice DESC, o_orderkey",
    "nearest_supplier": """WITH l AS (SELECT c_custkey, c_acctbal, n_nationkey AS nation, n_regionkey AS region FROM customer JOIN nation ON c_nationkey = n_nationkey),
r AS (SELECT s_suppkey, s_acctbal, n_nationkey AS nation, n_regionkey AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey),
p AS (SELECT c_custkey, s_suppkey, CASE WHEN l.nation = r.nation THEN 0 WHEN l.region = r.region THEN 1 ELSE 2 END AS t, abs(c_acctbal - s_acctbal) AS d FROM l JOIN r ON l.region % 2 = r.region % 2)
SELECT c_custkey, s_suppkey, ['nation', 'region', 'half'][t + 1] AS tier, round(d, 4) AS distance FROM p QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY t, d, s_suppkey) = 1""",
    "shared_positions": """WITH c AS (SELECT DISTINCT 'P' || lpad(p_partkey::VARCHAR, 9, '0') AS code, p_partkey % 97 AS x, p_partkey * p_partkey % 89 AS y FROM part)
SELECT a.code, min(b.code) AS alias FROM c a JOIN c b ON a.x = b.x AND a.y = b.y AND a.code <> b.code GROUP BY a.code""",
    "not_in_with_null": "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT CASE WHEN n_nationkey <> 3 THEN n_nationkey END FROM nation)",
    "not_in_without_null": "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)",
    "parts_never_sold_cheap": """SELECT p_partkey, p_brand FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity < 2)
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount > 0.05)""",
    "null_safe_match": f"""WITH {DOMAIN_SQL}, n AS (SELECT is_building_post_1951, house_type, lost_in_year_month IS NULL AS stays, count(*) AS n FROM licences GROUP BY ALL)
SELECT coalesce(a.is_building_post_1951::VARCHAR, 'unknown') AS is_building_post_1951, a.house_type, a.n AS kept, b.n AS lost
FROM n a LEFT JOIN n b ON a.is_building_post_1951 IS NOT DISTINCT FROM b.is_building_post_1951 AND a.house_type IS NOT DISTINCT FROM b.house_type AND NOT b.stays WHERE a.stays""",
    "area_paths": f"""WITH {DOMAIN_SQL}, up AS (SELECT osm_id AS group_id, parent_id AS area_id FROM areas WHERE parent_id IS NOT NULL
  UNION ALL SELECT a.osm_id, p.parent_id FROM areas a JOIN areas p ON a.parent_id = p.osm_id WHERE p.parent_id IS NOT NULL)
SELECT group_id, string_agg(name, ', ' ORDER BY admin_level DESC, name DESC) AS name FROM up JOIN areas ON area_id = osm_id GROUP BY group_id""",
    "capitalized": r"""WITH r AS (SELECT p_partkey AS id, p_name || '-' || p_brand AS raw FROM part UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN '77-8' ELSE o_orderpriority END FROM orders),
s AS (SELECT *, regexp_split_to_array(raw, '\P{L}+') AS words, regexp_split_to_array(raw, '\p{L}+') AS gaps FROM r)
SELECT id, raw, CASE WHEN raw IS NULL OR raw = '' OR NOT regexp_matches(raw, '\p{L}') THEN raw WHEN regexp_matches(raw, '^\P{L}*\p{L}+$') THEN upper(raw[1]) || lower(raw[2:])
  ELSE regexp_replace(array_to_string(list_transform(list_zip(gaps, words), lambda p: coalesce(p[1], '') || upper(coalesce(p[2], '')[1]) || lower(coalesce(p[2], '')[2:])), ''), ' {2,}', ' ', 'g') END AS name FROM s""",
    "slugs": r"""SELECT p_partkey, lower(regexp_replace(regexp_replace(strip_accents('Ção ' || p_name || ', ' || p_brand || ', ' || p_type), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug,
  lower(strip_accents('ÉÃ' || p_name)) AS folded FROM part""",
    "postcodes_normalised": rf"""WITH r AS (SELECT c_custkey, trim({_RAW_CODE}) AS c FROM customer),
n AS (SELECT c_custkey, CASE WHEN c IS NULL THEN '0000-000' WHEN regexp_full_match(c, '\d{{4}}-\d{{3}}') THEN c WHEN regexp_full_match(c, '\d{{4}}-\d{{2}}') THEN c || '0' WHEN regexp_full_match(c, '\d{{4}}') THEN c || '-000'
  WHEN regexp_full_match(c, '\d{{3}}') THEN c || '0-000' WHEN regexp_full_match(c, '\d{{3}}-\d{{3}}') THEN '0' || c[1:3] || '-000' WHEN regexp_full_match(c, '\d{{2}}-\d{{3}}') THEN '00' || c[1:2] || '-000'
  WHEN regexp_full_match(c, '\d-\d{{3}}') THEN '000' || c[1] || '-000' WHEN regexp_full_match(c, '\d{{5}}') THEN c[1:4] || '-000' WHEN regexp_matches(c, '^\d{{4}}-\d{{3}},') THEN c[1:8] ELSE c END AS postcode FROM r)
SELECT c_custkey, postcode, try_cast(postcode[1:4] || postcode[6:9] AS INTEGER) AS number FROM n""",
    "name_similarity": """SELECT DISTINCT p_name, lower(p_type) AS other, levenshtein(p_name, lower(p_type))::INTEGER AS levenshtein, damerau_levenshtein(p_name, lower(p_type))::INTEGER AS damerau,
  round(jaro_similarity(p_name, lower(p_type)), 6) AS jaro, round(jaro_winkler_similarity(p_name, lower(p_type)), 6) AS jaro_winkler, round(jaccard(p_name, lower(p_type)), 6) AS jaccard FROM part""",
    "orders_in_nations": f"""WITH {_SHAPES}, p AS (SELECT o_orderkey, o_orderkey % 613 / 120.0::DOUBLE AS px, o_custkey % 617 / 120.0::DOUBLE AS py FROM orders)
SELECT area_id, count(*) AS n, min(o_orderkey) AS first FROM p LEFT JOIN shapes ON px >= x AND px < x + 1 AND py >= y AND py < y + 1
  AND NOT (px >= x + 0.4::DOUBLE AND px < x + 0.6::DOUBLE AND py >= y + 0.4::DOUBLE AND py < y + 0.6::DOUBLE) GROUP BY area_id""",
    "close_suppliers": """WITH s AS (SELECT s_suppkey, s_suppkey % 41 / 8.0::DOUBLE AS x, s_suppkey % 37 / 8.0::DOUBLE AS y FROM supplier),
n AS (SELECT n_nationkey, n_nationkey % 5 + 0.5::DOUBLE AS x, n_nationkey // 5 + 0.5::DOUBLE AS y FROM nation),
d AS (SELECT s_suppkey, n_nationkey, sqrt(pow(s.x - n.x, 2) + pow(s.y - n.y, 2)) AS distance FROM s CROSS JOIN n)
SELECT s_suppkey, n_nationkey, round(distance, 6) AS distance FROM d WHERE distance <= 0.5""",
    "hierarchy": f"""WITH {_SHAPES},
shape AS ({' UNION ALL '.join(f"SELECT {first} + area_id AS osm_id, '{name} ' || area_id AS name, {level} AS admin_level, list_transform({[list(c) for c in corners]}, lambda c: [x + c[1], y + c[2]]) AS corners FROM shapes" for first, name, level, corners in _SHAPES_OF)}
  UNION ALL SELECT 9000, 'Land', 2, {[list(c) for c in _LAND]} UNION ALL SELECT 9001 + i, 'Column ' || i, 4, list_transform({[list(c) for c in _COLUMN]}, lambda c: [i + c[1], c[2]]) FROM range(5) t(i)),
corner AS (SELECT osm_id, admin_level, corners[i] AS a, corners[i % len(corners) + 1] AS b FROM (SELECT *, unnest(range(1, len(corners) + 1)) AS i FROM shape)),
meets AS (SELECT c.osm_id, p.osm_id AS up, c.a, count(*) FILTER ((p.a[2] > c.a[2]) <> (p.b[2] > c.a[2]) AND c.a[1] < (p.b[1] - p.a[1]) * (c.a[2] - p.a[2]) / nullif(p.b[2] - p.a[2], 0) + p.a[1]) % 2 = 1 AS is_in,
    bool_or(((c.b[1] - c.a[1]) * (p.a[2] - c.a[2]) - (c.b[2] - c.a[2]) * (p.a[1] - c.a[1])) * ((c.b[1] - c.a[1]) * (p.b[2] - c.a[2]) - (c.b[2] - c.a[2]) * (p.b[1] - c.a[1])) < 0
      AND ((p.b[1] - p.a[1]) * (c.a[2] - p.a[2]) - (p.b[2] - p.a[2]) * (c.a[1] - p.a[1])) * ((p.b[1] - p.a[1]) * (c.b[2] - p.a[2]) - (p.b[2] - p.a[2]) * (c.b[1] - p.a[1])) < 0) AS cuts
  FROM corner c JOIN corner p ON p.admin_level < c.admin_level GROUP BY ALL),
above AS (SELECT osm_id, up FROM meets GROUP BY ALL HAVING bool_and(is_in) AND NOT bool_or(cuts)),
placed AS (SELECT s.osm_id, s.name, s.admin_level, count(u.osm_id) AS depth, arg_max(u.osm_id, u.admin_level) AS parent_id, arg_max(u.name, u.admin_level) AS parent_name, string_agg(u.name, ', ' ORDER BY u.admin_level DESC) AS parent_path
  FROM shape s LEFT JOIN above USING (osm_id) LEFT JOIN shape u ON u.osm_id = up GROUP BY ALL),
named AS (SELECT *, CASE admin_level WHEN 8 THEN 'locality' WHEN 7 THEN 'municipality' ELSE 'region' END AS admin_type, osm_id NOT IN (SELECT parent_id FROM placed WHERE parent_id IS NOT NULL) AS is_leaf,
  concat_ws(', ', name, parent_path) AS full_name, lower(replace(replace(concat_ws(', ', name, parent_path), ', ', '_'), ' ', '_')) AS slug FROM placed)
SELECT n.osm_id::BIGINT AS osm_id, n.name, n.admin_level, n.admin_type, n.depth, n.parent_id::BIGINT AS parent_id, n.parent_name, n.is_leaf, n.parent_path, n.full_name, n.slug,
  CASE n.admin_type WHEN 'locality' THEN p.slug WHEN 'municipality' THEN n.slug END AS municipality_slug, CASE n.admin_type WHEN 'locality' THEN g.slug WHEN 'municipality' THEN p.slug ELSE n.slug END AS region_slug
FROM named n LEFT JOIN named p ON n.parent_id = p.osm_id LEFT JOIN named g ON p.parent_id = g.osm_id""",
    "nation_grid": f"""WITH {_SHAPES} SELECT area_id AS id, i::INTEGER AS cell_x, j::INTEGER AS cell_y, round(x + i / 4.0::DOUBLE, 6) AS x0, round(y + (j + 1) / 4.0::DOUBLE, 6) AS y1, true AS inside
FROM shapes, range(4) a(i), range(4) b(j)""",
    "nation_parts": f"""WITH {_SHAPES}, cell AS (SELECT area_id AS id, i::INTEGER AS cell_x, j::INTEGER AS cell_y, i / 4.0::DOUBLE AS x0, j / 4.0::DOUBLE AS y0 FROM shapes, range(4) a(i), range(4) b(j)),
cut AS (SELECT *, greatest(least(x0 + 0.25, 0.6) - greatest(x0, 0.4), 0)::DOUBLE * greatest(least(y0 + 0.25, 0.6) - greatest(y0, 0.4), 0)::DOUBLE AS gone,
  (SELECT count(*) FROM (VALUES (0.4), (0.6)) h(hx), (VALUES (0.4), (0.6)) v(hy) WHERE hx BETWEEN x0 AND x0 + 0.25 AND hy BETWEEN y0 AND y0 + 0.25) AS corners FROM cell)
SELECT id, cell_x, cell_y, gone = 0 AS inside, 1 AS parts, (5 + 2 * corners)::INTEGER AS n_points, round(0.0625 - gone, 6) AS area FROM cut""",
    "shape_parts": f"""WITH {_SHAPES}, r(first, x0, y0, x1, y1) AS (VALUES (100, 0.1, 0.1, 0.9, 0.3), (100, 0.1, 0.3, 0.3, 0.9), (100, 0.7, 0.3, 0.9, 0.9), (200, 0.35, 0.35, 0.65, 0.85),
  (300, 0.15, 0.15, 0.85, 0.25), (300, 0.15, 0.25, 0.25, 0.85), (300, 0.75, 0.25, 0.85, 0.85), (400, 0.15, 0.8, 0.85, 0.88)),
b AS (SELECT first, min(x0)::DOUBLE AS bx, min(y0)::DOUBLE AS bottom, (max(x1) - min(x0))::DOUBLE AS w, (max(y1) - min(y0))::DOUBLE AS h FROM r GROUP BY first),
p AS (SELECT first, i, j, sum(greatest(least(x1, bx + w * (i + 1) / 7) - greatest(x0, bx + w * i / 7), 0) * greatest(least(y1, bottom + h * (j + 1) / 7) - greatest(y0, bottom + h * j / 7), 0)) AS area
  FROM r JOIN b USING (first), range(7) c(i), range(7) d(j) GROUP BY ALL)
SELECT first + area_id AS id, i::INTEGER AS cell_x, j::INTEGER AS cell_y, round(area, 6) AS area FROM p, shapes WHERE area > 1e-9""",
    "region_outlines": """WITH s AS (SELECT n_nationkey % 5 AS x, n_nationkey // 5 AS y, n_regionkey AS region FROM nation),
e AS (SELECT region, unnest([[x, y, x + 1, y], [x, y + 1, x + 1, y + 1], [x, y, x, y + 1], [x + 1, y, x + 1, y + 1]]) AS edge FROM s),
left_over AS (SELECT region, edge FROM e GROUP BY ALL HAVING count(*) = 1)
SELECT region::BIGINT AS region, count(*) AS edges, (SELECT count(*) FROM s WHERE s.region = l.region)::DOUBLE AS area FROM left_over l GROUP BY region""",
    "region_grid": """WITH s AS (SELECT (n_nationkey % 5)::DOUBLE AS x, (n_nationkey // 5)::DOUBLE AS y, n_regionkey AS region FROM nation),
b AS (SELECT min(x) AS bx, min(y) AS bottom, max(x) + 1 - min(x) AS w, max(y) + 1 - min(y) AS h FROM s),
p AS (SELECT region, i, j, sum(greatest(least(x + 1, bx + w * (i + 1) / 6) - greatest(x, bx + w * i / 6), 0) * greatest(least(y + 1, bottom + h * (j + 1) / 6) - greatest(y, bottom + h * j / 6), 0)) AS area
  FROM s, b, range(6) c(i), range(6) d(j) GROUP BY ALL)
SELECT region::BIGINT AS id, i::INTEGER AS cell_x, j::INTEGER AS cell_y, round(area, 6) AS area FROM p WHERE area > 1e-9""",
    "nation_spurs": f"""WITH {_SHAPES}, r(ring, corners) AS (VALUES (0, {[list(_RING_NODES[k]) for k in (0, 1, 2, 3)]}), (1, {[list(_RING_NODES[k]) for k in (2, 5, 6)]}), (2, {[list(_RING_NODES[k]) for k in (7, 8, 9, 10)]})),
e AS (SELECT ring, len(corners) AS n, corners[i] AS a, corners[i % len(corners) + 1] AS b FROM (SELECT *, unnest(range(1, len(corners) + 1)) AS i FROM r))
SELECT area_id::BIGINT AS relation, ring::BIGINT AS ring, n::INTEGER AS corners, round(sum(a[1] * b[2] - b[1] * a[2]) / 2, 6) AS area FROM e, shapes GROUP BY ALL""",
    "lost_users": """WITH l AS (SELECT user_id AS id, max(strftime(ts, '%Y-%m-%d')) AS last_seen FROM events GROUP BY 1), t AS (SELECT last_seen, lead(last_seen) OVER (ORDER BY last_seen) AS lost_in FROM (SELECT DISTINCT last_seen FROM l))
SELECT id, last_seen, lost_in FROM l JOIN t USING (last_seen) WHERE lost_in IS NOT NULL""",
    "lost_users_exact": """WITH s AS (SELECT DISTINCT user_id AS id, strftime(ts, '%Y-%m-%d') AS day FROM events), t AS (SELECT day, lead(day) OVER (ORDER BY day) AS lost_in FROM (SELECT DISTINCT day FROM s))
SELECT id, s.day AS last_seen, lost_in FROM s JOIN t USING (day) WHERE lost_in IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s o WHERE o.id = s.id AND o.day = t.lost_in)""",
    "month_windows": """WITH d AS (SELECT o_orderdate::DATE AS day FROM orders), e AS (SELECT min(day) AS first, max(day) AS last FROM d),
w AS (SELECT greatest(m::DATE, first) AS s, least(last_day(m::DATE), last) AS e FROM e, unnest(generate_series(date_trunc('month', first), last::TIMESTAMP, INTERVAL 1 MONTH)) t(m))
SELECT s::VARCHAR AS window_start, e::VARCHAR AS window_end, count(day) AS rows FROM w LEFT JOIN d ON day BETWEEN s AND e GROUP BY ALL""",
    "relation_ways": """WITH RECURSIVE m AS (SELECT p_partkey // 10 AS relation, 'w' AS kind, p_partkey AS ref, ['outer', 'inner', '', 'subarea'][p_size % 4 + 1] AS role FROM part
  UNION ALL SELECT p_partkey // 10, 'r', p_partkey // 10 // 3, ['outer', 'inner', '', 'subarea'][max(p_size) % 4 + 1] FROM part GROUP BY p_partkey // 10),
plain AS (SELECT relation, kind, ref, CASE role WHEN '' THEN 'outer' ELSE role END AS role FROM m WHERE role <> 'subarea'),
reach AS (SELECT relation AS top, relation AS node, 'outer' AS turn, [relation] AS path FROM (SELECT DISTINCT relation FROM plain)
  UNION ALL SELECT top, ref, CASE WHEN turn = 'outer' THEN role WHEN role = 'outer' THEN 'inner' ELSE 'outer' END, list_append(path, ref) FROM reach JOIN plain ON node = relation AND kind = 'r' WHERE NOT list_contains(path, ref))
SELECT DISTINCT top AS relation, ref AS way, CASE WHEN turn = 'outer' THEN role WHEN role = 'outer' THEN 'inner' WHEN role = 'inner' THEN 'outer' ELSE role END AS role FROM reach JOIN plain ON node = relation AND kind = 'w'""",
    "first_large_order": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1",
    "rich_or_near": "SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) OR c_acctbal > 9000",
    "segments_twice": "SELECT DISTINCT c_mktsegment AS value FROM customer UNION ALL SELECT DISTINCT c_mktsegment FROM customer UNION ALL SELECT DISTINCT o_orderpriority FROM orders",
    "seed_events": """SELECT DISTINCT ts::DATE::VARCHAR AS event_date, event_type AS event_name, event_type || ', "seen", on the day' AS description FROM events WHERE event_type <> 'purchase'""",
    "nation_rings": """SELECT n_nationkey::BIGINT AS relation, n_nationkey % 10 AS admin_level, 1 AS parts, 1 AS holes, (n_nationkey % 5)::DOUBLE AS x0, (n_nationkey // 5 + 1)::DOUBLE AS y1,
  false AS middle_is_in, true AS rim_is_in FROM nation WHERE n_nationkey % 7 <> 0 AND n_nationkey % 10 BETWEEN 3 AND 8""",
    "page_titles": """SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '<[^>]*>', '', 'g')) AS title,
  trim(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g')) AS heading FROM pages""",
    "clean_postcodes": f"WITH {_CLEAN} SELECT * FROM clean",
    "repaired_postcodes": f"""WITH {_CLEAN}, alias AS (SELECT a.postcode, min(b.postcode) AS alias FROM (SELECT * FROM api UNION SELECT * FROM bulk) a JOIN (SELECT * FROM api UNION SELECT * FROM bulk) b
    ON a.lng = b.lng AND a.lat = b.lat AND a.postcode <> b.postcode GROUP BY 1),
codes AS (SELECT postcode, min(municipality) AS municipality, min(district) AS district, try_cast(postcode[1:4] || postcode[6:9] AS INTEGER) AS number FROM used GROUP BY 1),
target AS (SELECT postcode AS alias, min(municipality) AS municipality, min(district) AS district, min(try_cast(postcode[1:4] || postcode[6:9] AS INTEGER)) AS number FROM clean GROUP BY 1),
pairs AS (SELECT c.postcode, t.alias, CASE WHEN c.municipality = t.municipality AND c.district = t.district THEN 0 WHEN c.municipality = t.municipality THEN 1 ELSE 2 END AS t, abs(c.number - t.number) AS d
  FROM codes c JOIN target t ON c.municipality = t.municipality OR c.postcode[1:2] = t.alias[1:2] WHERE c.postcode NOT IN (SELECT postcode FROM clean)),
near AS (SELECT postcode, alias, ['district', 'municipality', 'all'][t + 1] AS correction_type FROM pairs QUALIFY row_number() OVER (PARTITION BY postcode ORDER BY t, d, alias) = 1),
options AS (SELECT postcode, postcode AS alias, '_exact' AS correction_type FROM codes WHERE postcode IN (SELECT postcode FROM clean) UNION ALL SELECT * FROM near
  UNION ALL SELECT c.postcode, a.alias, 'duplicate' FROM codes c JOIN alias a USING (postcode) WHERE a.alias IN (SELECT postcode FROM clean)),
best AS (SELECT * FROM options QUALIFY row_number() OVER (PARTITION BY postcode ORDER BY correction_type, alias) = 1),
spot AS (SELECT postcode AS alias, lng, lat FROM clean QUALIFY row_number() OVER (PARTITION BY postcode ORDER BY lng, lat) = 1)
SELECT b.postcode, b.alias AS real_postcode, correction_type, lng, lat FROM best b LEFT JOIN spot USING (alias)""",
    "postcodes_to_look_up": f"""WITH {_CLEAN} SELECT postcode, count(*) AS num_properties FROM used WHERE regexp_full_match(postcode, '\\d{{4}}-\\d{{3}}') AND postcode NOT LIKE '%000'
  AND NOT EXISTS (SELECT 1 FROM bulk WHERE bulk.postcode = used.postcode) AND NOT EXISTS (SELECT 1 FROM api WHERE api.postcode = used.postcode) GROUP BY postcode""",
    "data_checks": f"""{marts.CUBE_SQL}, summary AS ({marts.ORACLE_SQL['area_summary'][len(marts.CUBE_SQL) + 2:].replace('years AS', 'SELECT * FROM (WITH years AS', 1)}))
SELECT 'licences_unique' AS name, (SELECT count(*) FROM (SELECT al_id FROM licences GROUP BY 1 HAVING count(*) > 1)) AS violations
UNION ALL SELECT 'wide_unique', (SELECT count(*) FROM (SELECT area_id, year_month FROM wide GROUP BY ALL HAVING count(*) > 1))
UNION ALL SELECT 'one_parent_per_locality', (SELECT count(*) FROM (SELECT locality FROM licences GROUP BY 1 HAVING count(DISTINCT municipality) > 1))
UNION ALL SELECT 'one_context_per_locality', (SELECT count(*) FROM (SELECT area_id FROM facts WHERE area_type = 'locality' AND context_area_type = 'region' GROUP BY 1 HAVING count(DISTINCT context_area_id) > 1))
UNION ALL SELECT 'areas_known', (SELECT count(*) FROM licences WHERE locality NOT IN (SELECT osm_id FROM areas))
UNION ALL SELECT 'growth_coverage', (SELECT count(*) FROM (SELECT admin_type FROM summary GROUP BY 1 HAVING count(al_count_growth_pcnt) * 100.0 / count(*) < 80))
UNION ALL SELECT 'growth_range', (SELECT count(*) FROM summary WHERE al_count_growth_pcnt NOT BETWEEN -1 AND 10)
UNION ALL SELECT 'growth_range_narrow', (SELECT count(*) FROM summary WHERE al_count_growth_pcnt NOT BETWEEN 0.5 AND 1)
UNION ALL SELECT 'growth_present', (SELECT count(*) FROM summary JOIN areas ON slug = area_slug AND areas.admin_type = 'region' WHERE al_count_growth_pcnt IS NULL
  AND osm_id IN (SELECT area_id FROM wide WHERE year_month = DATE '1998-08-01' AND cumulative_value_c > 0))
UNION ALL SELECT 'part_brand_sizes', (SELECT count(*) FROM (SELECT p_brand FROM part GROUP BY p_brand HAVING count(DISTINCT p_size) > 1))
UNION ALL SELECT 'lines_unique', (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1))
UNION ALL SELECT 'parts_sold', (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45))
UNION ALL SELECT 'discount_coverage', (SELECT count(*) FROM (SELECT l_returnflag FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_discount > 0.01) * 100.0 / count(*) < 85))""",
    "nation_features": f"""WITH {_SHAPES}, c AS (SELECT n_nationkey AS area_id, n_name, ({_ring.format(a=0.0, b=1.0)}) AS outline, ({_ring.format(a=0.4, b=0.6)}) AS hole FROM nation JOIN shapes ON area_id = n_nationkey)
SELECT concat('{{"type":"Feature","properties":{{"area_id":', area_id, ',"n_name":"', n_name, '"}},"geometry":{{"type":"MultiPolygon","coordinates":[[', outline, ',', hole, ']]}}}}') AS feature FROM c""",
    "nation_collections": f"""WITH {_SHAPES}, c AS (SELECT n_nationkey AS area_id, n_name, y AS row, ({_ring.format(a=0.0, b=1.0)}) AS outline, ({_ring.format(a=0.4, b=0.6)}) AS hole FROM nation JOIN shapes ON area_id = n_nationkey),
f AS (SELECT row, concat('{{"type":"Feature","properties":{{"area_id":', area_id, ',"n_name":"', n_name, '"}},"geometry":{{"type":"MultiPolygon","coordinates":[[', outline, ',', hole, ']]}}}}') AS feature FROM c)
SELECT row::BIGINT AS row, concat('{{"type":"FeatureCollection","features":[', string_agg(feature, ',' ORDER BY feature), ']}}') AS json FROM f GROUP BY row""",
}
QUERIES = {
    f.__name__: f
    for f in (
        latest_event, first_order, nearest_supplier, shared_positions, not_in_with_null, not_in_without_null, parts_never_sold_cheap, null_safe_match, area_paths, capitalized, slugs,
        postcodes_normalised, name_similarity, orders_in_nations, close_suppliers, hierarchy, nation_grid, nation_parts, shape_parts, region_outlines, region_grid, nation_spurs, similar_customers, nearest_area, customers_in_shapes, close_areas, lost_users, lost_users_exact, month_windows, relation_ways, page_titles, first_large_order, rich_or_near, segments_twice, seed_events, nation_rings,
        nation_features, nation_collections, clean_postcodes, repaired_postcodes, postcodes_to_look_up, data_checks,
    )
}
