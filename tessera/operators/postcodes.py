"""Repairing postal codes: which are reliable, which stand for others, and what is left to look up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import capitalize, fold, postcode_number
from tessera.operators.relational import nearest_within, shared_position, shuffled
from tessera.operators.spatial import point_in_polygon_join
from tessera.operators.staging import area_chain

#: (name, what makes the rows) -> the rows, written or not.
Step = Callable[[str, Callable[[], DataFrame]], DataFrame]
COLUMNS = ("postcode", "district", "municipality", "locality", "lng", "lat")


def clean_codes(api: DataFrame, bulk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reliable codes, aliases of the others). A position that several codes share says nothing, so its codes aren't reliable;
    looked-up codes go before bulk ones."""
    shared_api, shared_bulk = shared_position(api, "postcode", "lng", "lat"), shared_position(bulk, "postcode", "lng", "lat")
    good_api = api.select(*COLUMNS).join(shuffled(shared_api), "postcode", "left_anti")
    good_bulk = bulk.select(*COLUMNS).join(shuffled(shared_bulk), "postcode", "left_anti")
    clean = good_api.unionByName(good_bulk.join(shuffled(good_api.select("postcode")), "postcode", "left_anti")).distinct()
    both = api.select("postcode", "lng", "lat").unionByName(bulk.select("postcode", "lng", "lat"))
    return clean, shared_position(both, "postcode", "lng", "lat")


def _codes_in_use(used: DataFrame) -> DataFrame:
    """One row a code, with the first of its municipalities and districts by name. Repeats go first, by hash: minima of texts are found by sorting."""
    return used.select("postcode", "municipality", "district").distinct().groupBy("postcode").agg(F.min("municipality").alias("municipality"), F.min("district").alias("district"))


def _nearest(codes: DataFrame, clean: DataFrame) -> DataFrame:
    """Codes (postcode, municipality, district) -> postcode, alias, correction_type: the nearest reliable code by number within the
    district, municipality or first two digits. Codes that aren't digits have no number."""
    numbered = lambda df, code: df.withColumn("number", postcode_number(F.col(code)).cast("double")).withColumn("area2", F.substring(code, 1, 2))
    right = numbered(clean, "postcode").groupBy(F.col("postcode").alias("alias")).agg(*[F.min(c).alias(c) for c in ("municipality", "district", "number", "area2")])
    tiers = [("district", ["municipality", "district"]), ("municipality", ["municipality"]), ("all", ["area2"])]
    missing = numbered(codes, "postcode").where("number IS NOT NULL")
    return nearest_within(missing, right, "postcode", "alias", "number", "number", tiers).select("postcode", "alias", F.col("tier").alias("correction_type"))


def _other_names(api: DataFrame) -> DataFrame:
    """What a look-up called a code, if not what it was asked for."""
    return api.where("query_postcode <> postcode").select("postcode", F.col("query_postcode").alias("alias"), F.lit("api").alias("correction_type")).distinct()


def _first_choice(options: DataFrame) -> DataFrame:
    ranked = options.withColumn("place", F.row_number().over(W.partitionBy("postcode").orderBy("correction_type", "alias")))
    return ranked.where("place = 1").drop("place")


def repair(used: DataFrame, clean: DataFrame, aliases: DataFrame, api: DataFrame | None = None) -> DataFrame:
    """Codes in use (postcode, municipality, district) -> postcode, real_postcode, correction_type, lng, lat.

    A reliable code stays (`_exact`). Others take the nearest reliable code by number within their district, municipality or
    first two digits, the code that shares their position, or the one that a look-up (api: postcode, query_postcode) gave for
    them; of several the first in the order of the correction's name. Codes that aren't digits have no number.
    """
    codes = _codes_in_use(used)
    near = _nearest(codes.join(shuffled(clean.select("postcode").distinct()), "postcode", "left_anti"), clean)
    reliable = clean.select(F.col("postcode").alias("alias")).distinct()
    other = aliases.select("postcode", "alias", F.lit("duplicate").alias("correction_type"))
    if api is not None:
        other = other.unionByName(_other_names(api))
    same = codes.select("postcode").join(shuffled(other), "postcode").join(shuffled(reliable), "alias", "left_semi").select("postcode", "alias", "correction_type")
    exact = codes.select("postcode").join(shuffled(clean.select("postcode")), "postcode", "left_semi").select("postcode", F.col("postcode").alias("alias"), F.lit("_exact").alias("correction_type"))
    chosen = _first_choice(exact.unionByName(near).unionByName(same))
    at = clean.groupBy(F.col("postcode").alias("alias")).agg(F.min(F.struct("lng", "lat")).alias("at"))
    return chosen.join(shuffled(at), "alias", "left").select("postcode", F.col("alias").alias("real_postcode"), "correction_type", F.col("at.lng").alias("lng"), F.col("at.lat").alias("lat"))


def code_aliases(used: DataFrame, api: DataFrame, clean: DataFrame, shared: DataFrame) -> DataFrame:
    """postcode, alias_postcode, correction_type: one alias for each code that is used but not reliable (the nearest), that shares its
    position with another (shared: postcode, alias), or that a look-up called otherwise. Codes looked up for an unreliable
    one are searched for like it."""
    codes = _codes_in_use(used)
    missing = codes.join(shuffled(clean.select("postcode").distinct()), "postcode", "left_anti")
    asked = api.join(shuffled(missing.select(F.col("postcode").alias("query_postcode"))), "query_postcode", "left_semi").select("postcode", "municipality", "district")
    options = _nearest(missing.unionByName(asked), clean).unionByName(shared.select("postcode", "alias", F.lit("duplicate").alias("correction_type"))).unionByName(_other_names(api))
    return _first_choice(options).select("postcode", F.col("alias").alias("alias_postcode"), "correction_type")


def with_localities(clean: DataFrame, aliases: DataFrame, api: DataFrame) -> DataFrame:
    """Reliable codes, then aliases, that have been looked up with a locality: postcode, locality, district, municipality, lng, lat,
    is_valid, correction_type, real_postcode. Names and positions are their own, or those of the code that stands for them."""
    own = clean.groupBy("postcode").agg(F.min(F.struct("district", "municipality", "lng", "lat")).alias("r")).select("postcode", "r.*")
    valid = own.withColumns({"is_valid": F.lit(True), "correction_type": F.lit("_exact"), "real_postcode": F.col("postcode")})
    others = aliases.join(shuffled(own.select("postcode")), "postcode", "left_anti").select("postcode", "correction_type", F.col("alias_postcode").alias("real_postcode"))
    both = valid.unionByName(others.withColumn("is_valid", F.lit(False)), allowMissingColumns=True)
    places = ("district", "municipality", "lng", "lat")
    stands = both.select(F.col("postcode").alias("__real"), *[F.col(c).alias(f"__{c}") for c in places])
    looked_up = api.where("locality IS NOT NULL").groupBy(F.col("postcode").alias("__asked")).agg(F.min("locality").alias("locality"))
    rows = both.join(shuffled(stands), F.col("real_postcode") == F.col("__real"), "left").join(shuffled(looked_up), F.col("postcode") == F.col("__asked"))
    found = {c: F.coalesce(c, f"__{c}") for c in places}
    return rows.select(
        "postcode", "locality", capitalize(found["district"]).alias("district"), capitalize(found["municipality"]).alias("municipality"), found["lng"].alias("lng"), found["lat"].alias("lat"),
        "is_valid", "correction_type", "real_postcode", F.col("__lng").alias("x"), F.col("__lat").alias("y"),
    )


def located(codes: DataFrame, areas: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """with_localities() -> the codes with locality_id and the areas above it: by name within the municipality, else, for reliable codes,
    by the locality (polygons: osm_id, polygon) that holds their position. Of several the smallest id."""
    chain = area_chain(areas)
    keyed = chain.select(fold(F.col("locality_name")).alias("__l"), fold(F.col("municipality_name")).alias("__m"), "locality_osm_id")
    named = keyed.groupBy("__l", "__m").agg(F.min("locality_osm_id").alias("__by_name"))
    inside = _localities_at(codes.where("is_valid").select("postcode", "x", "y"), areas, polygons, size).withColumnRenamed("postcode", "__code").withColumnRenamed("osm_id", "__by_place")
    rows = codes.join(named, (fold(F.col("locality")) == F.col("__l")) & (fold(F.col("municipality")) == F.col("__m")), "left").join(shuffled(inside), F.col("postcode") == F.col("__code"), "left")
    rows = rows.withColumn("locality_id", F.coalesce("__by_name", "__by_place"))
    above = chain.withColumnRenamed("locality_osm_id", "__id")
    kept = ("postcode", F.col("locality_name").alias("locality"), "locality_id", "lng", "lat", "is_valid", "correction_type", "real_postcode")
    found = rows.drop("locality").join(above, F.col("locality_id") == F.col("__id"), "left")
    return found.select(*kept, F.col("municipality_osm_id").alias("municipality_id"), "municipality_name", F.col("region_osm_id").alias("region_id"), "region_name", "x", "y")


def _localities_at(points: DataFrame, areas: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """points (postcode, x, y) -> postcode, osm_id of the locality that holds it."""
    shapes = polygons.join(areas.where("admin_type = 'locality'").select("osm_id"), "osm_id", "left_semi")
    joined = point_in_polygon_join(points.where("x IS NOT NULL AND y IS NOT NULL"), shapes, "x", "y", "polygon", size)
    return joined.groupBy("postcode").agg(F.min("osm_id").alias("osm_id"))


def postcode_chain(used: DataFrame, api: DataFrame, bulk: DataFrame, areas: DataFrame, polygons: DataFrame, size: float, step: Step = lambda name, build: build()) -> DataFrame:
    """Codes in use, looked-up codes and bulk codes -> all codes with a locality, their position and the areas that they lie in.
    step(name, build) may write what several later steps read, and gives what they read."""
    aliases, clean = chain_aliases(used, api, bulk, step)
    return located(step("codes-with-localities", lambda: with_localities(clean, aliases, api)), areas, polygons, size)


def chain_aliases(used: DataFrame, api: DataFrame, bulk: DataFrame, step: Step = lambda name, build: build()) -> tuple[DataFrame, DataFrame]:
    """(code_aliases(), reliable codes), each a step."""
    reliable, same_place = clean_codes(api, bulk)
    clean, shared = step("clean-codes", lambda: reliable), step("shared-codes", lambda: same_place)
    return step("code-aliases", lambda: code_aliases(used, api, clean, shared)), clean


def similar_codes(used: DataFrame, codes: DataFrame, areas: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """Codes in use that postcode_chain() lacks -> the nearest of its codes with the same first four digits, and its locality: by the
    names from the region down, else by position. postcode, near_postcode, distance, locality_osm_id."""
    numbered = lambda df: df.withColumn("number", postcode_number(F.col("postcode")).cast("double")).withColumn("area4", F.substring("postcode", 1, 4)).where("number IS NOT NULL")
    missing = numbered(used.select("postcode").where("postcode IS NOT NULL").distinct().join(shuffled(codes.select("postcode")), "postcode", "left_anti"))
    right = numbered(codes.select("postcode")).withColumnRenamed("postcode", "near_postcode")
    near = nearest_within(missing, right, "postcode", "near_postcode", "number", "number", [("area", ["area4"])]).drop("tier")
    chain = area_chain(areas)
    names = [fold(F.col(c)) for c in ("locality_name", "municipality_name", "region_name")]
    named = chain.select(*[k.alias(f"__{n}") for k, n in zip(names, "lmr")], "locality_osm_id").groupBy("__l", "__m", "__r").agg(F.min("locality_osm_id").alias("__by_name"))
    rows = near.join(shuffled(codes.select(F.col("postcode").alias("near_postcode"), "locality", "municipality_name", "region_name", "x", "y")), "near_postcode")
    on = (fold(F.col("locality")) == F.col("__l")) & (fold(F.col("municipality_name")) == F.col("__m")) & (fold(F.col("region_name")) == F.col("__r"))
    inside = _localities_at(rows.select("postcode", "x", "y"), areas, polygons, size).withColumnRenamed("postcode", "__code").withColumnRenamed("osm_id", "__by_place")
    found = rows.join(named, on, "left").join(shuffled(inside), F.col("postcode") == F.col("__code"), "left")
    return found.select("postcode", "near_postcode", "distance", F.coalesce("__by_name", "__by_place").alias("locality_osm_id"))


def shared_codes(bulk: DataFrame) -> DataFrame:
    """Codes at a position that another code has too (an EXISTS over two columns)."""
    shared = bulk.groupBy("lng", "lat").agg(F.count_distinct("postcode").alias("n")).where("n > 1")
    return bulk.join(shuffled(shared), ["lng", "lat"], "left_semi").select("postcode").distinct()


def lookup_worklist(used: DataFrame, *known: DataFrame) -> DataFrame:
    """Well-formed codes in use, but for those of whole areas (ending in 000), that no known list has, by how often they occur."""
    codes = used.groupBy("postcode").agg(F.count(F.lit(1)).alias("num_properties"))
    codes = codes.where(F.col("postcode").rlike(r"\A\d{4}-\d{3}\z") & ~F.col("postcode").endswith("000"))
    for other in known:
        codes = codes.join(other.select("postcode"), "postcode", "left_anti")
    return codes
