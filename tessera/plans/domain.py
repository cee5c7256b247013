"""The registry's concepts over the tables at hand: orders are licences, nations and their market segments are areas.

A locality is a market segment of a nation, a municipality is a nation, a region is a region, the country is area 0. The
same derivations in SQL are in DOMAIN_SQL, for the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Market segments in order; a locality's id holds the segment's place.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
AS_OF = "2001-08-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _segment(column: str):
    return (F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), F.col(column)) - 1).cast("int")


def customer_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c_custkey and its locality, municipality and region."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    return joined.select(
        "c_custkey",
        "c_acctbal",
        (10000 + 10 * F.col("n_nationkey") + _segment("c_mktsegment")).cast("long").alias("locality"),
        (1000 + F.col("n_nationkey")).cast("long").alias("municipality"),
        (100 + F.col("n_regionkey")).cast("long").alias("region"),
    )


def licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each licence: al_id, registration_date, lost_month, guests, rooms, house type and its areas."""
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    joined = orders.join(customer_areas(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
    date = F.col("o_orderdate").cast("date")
    lost = F.when((F.col("o_orderstatus") == "F") & (key % 7 == 0), F.date_format(F.add_months(date, (1 + key % 24).cast("int")), "yyyy-MM"))
    return joined.select(
        key.alias("al_id"),
        date.alias("registration_date"),
        F.date_format(date, "yyyy-MM").alias("year_month"),
        lost.alias("lost_in_year_month"),
        (key % 9).cast("int").alias("max_guests"),
        (key % 5).cast("int").alias("rooms"),
        F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("is_building_post_1951"),
        F.col("o_orderpriority").alias("house_type"),
        "locality",
        "municipality",
        "region",
    )


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hierarchy: osm_id, name, admin_type, admin_level, parent_id, population, slug and its ancestors' slugs."""
    people = customer_areas(spark, sf_dir)
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    count = (1000 * F.count(F.lit(1))).cast("long").alias("population")
    localities = people.groupBy(F.col("locality").alias("osm_id"), F.col("municipality").alias("parent_id")).agg(count)
    named = localities.join(nation.select((1000 + F.col("n_nationkey")).cast("long").alias("of"), "n_name", "n_regionkey"), F.col("parent_id") == F.col("of"))
    segment = F.element_at(F.array(*[F.lit(s.lower()) for s in SEGMENTS]), (F.col("osm_id") % 10 + 1).cast("int"))
    region_slug = F.concat(F.lit("region_"), F.col("n_regionkey").cast("string"))
    low = named.select(
        "osm_id", F.initcap(segment).alias("name"), F.lit("locality").alias("admin_type"), F.lit(8).alias("admin_level"), "parent_id", "population",
        F.concat(segment, F.lit("_"), F.lower("n_name")).alias("slug"), F.lower("n_name").alias("municipality_slug"), region_slug.alias("region_slug"),
    )
    cities = people.groupBy(F.col("municipality").alias("osm_id"), F.col("region").alias("parent_id")).agg(count)
    cities = cities.join(nation.select((1000 + F.col("n_nationkey")).cast("long").alias("of"), "n_name", "n_regionkey"), F.col("osm_id") == F.col("of"))
    middle = cities.select(
        "osm_id", F.col("n_name").alias("name"), F.lit("municipality").alias("admin_type"), F.lit(7).alias("admin_level"), "parent_id", "population",
        F.lower("n_name").alias("slug"), F.lower("n_name").alias("municipality_slug"), region_slug.alias("region_slug"),
    )
    wide = people.groupBy(F.col("region").alias("osm_id")).agg(count)
    wide = wide.join(region.select((100 + F.col("r_regionkey")).cast("long").alias("of"), "r_name", "r_regionkey"), F.col("osm_id") == F.col("of"))
    high = wide.select(
        "osm_id", F.col("r_name").alias("name"), F.lit("region").alias("admin_type"), F.lit(4).alias("admin_level"), F.lit(None).cast("long").alias("parent_id"),
        "population", F.concat(F.lit("region_"), F.col("r_regionkey").cast("string")).alias("slug"), F.lit(None).cast("string").alias("municipality_slug"),
        F.concat(F.lit("region_"), F.col("r_regionkey").cast("string")).alias("region_slug"),
    )
    return low.unionByName(middle).unionByName(high)


DOMAIN_SQL = """
people AS (SELECT c_custkey, c_acctbal, (10000 + 10 * n_nationkey + list_position(['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'], c_mktsegment) - 1)::BIGINT AS locality,
  (1000 + n_nationkey)::BIGINT AS municipality, (100 + n_regionkey)::BIGINT AS region, n_nationkey, n_regionkey, n_name, lower(c_mktsegment) AS segment
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
licences AS (SELECT o_orderkey AS al_id, o_orderdate::DATE AS registration_date, strftime(o_orderdate, '%Y-%m') AS year_month,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 7 = 0 THEN strftime(o_orderdate::DATE + to_months((1 + o_orderkey % 24)::INTEGER), '%Y-%m') END AS lost_in_year_month,
  (o_orderkey % 9)::INTEGER AS max_guests, (o_orderkey % 5)::INTEGER AS rooms,
  CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS is_building_post_1951, o_orderpriority AS house_type, locality, municipality, region
  FROM orders JOIN people ON o_custkey = c_custkey),
areas AS (
  SELECT locality AS osm_id, upper(segment[1]) || segment[2:] AS name, 'locality' AS admin_type, 8 AS admin_level, municipality AS parent_id, 1000 * count(*) AS population,
    segment || '_' || lower(n_name) AS slug, lower(n_name) AS municipality_slug, 'region_' || n_regionkey AS region_slug
  FROM people GROUP BY locality, municipality, segment, n_name, n_regionkey
  UNION ALL SELECT municipality, n_name, 'municipality', 7, region, 1000 * count(*), lower(n_name), lower(n_name), 'region_' || n_regionkey
  FROM people GROUP BY municipality, region, n_name, n_regionkey
  UNION ALL SELECT region, r_name, 'region', 4, NULL, 1000 * count(*), 'region_' || r_regionkey, NULL, 'region_' || r_regionkey
  FROM people JOIN region t ON r_regionkey = n_regionkey GROUP BY people.region, r_name, r_regionkey)
"""
