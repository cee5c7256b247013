"""Parameterised reads of the marts, one for each kind of report. Parameters are function arguments, never text put into SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import analytics
from tessera.plans import marts
from tessera.plans.domain import AS_OF

SLUG, REGION, BASE = "nation_3", "region_3", "1999-08-01"


def timeline(events: DataFrame) -> DataFrame:
    """Events to show: those whose name doesn't begin with #."""
    return events.where(~F.col("event_name").like("#%"))


def area_months(long: DataFrame, known: DataFrame, slug: str | None, metric: str = "c") -> DataFrame:
    """year_month, value, cumulative_value of one metric for an area, or for the country."""
    rows = long.where((F.col("metric_name") == metric) & (F.col("context_area_type") == "country"))
    if slug is None:
        rows = rows.where("area_type = 'country'")
    else:
        rows = rows.join(known.where(F.col("slug") == slug).select("osm_id"), F.col("area_id") == F.col("osm_id"), "left_semi")
    return rows.select(F.date_format("year_month", "yyyy-MM-dd").alias("year_month"), F.round("value", 6).alias("value"), F.round("cumulative_value", 6).alias("cumulative_value"))


def breadcrumb(known: DataFrame, slug: str) -> DataFrame:
    """An area and its ancestors, from the top."""
    up = analytics.ancestors(known, 3, None)
    own = known.where(F.col("slug") == slug).select(F.col("osm_id").alias("group_id"))
    return up.join(own, "group_id", "left_semi").join(known.select(F.col("osm_id").alias("area_id"), "name", "slug", "admin_type"), "area_id").select("depth", "name", "slug", "admin_type")


def siblings(wide: DataFrame, known: DataFrame, slug: str, as_of: str) -> DataFrame:
    """All areas of the same type in the month, with the area itself marked."""
    kind = known.where(F.col("slug") == slug).select("admin_type")
    same = known.join(kind, "admin_type", "left_semi")
    now = wide.where(F.col("year_month") == F.lit(as_of).cast("date")).select("area_id", F.col("cumulative_value_c").alias("al_count"), F.col("country_rank_c").alias("place"))
    return same.join(now, F.col("osm_id") == F.col("area_id")).select("slug", "admin_type", "al_count", "place", (F.col("slug") == slug).alias("is_own"))


def growth_since(wide: DataFrame, known: DataFrame, as_of: str, base: str, parent_slug: str) -> DataFrame:
    """Growth of an area's direct parts since a base month."""
    at = lambda day, name: wide.where(F.col("year_month") == F.lit(day).cast("date")).select("area_id", F.col("cumulative_value_c").alias(name))
    parent = known.where(F.col("slug") == parent_slug).select(F.col("osm_id").alias("p"))
    parts = known.join(parent, known.parent_id == F.col("p"), "left_semi")
    joined = parts.join(at(as_of, "now"), F.col("osm_id") == F.col("area_id")).drop("area_id").join(at(base, "before").withColumnRenamed("area_id", "b"), F.col("osm_id") == F.col("b"), "left")
    return joined.select("slug", "name", "now", "before", F.round(F.try_divide(F.col("now"), F.nullif(F.col("before"), F.lit(0.0))) - 1, 6).alias("growth"))


def parts_table(summary: DataFrame, parent_slug: str) -> DataFrame:
    return summary.where(F.col("direct_parent_slug") == parent_slug).select("area_name", "area_slug", "al_count", "rank_within_country", F.round("al_count_growth_pcnt", 6).alias("growth"))


def parts_rooms(rooms: DataFrame, known: DataFrame, parent_slug: str) -> DataFrame:
    """Room shares of an area's direct parts."""
    parent = known.where(F.col("slug") == parent_slug).select(F.col("osm_id").alias("p"))
    parts = known.join(parent, known.parent_id == F.col("p"), "left_semi").select("slug")
    own = rooms.join(parts, "slug", "left_semi").join(known.select(F.col("osm_id").alias("area_id"), F.col("slug").alias("own")), "area_id")
    return own.where("own = slug").select("slug", "metric_name", "room_category", F.round("value", 6).alias("value"))


def report_country_months(spark, sf_dir):
    return area_months(marts.long_cube(spark, sf_dir), marts.known(spark, sf_dir), None)


def report_area_months(spark, sf_dir):
    return area_months(marts.long_cube(spark, sf_dir), marts.known(spark, sf_dir), SLUG)


def report_lost_months(spark, sf_dir):
    return area_months(marts.long_cube(spark, sf_dir), marts.known(spark, sf_dir), SLUG, "lost_licenses")


def report_breadcrumb(spark, sf_dir):
    return breadcrumb(marts.known(spark, sf_dir), SLUG)


def report_siblings(spark, sf_dir):
    return siblings(marts.wide_cube(spark, sf_dir), marts.known(spark, sf_dir), SLUG, AS_OF)


def report_growth_since(spark, sf_dir):
    return growth_since(marts.wide_cube(spark, sf_dir), marts.known(spark, sf_dir), AS_OF, BASE, REGION)


def report_parts_table(spark, sf_dir):
    return parts_table(analytics.area_summary(marts.wide_cube(spark, sf_dir), marts.known(spark, sf_dir), AS_OF), REGION)


def report_parts_rooms(spark, sf_dir):
    known = marts.known(spark, sf_dir)
    return parts_rooms(analytics.room_distribution(marts.long_cube(spark, sf_dir), known, AS_OF), known, REGION)


_months = "SELECT year_month::VARCHAR AS year_month, round(value, 6) AS value, round(cumulative_value, 6) AS cumulative_value FROM ranked WHERE context_area_type = 'country'"
_here = f"area_id IN (SELECT osm_id FROM areas WHERE slug = '{SLUG}')"
ORACLE_SQL = {
    "report_country_months": f"{marts.CUBE_SQL} {_months} AND area_type = 'country' AND metric_name = 'c'",
    "report_area_months": f"{marts.CUBE_SQL} {_months} AND metric_name = 'c' AND {_here}",
    "report_lost_months": f"{marts.CUBE_SQL} {_months} AND metric_name = 'lost_licenses' AND {_here}",
    "report_breadcrumb": f"""{marts.CUBE_SQL} SELECT 0 AS depth, name, slug, admin_type FROM areas WHERE slug = '{SLUG}'
  UNION ALL SELECT 1, p.name, p.slug, p.admin_type FROM areas a JOIN areas p ON a.parent_id = p.osm_id WHERE a.slug = '{SLUG}'""",
    "report_siblings": f"""{marts.CUBE_SQL} SELECT slug, admin_type, cumulative_value_c AS al_count, country_rank_c AS place, slug = '{SLUG}' AS is_own FROM areas JOIN wide ON osm_id = area_id
  WHERE year_month = DATE '{AS_OF}' AND admin_type = (SELECT admin_type FROM areas WHERE slug = '{SLUG}')""",
    "report_growth_since": f"""{marts.CUBE_SQL} SELECT slug, name, n.cumulative_value_c AS now, b.cumulative_value_c AS before, round(n.cumulative_value_c / nullif(b.cumulative_value_c, 0) - 1, 6) AS growth
  FROM areas JOIN wide n ON osm_id = n.area_id AND n.year_month = DATE '{AS_OF}' LEFT JOIN wide b ON osm_id = b.area_id AND b.year_month = DATE '{BASE}'
  WHERE parent_id = (SELECT osm_id FROM areas WHERE slug = '{REGION}')""",
    "report_parts_table": f"""{marts.CUBE_SQL} SELECT name AS area_name, slug AS area_slug, n.cumulative_value_c AS al_count, n.country_rank_c AS rank_within_country,
  round((n.cumulative_value_c - b.cumulative_value_c) / nullif(b.cumulative_value_c, 0), 6) AS growth
  FROM areas JOIN wide n ON osm_id = n.area_id AND n.year_month = DATE '{AS_OF}' LEFT JOIN wide b ON osm_id = b.area_id AND b.year_month = (DATE '{AS_OF}' - INTERVAL 36 MONTH)::DATE
  WHERE admin_type = 'municipality' AND region_slug = '{REGION}'""",
    "report_parts_rooms": f"""{marts.CUBE_SQL} SELECT slug, CASE metric_name WHEN 'rooms_0' THEN '0 rooms' WHEN 'rooms_1' THEN '1 room' WHEN 'rooms_2' THEN '2 rooms' WHEN 'rooms_3' THEN '3 rooms' ELSE 'More than 3 rooms' END AS metric_name,
  CASE metric_name WHEN 'rooms_0' THEN 1 WHEN 'rooms_1' THEN 2 WHEN 'rooms_2' THEN 3 WHEN 'rooms_3' THEN 4 ELSE 5 END AS room_category, round(cumulative_value, 6) AS value
  FROM areas JOIN ranked ON osm_id = area_id WHERE parent_id = (SELECT osm_id FROM areas WHERE slug = '{REGION}') AND year_month = DATE '{AS_OF}' AND context_area_type = 'country'
  AND metric_name IN ('rooms_0', 'rooms_1', 'rooms_2', 'rooms_3', 'rooms_more_than_3')""",
}
QUERIES = {
    f.__name__: f
    for f in (
        report_country_months, report_area_months, report_lost_months, report_breadcrumb, report_siblings, report_growth_since, report_parts_table, report_parts_rooms,
    )
}
