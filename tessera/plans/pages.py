"""The statements of the report's pages: parameterised reads of the marts, in the order and up to the number that a page shows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import analytics, relational
from tessera.plans import marts
from tessera.plans.domain import AS_OF

SLUG, REGION, COUNTRY = "nation_3", "region_3", 0
TABLE = ("area_url", "area_name", "al_count", "inhabitants_per_al", "al_per_1000", "rank_within_country", "al_count_growth_pcnt", "rank_within_country_change")


def _month(as_of: str):
    return F.trunc(F.lit(as_of).cast("date"), "MM")


def _own(known: DataFrame, slug: str, column: str = "osm_id", alias: str = "area_id") -> DataFrame:
    return known.where(F.col("slug") == slug).select(F.col(column).alias(alias))


def _of_area(wide: DataFrame, known: DataFrame, slug: str | None) -> DataFrame:
    """The rows of an area, or of the country."""
    return wide.where(F.col("area_id") == COUNTRY) if slug is None else wide.join(_own(known, slug), "area_id", "left_semi")


def total(wide: DataFrame) -> DataFrame:
    return wide.where(F.col("area_id") == COUNTRY).agg(F.max("cumulative_value_c").alias("num_al"))


def lost_totals(wide: DataFrame, known: DataFrame, slug: str | None, as_of: str) -> DataFrame:
    """Lost licences in the month, the year, and the year before."""
    month, year = F.col("year_month"), F.year(_month(as_of))
    lost = lambda name, cond: F.sum(F.when(cond, F.col("value_lost_licenses")).otherwise(0.0)).alias(name)
    return _of_area(wide, known, slug).agg(lost("last_month_lost", month == _month(as_of)), lost("ytd_lost", F.year(month) == year), lost("last_year_total", F.year(month) == year - 1))


def lost_by_month(wide: DataFrame, known: DataFrame, slug: str | None) -> DataFrame:
    rows = _of_area(wide, known, slug).where("value_lost_licenses > 0").select("year_month", F.col("value_lost_licenses").alias("monthly_lost"), F.col("cumulative_value_lost_licenses").alias("total_lost"))
    return rows.orderBy("year_month")


def skew_at(skew: DataFrame, slug: str, threshold: str = "50") -> DataFrame:
    return skew.where((F.col("slug") == slug) & (F.col("threshold") == threshold))


def areas_table(summary: DataFrame, kind: str, *columns: str, slug: str | None = None) -> DataFrame:
    """The table of all areas of a kind, or of those with the slug in one of the columns; largest first."""
    rows = summary.where(F.col("admin_type") == kind)
    if slug is not None:
        rows = rows.where(reduce(lambda a, b: a | b, [F.col(c) == slug for c in columns]))
    return rows.select(*TABLE).orderBy(F.desc("al_count"), "area_url")


def own_rooms(rooms: DataFrame, known: DataFrame, kind: str, slug_column: str | None = None, slug: str | None = None) -> DataFrame:
    """Areas' own shares of room numbers."""
    rows = rooms.where((F.col("group_id") == F.col("area_id")) & (F.col("admin_type") == kind))
    if slug is None:
        return rows
    return rows.join(known.where(F.col(slug_column) == slug).select(F.col("osm_id").alias("area_id")), "area_id", "left_semi")


def breadcrumb_text(known: DataFrame, slug: str, root: str = "Portugal") -> DataFrame:
    """An area's ancestors and itself in one text, from the top."""
    up = analytics.ancestors(known, 3, None).join(_own(known, slug, alias="group_id"), "group_id", "left_semi")
    names = up.join(known.select(F.col("osm_id").alias("area_id"), "name"), "area_id").withColumn("place", -F.col("depth"))
    path = F.transform(F.sort_array(F.collect_list(F.struct("place", "name"))), lambda p: p["name"])
    return names.groupBy("group_id").agg(F.concat(F.lit(f"{root} > "), F.array_join(path, " > ")).alias("breadcrumb")).select("breadcrumb")


def area_info(known: DataFrame, slug: str) -> DataFrame:
    return relational.first_rows(known.where(F.col("slug") == slug), [F.col("osm_id")])


def level_stats(wide: DataFrame, known: DataFrame, slug: str, as_of: str) -> DataFrame:
    """All areas of the area's type in the month."""
    same = known.join(_own(known, slug, "admin_type", "admin_type"), "admin_type", "left_semi").select(F.col("osm_id").alias("area_id"))
    per = F.try_divide(F.lit(1000.0), F.nullif(F.col("cumulative_value_al_per_1000"), F.lit(0.0)))
    return wide.where(F.col("year_month") == _month(as_of)).join(same, "area_id", "left_semi").select("cumulative_value_c", "country_rank_c", per.alias("inhabitants_per_al"), "country_rank_al_per_1000")


def _growth(wide: DataFrame, names: DataFrame, as_of: str, months_back: int) -> DataFrame:
    """names (area_id, area_name, ord) -> their counts over those of the base month, by month."""
    base = wide.where(F.col("year_month") == F.add_months(_month(as_of), -months_back)).select("area_id", F.nullif(F.col("cumulative_value_c"), F.lit(0.0)).alias("base"))
    rows = wide.select("area_id", "year_month", "cumulative_value_c").join(names, "area_id").join(base, "area_id")
    return rows.orderBy("ord", "area_name", "year_month").select("area_name", "year_month", F.try_divide("cumulative_value_c", "base").alias("growth_since_base"))


def growth_of_chain(wide: DataFrame, known: DataFrame, slug: str, as_of: str, months_back: int) -> DataFrame:
    """Growth of an area, its ancestors and the country since a base month."""
    up = analytics.ancestors(known, 3, None).join(_own(known, slug, alias="group_id"), "group_id", "left_semi")
    named = up.join(known.select(F.col("osm_id").alias("area_id"), F.col("name").alias("area_name")), "area_id").select("area_id", "area_name", F.col("depth").alias("ord"))
    country = known.sparkSession.createDataFrame([(COUNTRY, "Portugal", 99)], "area_id long, area_name string, ord int")
    return _growth(wide, named.unionByName(country), as_of, months_back)


def _parts(known: DataFrame, slug: str) -> DataFrame:
    return known.join(_own(known, slug, alias="parent_id"), "parent_id", "left_semi").select(F.col("osm_id").alias("area_id"), F.col("name").alias("area_name"), F.lit(0).alias("ord"))


def growth_of_parts(wide: DataFrame, known: DataFrame, slug: str, as_of: str, months_back: int) -> DataFrame:
    return _growth(wide, _parts(known, slug), as_of, months_back)


def series_of_parts(wide: DataFrame, known: DataFrame, slug: str) -> DataFrame:
    rows = wide.select("area_id", "year_month", F.col("cumulative_value_c").alias("total")).join(_parts(known, slug), "area_id")
    return rows.orderBy("area_name", "year_month").select(F.col("area_name").alias("name"), "year_month", "total")


def map_ranks(values: DataFrame) -> DataFrame:
    """Localities of a map with their place by people per licence; the partition is that of one country's localities in a month."""
    order = W.partitionBy("country").orderBy(F.asc_nulls_last("people_per_al"))
    ranked = values.withColumn("country", F.lit(COUNTRY)).withColumn("people_per_al_rank", F.rank().over(order)).drop("country")
    return ranked.withColumn("link", F.concat(F.lit("../areas/"), F.col("slug")))


def _wide(spark, sf_dir):
    return marts.wide_cube(spark, sf_dir)


_MAKE = {
    "page_total": lambda s, d: total(_wide(s, d)),
    "page_lost_totals": lambda s, d: lost_totals(_wide(s, d), marts.known(s, d), None, AS_OF),
    "page_lost_by_month": lambda s, d: lost_by_month(_wide(s, d), marts.known(s, d), None),
    "page_skew": lambda s, d: skew_at(marts.distribution_skew(s, d), "portugal"),
    "page_regions": lambda s, d: areas_table(marts.area_summary(s, d), "region"),
    "page_region_rooms": lambda s, d: own_rooms(marts.room_distribution(s, d), marts.known(s, d), "region"),
    "page_map": lambda s, d: map_ranks(marts.map_values(s, d)),
    "page_area_breadcrumb": lambda s, d: breadcrumb_text(marts.known(s, d), SLUG),
    "page_area_info": lambda s, d: area_info(marts.known(s, d), SLUG),
    "page_area_growth": lambda s, d: marts.area_growth(s, d).where(F.col("slug") == SLUG),
    "page_area_level": lambda s, d: level_stats(_wide(s, d), marts.known(s, d), SLUG, AS_OF),
    "page_area_skew": lambda s, d: skew_at(marts.distribution_skew(s, d), REGION, "75"),
    "page_area_rooms": lambda s, d: marts.room_distribution(s, d).where(F.col("slug") == SLUG),
    "page_area_lost_totals": lambda s, d: lost_totals(_wide(s, d), marts.known(s, d), SLUG, AS_OF),
    "page_area_lost_by_month": lambda s, d: lost_by_month(_wide(s, d), marts.known(s, d), SLUG),
    "page_area_growth_chain": lambda s, d: growth_of_chain(_wide(s, d), marts.known(s, d), SLUG, AS_OF, 24),
    "page_parts_growth": lambda s, d: growth_of_parts(_wide(s, d), marts.known(s, d), REGION, AS_OF, 24),
    "page_parts_series": lambda s, d: series_of_parts(_wide(s, d), marts.known(s, d), REGION),
    "page_municipalities": lambda s, d: areas_table(marts.area_summary(s, d), "municipality", "direct_parent_slug", slug=REGION),
    "page_localities": lambda s, d: areas_table(marts.area_summary(s, d), "locality", "ancestor_region_slug", "ancestor_municipality_slug", slug=REGION),
    "page_parts_rooms": lambda s, d: own_rooms(marts.room_distribution(s, d), marts.known(s, d), "municipality", "region_slug", REGION),
}


def _comparable(make):
    """Rounded, with months as text."""

    def run(spark, sf_dir):
        df = make(spark, sf_dir)
        rounded = {c: F.round(c, 6) for c, kind in df.dtypes if kind == "double"}
        return df.withColumns(rounded | {c: F.date_format(c, "yyyy-MM-dd") for c, kind in df.dtypes if kind == "date"})

    return run


QUERIES = {name: _comparable(make) for name, make in _MAKE.items()}


def _from(name: str, then: str) -> str:
    """SQL that reads the rows of another query."""
    return f"SELECT {then.replace('FROM it', f'FROM ({marts.ORACLE_SQL[name]}) it')}"


_area = f"area_id = (SELECT osm_id FROM areas WHERE slug = '{SLUG}')"
_lost = "sum(CASE WHEN year_month = DATE '{d}' THEN value_lost_licenses ELSE 0 END) AS last_month_lost, sum(CASE WHEN year(year_month) = year(DATE '{d}') THEN value_lost_licenses ELSE 0 END) AS ytd_lost, sum(CASE WHEN year(year_month) = year(DATE '{d}') - 1 THEN value_lost_licenses ELSE 0 END) AS last_year_total FROM wide".format(d=AS_OF)
_by_month = "SELECT year_month::VARCHAR AS year_month, value_lost_licenses AS monthly_lost, cumulative_value_lost_licenses AS total_lost FROM wide WHERE value_lost_licenses > 0"
_table = ", ".join(TABLE)
_base = f"wide b ON b.area_id = w.area_id AND b.year_month = (DATE '{AS_OF}' - INTERVAL 24 MONTH)::DATE"
_ratio = "w.year_month::VARCHAR AS year_month, round(w.cumulative_value_c / nullif(b.cumulative_value_c, 0), 6) AS growth_since_base"
_parent = f"a.parent_id = (SELECT osm_id FROM areas WHERE slug = '{REGION}')"
ORACLE_SQL = {
    "page_total": f"{marts.CUBE_SQL} SELECT max(cumulative_value_c) AS num_al FROM wide WHERE area_id = 0",
    "page_lost_totals": f"{marts.CUBE_SQL} SELECT {_lost} WHERE area_id = 0",
    "page_lost_by_month": f"{marts.CUBE_SQL} {_by_month} AND area_id = 0 ORDER BY 1",
    "page_skew": _from("distribution_skew", "* FROM it WHERE slug = 'portugal' AND threshold = '50'"),
    "page_regions": _from("area_summary", f"{_table} FROM it WHERE admin_type = 'region' ORDER BY al_count DESC"),
    "page_region_rooms": _from("room_distribution", "* FROM it WHERE group_id = area_id AND admin_type = 'region'"),
    "page_map": _from("map_values", "*, rank() OVER (ORDER BY people_per_al NULLS LAST)::INTEGER AS people_per_al_rank, '../areas/' || slug AS link FROM it"),
    "page_area_breadcrumb": f"{marts.CUBE_SQL} SELECT 'Portugal > ' || p.name || ' > ' || a.name AS breadcrumb FROM areas a JOIN areas p ON a.parent_id = p.osm_id WHERE a.slug = '{SLUG}'",
    "page_area_info": f"{marts.CUBE_SQL} SELECT * FROM areas WHERE slug = '{SLUG}' LIMIT 1",
    "page_area_growth": _from("area_growth", f"* FROM it WHERE slug = '{SLUG}'"),
    "page_area_level": f"""{marts.CUBE_SQL} SELECT cumulative_value_c, country_rank_c, round(1000.0::DOUBLE / nullif(cumulative_value_al_per_1000, 0), 6) AS inhabitants_per_al, country_rank_al_per_1000
  FROM wide JOIN areas ON area_id = osm_id WHERE year_month = DATE '{AS_OF}' AND admin_type = (SELECT admin_type FROM areas WHERE slug = '{SLUG}')""",
    "page_area_skew": _from("distribution_skew", f"* FROM it WHERE slug = '{REGION}' AND threshold = '75'"),
    "page_area_rooms": _from("room_distribution", f"* FROM it WHERE slug = '{SLUG}'"),
    "page_area_lost_totals": f"{marts.CUBE_SQL} SELECT {_lost} WHERE {_area}",
    "page_area_lost_by_month": f"{marts.CUBE_SQL} {_by_month} AND {_area} ORDER BY 1",
    "page_area_growth_chain": f"""{marts.CUBE_SQL}, line AS (SELECT osm_id, name FROM areas WHERE slug = '{SLUG}' OR osm_id = (SELECT parent_id FROM areas WHERE slug = '{SLUG}') UNION ALL SELECT 0, 'Portugal')
SELECT name AS area_name, {_ratio} FROM line JOIN wide w ON w.area_id = osm_id JOIN {_base}""",
    "page_parts_growth": f"{marts.CUBE_SQL} SELECT name AS area_name, {_ratio} FROM areas a JOIN wide w ON w.area_id = a.osm_id JOIN {_base} WHERE {_parent}",
    "page_parts_series": f"{marts.CUBE_SQL} SELECT name, year_month::VARCHAR AS year_month, cumulative_value_c AS total FROM areas a JOIN wide ON area_id = osm_id WHERE {_parent}",
    "page_municipalities": _from("area_summary", f"{_table} FROM it WHERE admin_type = 'municipality' AND direct_parent_slug = '{REGION}'"),
    "page_localities": _from("area_summary", f"{_table} FROM it WHERE admin_type = 'locality' AND (ancestor_region_slug = '{REGION}' OR ancestor_municipality_slug = '{REGION}')"),
    "page_parts_rooms": _from("room_distribution", f"* FROM it WHERE group_id = area_id AND admin_type = 'municipality' AND area_id IN (SELECT 1000 + n_nationkey FROM nation WHERE n_regionkey = 3)"),
}
