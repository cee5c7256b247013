"""Queries over the cube and what is derived from it, with the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import analytics, cube
from tessera.plans.domain import AS_OF, DOMAIN_SQL, areas, licences
from tessera.plans.store import stored

HOUSE_TYPES = ("1-URGENT", "2-HIGH")
SINCE, BASE_DATE = "1996-01-01", "1997-01-01"


def _rounded(df, *columns, digits=6):
    """Rounded for comparison across engines; months as text."""
    months = {c: F.date_format(c, "yyyy-MM-dd") for c in df.columns if c == "year_month"}
    return df.withColumns({c: F.round(c, digits) for c in columns} | months)


def known(spark, sf_dir):
    return stored(spark, "areas", sf_dir, lambda: areas(spark, sf_dir))


def cube_base(spark, sf_dir):
    return stored(spark, "cube-base", sf_dir, lambda: cube.base(licences(spark, sf_dir), known(spark, sf_dir), HOUSE_TYPES))


def long_cube(spark, sf_dir):
    return stored(spark, "cube-long", sf_dir, lambda: cube.rank_in_context(cube.cumulative_metrics(cube_base(spark, sf_dir))))


def wide_cube(spark, sf_dir):
    return stored(spark, "cube-wide", sf_dir, lambda: cube.widen(long_cube(spark, sf_dir), SINCE))


def cube_facts(spark, sf_dir):
    """Sums of each measure by area pair and month."""
    return cube.explode_area_pairs(cube.licence_facts(licences(spark, sf_dir), HOUSE_TYPES), cube.MEASURES)


def cube_ranked(spark, sf_dir):
    """The whole cube: flagship query."""
    return _rounded(long_cube(spark, sf_dir), "value", "cumulative_value")


def cube_wide(spark, sf_dir):
    wide = wide_cube(spark, sf_dir)
    return _rounded(wide, *[c for c in wide.columns if "value_" in c])


def area_growth(spark, sf_dir):
    out = analytics.growth(wide_cube(spark, sf_dir), known(spark, sf_dir), AS_OF, 36, BASE_DATE)
    return _rounded(out, *[c for c in out.columns if "value_" in c], "growth_since_base", "inhabitants_per_al", "inhabitants_per_al_growth", "growth_c", "num_rooms_growth", "num_guests_growth")


def area_summary(spark, sf_dir):
    out = analytics.area_summary(wide_cube(spark, sf_dir), known(spark, sf_dir), AS_OF)
    return _rounded(out, "inhabitants_per_al", "al_per_1000", "al_count_growth_pcnt")


def distribution_skew(spark, sf_dir):
    out = analytics.distribution_skew(wide_cube(spark, sf_dir), known(spark, sf_dir), AS_OF)
    return _rounded(out, "locality_rank_pcnt", "total_al_pcnt", "total_population_pcnt", "prev_total_al_pcnt")


def room_distribution(spark, sf_dir):
    return _rounded(analytics.room_distribution(long_cube(spark, sf_dir), known(spark, sf_dir), AS_OF), "value")


def map_values(spark, sf_dir):
    """Localities with their values of the month, for a map."""
    wide = wide_cube(spark, sf_dir).where(F.col("year_month") == F.lit(AS_OF).cast("date"))
    joined = known(spark, sf_dir).where("admin_type = 'locality'").join(wide, F.col("osm_id") == F.col("area_id"))
    per = F.round(F.try_divide(F.col("population").cast("double"), F.nullif(F.col("cumulative_value_c"), F.lit(0.0))), 2)
    return joined.select(F.col("osm_id").cast("string").alias("id"), "name", "slug", "population", F.col("cumulative_value_c").alias("al_count"), F.col("country_rank_c").alias("rank_within_country"), per.alias("people_per_al"))


def metrics(spark, sf_dir):
    """The literal table of metrics, with what the cube holds of each: values, totals and the longest ranking."""
    held = long_cube(spark, sf_dir).groupBy("metric_name").agg(F.count("value").alias("months_with_value"), F.count("cumulative_value").alias("months_with_total"), F.max("rank_cumulative").alias("last_rank"))
    return held.join(F.broadcast(cube.metric_table(spark)), "metric_name", "right")


def conditional_totals(spark, sf_dir):
    return analytics.conditional_totals(licences(spark, sf_dir), AS_OF)


def ancestor_pairs(spark, sf_dir):
    return analytics.ancestors(areas(spark, sf_dir))


def area_table(spark, sf_dir):
    return areas(spark, sf_dir)


_M = list(cube.METRICS)
_LEVEL = {"locality": "locality", "municipality": "municipality", "region": "region", "country": "0::BIGINT"}
_sums = """count(*) AS c, sum(max_guests)::BIGINT AS num_guests, sum(rooms)::BIGINT AS num_rooms, sum(is_building_post_1951::INTEGER)::BIGINT AS is_building_post_1951,
  sum((rooms = 0)::INTEGER)::BIGINT AS rooms_0, sum((rooms = 1)::INTEGER)::BIGINT AS rooms_1, sum((rooms = 2)::INTEGER)::BIGINT AS rooms_2, sum((rooms = 3)::INTEGER)::BIGINT AS rooms_3,
  sum((rooms > 3)::INTEGER)::BIGINT AS rooms_more_than_3, sum((house_type = '1-URGENT')::INTEGER)::BIGINT AS is_moradia, sum((house_type = '2-HIGH')::INTEGER)::BIGINT AS is_apartamento"""
_facts = "\n UNION ALL ".join(
    f"SELECT '{a}' AS area_type, '{b}' AS context_area_type, {_LEVEL[a]} AS area_id, {_LEVEL[b]} AS context_area_id, year_month, {_sums} FROM licences GROUP BY 1, 2, 3, 4, 5" for a, b in cube.PAIRS
)
_lost = "\n UNION ALL ".join(
    f"SELECT '{a}' AS area_type, '{b}' AS context_area_type, {_LEVEL[a]} AS area_id, {_LEVEL[b]} AS context_area_id, lost_in_year_month AS year_month, count(*) AS lost_licenses "
    f"FROM licences WHERE lost_in_year_month IS NOT NULL GROUP BY 1, 2, 3, 4, 5"
    for a, b in cube.PAIRS
)
_stored = [m for m in _M if m != "al_per_1000"]


def _metric(m: str) -> str:
    if m == "c":
        value, total = "c::DOUBLE", "(run_c - run_lost_licenses)::DOUBLE"
    elif m == "al_per_1000":
        value, total = "1000.0::DOUBLE * c / nullif(population, 0)", "1000.0::DOUBLE * run_c / nullif(population, 0)"
    elif cube.METRICS[m] == "normal":
        value, total = f"{m}::DOUBLE", f"run_{m}::DOUBLE"
    else:
        value, total = f"{m}::DOUBLE / nullif(c, 0)", f"run_{m}::DOUBLE / nullif(run_c, 0)"
    return f"SELECT area_type, context_area_type, area_id, context_area_id, (year_month || '-01')::DATE AS year_month, '{m}' AS metric_name, {value} AS value, {total} AS cumulative_value FROM running"


CUBE_SQL = f"""WITH {DOMAIN_SQL}, facts AS ({_facts}), lost AS ({_lost}),
grid AS (SELECT area_type, context_area_type, area_id, context_area_id, m.year_month, population
  FROM (SELECT DISTINCT area_type, context_area_type, area_id, context_area_id FROM facts) p LEFT JOIN areas ON area_id = osm_id
  CROSS JOIN (SELECT DISTINCT year_month FROM facts) m),
dense AS (SELECT grid.*, {', '.join(f"coalesce({m}, 0)::BIGINT AS {m}" for m in _stored)} FROM grid
  LEFT JOIN facts USING (area_type, context_area_type, area_id, context_area_id, year_month) LEFT JOIN lost USING (area_type, context_area_type, area_id, context_area_id, year_month)),
running AS (SELECT *, {', '.join(f"sum({m}) OVER w AS run_{m}" for m in _stored)} FROM dense
  WINDOW w AS (PARTITION BY area_type, context_area_type, area_id, context_area_id ORDER BY year_month)),
long AS ({' UNION ALL '.join(_metric(m) for m in _M)}),
ranked AS MATERIALIZED (SELECT *, rank() OVER (PARTITION BY area_type, context_area_type, context_area_id, metric_name, year_month ORDER BY value DESC NULLS LAST)::INTEGER AS rank_month,
  rank() OVER (PARTITION BY area_type, context_area_type, context_area_id, metric_name, year_month ORDER BY cumulative_value DESC NULLS LAST)::INTEGER AS rank_cumulative FROM long),
wide AS MATERIALIZED (SELECT area_id, year_month, {', '.join(
    f"max(value) FILTER (metric_name = '{m}') AS value_{m}, max(cumulative_value) FILTER (metric_name = '{m}') AS cumulative_value_{m}, "
    + ', '.join(f"max(rank_cumulative) FILTER (metric_name = '{m}' AND context_area_type = '{t}') AS {t}_rank_{m}" for t in ('municipality', 'region', 'country')) for m in _M)}
  FROM ranked WHERE year_month >= '{SINCE}' GROUP BY area_id, year_month)"""

_now, _old = f"DATE '{AS_OF}'", f"(DATE '{AS_OF}' - INTERVAL 36 MONTH)::DATE"
ORACLE_SQL = {
    "cube_facts": f"WITH {DOMAIN_SQL}, facts AS ({_facts}) SELECT * FROM facts",
    "cube_ranked": f"{CUBE_SQL} SELECT * REPLACE (round(value, 6) AS value, round(cumulative_value, 6) AS cumulative_value, year_month::VARCHAR AS year_month) FROM ranked",
    "cube_wide": f"{CUBE_SQL} SELECT * REPLACE ({', '.join(f'round({v}_{m}, 6) AS {v}_{m}' for m in _M for v in ('value', 'cumulative_value'))}, year_month::VARCHAR AS year_month) FROM wide",
    "area_growth": f"""{CUBE_SQL} SELECT s.* REPLACE ({', '.join(f'round(s.{v}_{m}, 6) AS {v}_{m}' for m in _M for v in ('value', 'cumulative_value'))}, s.year_month::VARCHAR AS year_month), round(s.cumulative_value_c / nullif(b.cumulative_value_c, 0), 6) AS growth_since_base,
  round(1000.0::DOUBLE / nullif(s.cumulative_value_al_per_1000, 0), 6) AS inhabitants_per_al,
  round((1000.0::DOUBLE / nullif(s.cumulative_value_al_per_1000, 0)) / nullif(1000.0::DOUBLE / nullif(o.cumulative_value_al_per_1000, 0), 0) - 1, 6) AS inhabitants_per_al_growth,
  round(s.cumulative_value_c / nullif(o.cumulative_value_c, 0) - 1, 6) AS growth_c,
  (s.region_rank_al_per_1000 - o.region_rank_al_per_1000)::BIGINT AS region_rank_al_per_1000_change, (s.region_rank_c - o.region_rank_c)::BIGINT AS region_rank_change_c,
  (s.country_rank_c - o.country_rank_c)::BIGINT AS country_rank_change_c, (s.municipality_rank_c - o.municipality_rank_c)::BIGINT AS municipality_rank_change_c,
  round(s.cumulative_value_num_rooms / nullif(o.cumulative_value_num_rooms, 0) - 1, 6) AS num_rooms_growth,
  round(s.cumulative_value_num_guests / nullif(o.cumulative_value_num_guests, 0), 6) AS num_guests_growth, a.name, a.slug, a.admin_type, a.parent_id, a.municipality_slug, a.region_slug
FROM wide s JOIN wide o ON s.area_id = o.area_id AND o.year_month = {_old} JOIN wide b ON s.area_id = b.area_id AND b.year_month = DATE '{BASE_DATE}'
JOIN areas a ON a.osm_id = s.area_id WHERE s.year_month = {_now}""",
    "area_summary": f"""{CUBE_SQL}, years AS (SELECT area_id, {', '.join(f"max({c}) FILTER (year_month = {d}) AS {n}_{t}" for c, n in (('cumulative_value_c', 'c'), ('country_rank_c', 'place'), ('cumulative_value_al_per_1000', 'per')) for d, t in ((_now, 'now'), (_old, 'old')))},
  bool_or(year_month = {_now}) AS is_here FROM wide GROUP BY area_id)
SELECT up.slug AS direct_parent_slug, me.municipality_slug AS ancestor_municipality_slug, me.region_slug AS ancestor_region_slug, concat('/areas/', me.slug) AS area_url, me.name AS area_name,
  me.slug AS area_slug, me.admin_type, c_now AS al_count, round(1000.0::DOUBLE / nullif(per_now, 0), 6) AS inhabitants_per_al, round(per_now, 6) AS al_per_1000, place_now AS rank_within_country,
  round((c_now - c_old) / nullif(c_old, 0), 6) AS al_count_growth_pcnt, (place_old - place_now)::BIGINT AS rank_within_country_change
FROM years JOIN areas me ON me.osm_id = years.area_id LEFT JOIN areas up ON up.osm_id = me.parent_id WHERE is_here""",
    "distribution_skew": f"""{CUBE_SQL}, month AS (SELECT area_id, cumulative_value_c AS al FROM wide WHERE year_month = {_now}),
member AS (SELECT slug, population, al, area_id IS NOT NULL AS counts, unnest([municipality_slug, region_slug, 'portugal']) AS part_of FROM areas LEFT JOIN month ON area_id = osm_id WHERE admin_type = 'locality'),
whole AS (SELECT part_of, count(*) AS members, sum(population) AS people, sum(al) AS members_al FROM member GROUP BY part_of),
named AS (SELECT whole.*, 'Portugal' AS name, members_al AS all_al FROM whole WHERE part_of = 'portugal'
  UNION ALL SELECT whole.*, areas.name, month.al FROM whole JOIN areas ON areas.slug = part_of AND admin_type <> 'locality' LEFT JOIN month ON area_id = osm_id),
place AS (SELECT me.part_of, me.slug, count(*) FILTER (you.al > me.al OR you.slug <= me.slug) AS nth, sum(you.al) AS al, sum(you.population) AS people
  FROM member me JOIN member you ON me.part_of = you.part_of AND you.al >= me.al WHERE me.counts AND you.counts GROUP BY me.part_of, me.slug),
crossed AS (SELECT b.part_of, b.nth, min(percent) AS percent FROM place a JOIN place b ON a.part_of = b.part_of AND a.nth + 1 = b.nth JOIN named n ON n.part_of = b.part_of
  JOIN (VALUES (50), (66), (75), (90)) v(percent) ON a.al / nullif(n.all_al, 0) < percent / 100 AND b.al / nullif(n.all_al, 0) >= percent / 100 GROUP BY b.part_of, b.nth)
SELECT name, part_of AS slug, b.nth::INTEGER AS locality_rank, round(b.nth / members, 6) AS locality_rank_pcnt, round(b.al / nullif(all_al, 0), 6) AS total_al_pcnt,
  round(b.people / nullif(n.people, 0), 6) AS total_population_pcnt, round(a.al / nullif(all_al, 0), 6) AS prev_total_al_pcnt, percent::VARCHAR AS threshold
FROM crossed JOIN place b USING (part_of, nth) JOIN place a ON a.part_of = crossed.part_of AND a.nth = crossed.nth - 1 JOIN named n ON n.part_of = crossed.part_of""",
    "room_distribution": f"""{CUBE_SQL.replace('WITH', 'WITH RECURSIVE', 1)}, above AS (SELECT osm_id AS group_id, osm_id AS area_id, parent_id AS following FROM areas
  UNION ALL SELECT group_id, osm_id, parent_id FROM above JOIN areas ON osm_id = following)
SELECT me.slug, me.name, g.group_id, label AS metric_name, category AS room_category, round(r.cumulative_value, 6) AS value, g.area_id, r.area_type AS admin_type,
  list_position(['locality', 'municipality', 'region', 'country'], r.area_type) AS area_level
FROM (SELECT group_id, area_id FROM above UNION ALL SELECT osm_id, 0 FROM areas) g JOIN areas me ON me.osm_id = g.group_id JOIN ranked r ON r.area_id = g.area_id
JOIN (VALUES {', '.join(f"('{m}', {n}, '{label}')" for m, (n, label) in analytics.ROOM_CATEGORIES.items())}) v(metric, category, label) ON r.metric_name = metric
WHERE r.context_area_type = 'country' AND r.year_month = {_now}""",
    "map_values": f"""{CUBE_SQL} SELECT osm_id::VARCHAR AS id, name, slug, population, cumulative_value_c AS al_count, country_rank_c AS rank_within_country,
  round(population::DOUBLE / nullif(cumulative_value_c, 0), 2) AS people_per_al FROM areas JOIN wide ON osm_id = area_id WHERE admin_type = 'locality' AND year_month = {_now}""",
    "conditional_totals": f"""WITH {DOMAIN_SQL} SELECT {', '.join(f"count(*) FILTER ({c} = '2001-08') AS {n}_month, count(*) FILTER ({c}[1:4] = '2001' AND {c} <= '2001-08') AS {n}_year, count(*) FILTER ({c}[1:4] = '2000') AS {n}_last_year"
  for n, c in (('new', 'year_month'), ('lost', 'lost_in_year_month')))} FROM licences""",
    "metrics": f"""{CUBE_SQL} SELECT metric_name, aggregation, count(value) AS months_with_value, count(cumulative_value) AS months_with_total, max(rank_cumulative) AS last_rank
FROM (VALUES {', '.join(str(x) for x in cube.METRICS.items())}) v(metric_name, aggregation) LEFT JOIN ranked USING (metric_name) GROUP BY ALL""",
    "ancestor_pairs": f"""WITH {DOMAIN_SQL} SELECT osm_id AS group_id, osm_id AS area_id, 0 AS depth FROM areas UNION ALL SELECT osm_id, parent_id, 1 FROM areas WHERE parent_id IS NOT NULL
  UNION ALL SELECT a.osm_id, p.parent_id, 2 FROM areas a JOIN areas p ON a.parent_id = p.osm_id WHERE p.parent_id IS NOT NULL UNION ALL SELECT osm_id, 0, 99 FROM areas""",
    "area_table": f"WITH {DOMAIN_SQL} SELECT * FROM areas",
}
QUERIES = {f.__name__: f for f in (cube_facts, cube_ranked, cube_wide, area_growth, area_summary, distribution_skew, room_distribution, map_values, conditional_totals, metrics, ancestor_pairs, area_table)}
