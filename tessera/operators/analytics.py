"""Analytics over the wide and long cube. `as_of` is the month to report on; nothing reads the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.fixpoint import ancestors_of
from tessera.operators.prefix import over_ranges
from tessera.operators.relational import equal_or_both_missing
from tessera.plans.store import written


def _month(as_of: str) -> Column:
    return F.trunc(F.lit(as_of).cast("date"), "MM")


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


def growth(wide: DataFrame, areas: DataFrame, as_of: str, months_back: int = 36, base_date: str = "2015-01-01") -> DataFrame:
    """Three slices of the wide cube (now, months_back ago, base_date) joined on the area."""
    now = wide.where(F.col("year_month") == _month(as_of)).alias("s")
    old = wide.where(F.col("year_month") == F.add_months(_month(as_of), -months_back)).alias("o")
    base = wide.where(F.col("year_month") == F.lit(base_date).cast("date")).alias("b")
    c, per = "cumulative_value_c", "cumulative_value_al_per_1000"
    change = lambda name: (F.col(f"s.{name}") - F.col(f"o.{name}")).cast("long")
    joined = now.join(old, F.col("s.area_id") == F.col("o.area_id")).join(base, F.col("s.area_id") == F.col("b.area_id"))
    joined = joined.join(areas.alias("a"), F.col("s.area_id") == F.col("a.osm_id"))
    inhabitants = lambda t: _ratio(F.lit(1000.0), F.col(f"{t}.{per}"))
    return joined.select(
        F.col("s.*"),
        _ratio(F.col(f"s.{c}"), F.col(f"b.{c}")).alias("growth_since_base"),
        inhabitants("s").alias("inhabitants_per_al"),
        (_ratio(inhabitants("s"), inhabitants("o")) - 1).alias("inhabitants_per_al_growth"),
        (_ratio(F.col(f"s.{c}"), F.col(f"o.{c}")) - 1).alias("growth_c"),
        change("region_rank_al_per_1000").alias("region_rank_al_per_1000_change"),
        change("region_rank_c").alias("region_rank_change_c"),
        change("country_rank_c").alias("country_rank_change_c"),
        change("municipality_rank_c").alias("municipality_rank_change_c"),
        (_ratio(F.col("s.cumulative_value_num_rooms"), F.col("o.cumulative_value_num_rooms")) - 1).alias("num_rooms_growth"),
        _ratio(F.col("s.cumulative_value_num_guests"), F.col("o.cumulative_value_num_guests")).alias("num_guests_growth"),
        *[F.col(f"a.{c}") for c in ("name", "slug", "admin_type", "parent_id", "municipality_slug", "region_slug")],
    )


def area_summary(wide: DataFrame, areas: DataFrame, as_of: str, months_back: int = 36) -> DataFrame:
    """One row for each area in the month of as_of, with its change since months_back. Areas are matched null-safely."""
    rows = wide.join(areas, wide.area_id == areas.osm_id)
    parent = F.when(F.col("admin_type") == "locality", F.col("municipality_slug")).when(F.col("admin_type") == "municipality", F.col("region_slug"))
    monthly = rows.select(
        parent.alias("direct_parent_slug"), F.col("municipality_slug").alias("ancestor_municipality_slug"), F.col("region_slug").alias("ancestor_region_slug"),
        F.concat(F.lit("/areas/"), F.col("slug")).alias("area_url"), F.col("name").alias("area_name"), F.col("slug").alias("area_slug"), "admin_type", "year_month",
        F.col("cumulative_value_c").alias("al_count"), _ratio(F.lit(1000.0), F.col("cumulative_value_al_per_1000")).alias("inhabitants_per_al"),
        F.col("cumulative_value_al_per_1000").alias("al_per_1000"), F.col("country_rank_c").alias("rank_within_country"),
    )
    keys = ["area_slug", "direct_parent_slug", "ancestor_municipality_slug", "ancestor_region_slug"]
    latest = monthly.where(F.col("year_month") == _month(as_of)).drop("year_month").alias("l")
    before = monthly.where(F.col("year_month") == F.add_months(_month(as_of), -months_back)).select(*keys, "al_count", "rank_within_country").alias("p")
    on = F.col("l.area_slug") == F.col("p.area_slug")
    for k in keys[1:]:
        on &= F.col(f"l.{k}").eqNullSafe(F.col(f"p.{k}"))
    return latest.join(before, on, "left").select(
        "l.*",
        _ratio(F.col("l.al_count") - F.col("p.al_count"), F.col("p.al_count")).alias("al_count_growth_pcnt"),
        (F.col("p.rank_within_country") - F.col("l.rank_within_country")).cast("long").alias("rank_within_country_change"),
    )


def distribution_skew(wide: DataFrame, areas: DataFrame, as_of: str, thresholds: tuple[int, ...] = (50, 66, 75, 90)) -> DataFrame:
    """For each region, municipality and the country: the locality with which the running share of licences, from the
    largest locality on, passes each threshold. Localities meet their ancestors through an explode and an equi-join."""
    stats = wide.where(F.col("year_month") == _month(as_of)).select("area_id", F.col("cumulative_value_c").alias("num_al"))
    known = areas.join(stats, areas.osm_id == stats.area_id, "left").select("osm_id", "name", "slug", "admin_type", "municipality_slug", "region_slug", "population", "num_al", "area_id")
    localities = known.where("admin_type = 'locality'")
    above = localities.select("osm_id", "slug", "num_al", "population", "area_id", F.explode(F.array_distinct(F.array("municipality_slug", "region_slug", F.lit("portugal")))).alias("top"))
    sums = above.groupBy("top").agg(F.sum("population").alias("top_population"), F.count(F.lit(1)).alias("num_localities"), F.sum("num_al").alias("sum_al"))
    tops = known.where("admin_type IN ('region', 'municipality')").select(F.col("slug").alias("top"), "name", F.col("num_al").alias("top_al"))
    groups = sums.join(tops, "top", "left").select(
        "top", F.coalesce("name", F.when(F.col("top") == "portugal", "Portugal")).alias("name"), "num_localities", "top_population",
        F.when(F.col("top") == "portugal", F.col("sum_al")).otherwise(F.col("top_al")).alias("top_al"),
    )
    rows = written(above.where("area_id IS NOT NULL").join(groups, "top"), "localities")
    # The country holds all localities, so running sums go over ranges: one row a size, then one row a place.
    sizes = rows.groupBy("top", "num_al").agg(F.sum("num_al").alias("al"), F.sum("population").alias("people"))
    sizes = over_ranges(sizes, ["top"], [F.desc_nulls_last("num_al")], sums={"upto_al": F.col("al"), "upto_people": F.col("people")})
    rows = equal_or_both_missing(rows, sizes.select("top", "num_al", "upto_al", "upto_people"), ["top", "num_al"])
    share = _ratio(F.col("upto_al"), F.col("top_al"))
    places = rows.select("top", "num_al", "slug", share.alias("share")).distinct()
    places = over_ranges(places, ["top"], [F.desc_nulls_last("num_al"), F.col("slug")], sums={"locality_rank": F.lit(1)}, before={"prev_total_al_pcnt": F.col("share")})
    rows = equal_or_both_missing(rows, places.drop("share"), ["top", "num_al", "slug"])
    ranked = rows.select(
        "name", F.col("top").alias("slug"), F.col("locality_rank").cast("int").alias("locality_rank"), (F.col("locality_rank") / F.col("num_localities")).alias("locality_rank_pcnt"),
        share.alias("total_al_pcnt"), _ratio(F.col("upto_people"), F.col("top_population")).alias("total_population_pcnt"), "prev_total_al_pcnt",
    )
    passed = None
    for t in thresholds:
        hit = (F.col("total_al_pcnt") >= t / 100) & (F.col("prev_total_al_pcnt") < t / 100)
        passed = F.when(hit, str(t)) if passed is None else passed.when(hit, str(t))
    return ranked.withColumn("threshold", passed).where("threshold IS NOT NULL")


def ancestors(areas: DataFrame, max_depth: int | None = None, root: tuple[int, str, str] | None = (0, "country", "portugal")) -> DataFrame:
    """(group_id, area_id, depth): each area with itself, its ancestors, and the root. Areas that lie in each other are each other's
    ancestors. Where max_depth is given, areas nested deeper are an error, at once and not when rows are read."""
    own = areas.select(F.col("osm_id").alias("group_id"), F.col("osm_id").alias("area_id"), F.lit(0).alias("depth"))
    above = ancestors_of(areas.select(F.col("osm_id").alias("child"), F.col("parent_id").alias("parent")), max_depth)
    out = own.unionByName(above.select(F.col("node").alias("group_id"), F.col("ancestor").alias("area_id"), "depth"))
    if root:
        out = out.unionByName(areas.select(F.col("osm_id").alias("group_id"), F.lit(root[0]).cast("long").alias("area_id"), F.lit(99).alias("depth")))
    return out


#: Metric -> (category, description). Fixed values, in order.
ROOM_CATEGORIES = {
    "rooms_0": (1, "0 rooms"),
    "rooms_1": (2, "1 room"),
    "rooms_2": (3, "2 rooms"),
    "rooms_3": (4, "3 rooms"),
    "rooms_more_than_3": (5, "More than 3 rooms"),
}


def room_distribution(long: DataFrame, areas: DataFrame, as_of: str) -> DataFrame:
    """Shares of room numbers for each area beside those of its ancestors and the country."""
    values = long.where((F.col("year_month") == _month(as_of)) & (F.col("context_area_type") == "country") & F.col("metric_name").isin(*ROOM_CATEGORIES))
    lookup = F.create_map(*[F.lit(x) for m, (n, text) in ROOM_CATEGORIES.items() for x in (m, n)])
    names = F.create_map(*[F.lit(x) for m, (n, text) in ROOM_CATEGORIES.items() for x in (m, text)])
    values = values.select("area_id", "area_type", lookup[F.col("metric_name")].alias("room_category"), names[F.col("metric_name")].alias("metric_name"), F.col("cumulative_value").alias("value"))
    groups = ancestors(areas).select("group_id", "area_id").join(areas.select(F.col("osm_id").alias("group_id"), "slug", "name"), "group_id")
    level = F.element_at(F.create_map(*[F.lit(x) for p in zip(("locality", "municipality", "region", "country"), range(1, 5)) for x in p]), F.col("area_type"))
    return groups.join(values, "area_id").select("slug", "name", "group_id", "metric_name", "room_category", "value", "area_id", F.col("area_type").alias("admin_type"), level.alias("area_level"))


def conditional_totals(licences: DataFrame, as_of: str) -> DataFrame:
    """Registrations and losses in the month of as_of, its year so far, and the year before, in one pass."""
    month = F.date_format(_month(as_of), "yyyy-MM")
    year, last = F.substring(month, 1, 4), F.date_format(F.add_months(_month(as_of), -12), "yyyy")
    count = lambda c, cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).alias(c)
    out = []
    for name, col in (("new", "year_month"), ("lost", "lost_in_year_month")):
        m = F.col(col)
        out += [count(f"{name}_month", m == month), count(f"{name}_year", (F.substring(m, 1, 4) == year) & (m <= month)), count(f"{name}_last_year", F.substring(m, 1, 4) == last)]
    return licences.agg(*out)


def lost_licences(snapshots: DataFrame, id_col: str, ts_col: str, exact: bool = False) -> DataFrame:
    """Licences that a snapshot no longer has: id, last_seen, lost_in (the next snapshot).

    By default the timeline is of snapshots in which some licence was last seen, and a licence is lost once: after its last
    one. With exact=True every snapshot counts and each disappearance is a row, also of licences that come back.
    """
    seen = snapshots.select(F.col(id_col).alias("id"), F.col(ts_col).alias("at")).distinct()
    if not exact:
        seen = seen.groupBy("id").agg(F.max("at").alias("at"))
    times = seen.select("at").distinct()
    following = over_ranges(times, [], [F.col("at")], after={"lost_in": F.col("at")}).where("lost_in IS NOT NULL")
    gone = seen.join(following, "at")
    if exact:
        gone = gone.join(seen.select("id", F.col("at").alias("lost_in")), ["id", "lost_in"], "left_anti")
    return gone.select("id", F.col("at").alias("last_seen"), "lost_in")
