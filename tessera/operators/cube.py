"""The dense cube of metrics by (area, context area, month): running totals, ranks, and its wide form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Pairs of (area type, context area type). Fixed values, in order.
PAIRS = (
    ("locality", "municipality"),
    ("locality", "region"),
    ("locality", "country"),
    ("municipality", "region"),
    ("municipality", "country"),
    ("region", "country"),
    ("country", "country"),
)
#: Metrics and how they come about: "normal" as they are, others divided by the count `c`. Fixed values; the order is
#: that of the wide form's columns.
METRICS = {
    "c": "normal",
    "al_per_1000": "normal",
    "num_guests": "average",
    "num_rooms": "average",
    "is_building_post_1951": "pcnt",
    "rooms_0": "pcnt",
    "rooms_1": "pcnt",
    "rooms_2": "pcnt",
    "rooms_3": "pcnt",
    "rooms_more_than_3": "pcnt",
    "is_moradia": "pcnt",
    "is_apartamento": "pcnt",
    "lost_licenses": "normal",
}
MEASURES = tuple(m for m in METRICS if m not in ("al_per_1000", "lost_licenses"))
KEYS = ("area_type", "context_area_type", "area_id", "context_area_id")
LEVELS = ("locality", "municipality", "region")


def licence_facts(licences: DataFrame, house_types: tuple[str, str]) -> DataFrame:
    """Sums of each measure by (locality, municipality, region, month): one shuffle of the licences, before any fan-out."""
    is_in = lambda cond: F.sum(cond.cast("int")).cast("long")
    rooms, kind = F.col("rooms"), F.col("house_type")
    return licences.groupBy(*LEVELS, "year_month").agg(
        F.count(F.lit(1)).alias("c"),
        F.sum("max_guests").cast("long").alias("num_guests"),
        F.sum("rooms").cast("long").alias("num_rooms"),
        is_in(F.col("is_building_post_1951")).alias("is_building_post_1951"),
        *[is_in(rooms == n).alias(f"rooms_{n}") for n in range(4)],
        is_in(rooms > 3).alias("rooms_more_than_3"),
        is_in(kind == house_types[0]).alias("is_moradia"),
        is_in(kind == house_types[1]).alias("is_apartamento"),
    )


def explode_area_pairs(facts: DataFrame, measures: tuple[str, ...]) -> DataFrame:
    """Facts by the three levels -> the same sums by each of PAIRS. Sums are associative, so the fan-out is of aggregated rows."""
    level = lambda name: F.lit(0).cast("long") if name == "country" else F.col(name).cast("long")
    pairs = F.array(*[F.struct(F.lit(a).alias("area_type"), F.lit(b).alias("context_area_type"), level(a).alias("area_id"), level(b).alias("context_area_id")) for a, b in PAIRS])
    spread = facts.select(F.inline(pairs), "year_month", *measures)
    return spread.where("area_id IS NOT NULL AND context_area_id IS NOT NULL").groupBy(*KEYS, "year_month").agg(*[F.sum(m).alias(m) for m in measures])


def densify(facts: DataFrame, lost: DataFrame, areas: DataFrame) -> DataFrame:
    """A row for each area pair and each month that has facts; what is missing is 0. Brings the area's population.

    The month axis is broadcast: it has twelve rows a year, whatever the facts are."""
    months = facts.select("year_month").distinct()
    pairs = facts.select(*KEYS).distinct().join(areas.select(F.col("osm_id").alias("area_id"), "population"), "area_id", "left")
    grid = pairs.crossJoin(F.broadcast(months))
    on = [*KEYS, "year_month"]
    filled = grid.join(facts, on, "left").join(lost, on, "left")
    return filled.select(*on, "population", *[F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in (*MEASURES, "lost_licenses")])


def cumulative_metrics(dense: DataFrame) -> DataFrame:
    """The dense grid -> one row for each metric: value and cumulative_value. All running sums share one window and no row is
    joined to another: the licences lost so far are a column of the same row."""
    along = W.partitionBy(*KEYS).orderBy("year_month").rowsBetween(W.unboundedPreceding, W.currentRow)
    running = dense.withColumns({f"run_{m}": F.sum(m).over(along) for m in (*MEASURES, "lost_licenses")})
    ratio = lambda a, b: F.try_divide(a.cast("double"), F.nullif(b, F.lit(0)).cast("double"))
    per_1000 = lambda n: F.try_divide(F.lit(1000.0) * n, F.nullif(F.col("population"), F.lit(0)).cast("double"))
    rows = []
    for metric, kind in METRICS.items():
        if metric == "c":
            value, total = F.col("c").cast("double"), (F.col("run_c") - F.col("run_lost_licenses")).cast("double")
        elif metric == "al_per_1000":
            value, total = per_1000(F.col("c")), per_1000(F.col("run_c"))
        elif kind == "normal":
            value, total = F.col(metric).cast("double"), F.col(f"run_{metric}").cast("double")
        else:
            value, total = ratio(F.col(metric), F.col("c")), ratio(F.col(f"run_{metric}"), F.col("run_c"))
        rows.append(F.struct(F.lit(metric).alias("metric_name"), value.alias("value"), total.alias("cumulative_value")))
    return running.select(*KEYS, F.to_date(F.concat("year_month", F.lit("-01"))).alias("year_month"), F.inline(F.array(*rows)))


def rank_in_context(long: DataFrame) -> DataFrame:
    """Ranks among the areas of a type in the same context, month and metric; nulls come last."""
    by = W.partitionBy("area_type", "context_area_type", "context_area_id", "metric_name", "year_month")
    return long.withColumn("rank_month", F.rank().over(by.orderBy(F.desc_nulls_last("value")))).withColumn(
        "rank_cumulative", F.rank().over(by.orderBy(F.desc_nulls_last("cumulative_value")))
    )


def metric_table(spark: SparkSession) -> DataFrame:
    """The literal table of METRICS: metric_name, aggregation."""
    return spark.createDataFrame(list(METRICS.items()), "metric_name string, aggregation string")


def base(licences: DataFrame, areas: DataFrame, house_types: tuple[str, str]) -> DataFrame:
    """Licences and areas -> the dense grid of sums. Licences with lost_in_year_month set count as lost in that month."""
    facts = explode_area_pairs(licence_facts(licences, house_types), MEASURES)
    gone = licences.where("lost_in_year_month IS NOT NULL").groupBy(*LEVELS, F.col("lost_in_year_month").alias("year_month")).agg(F.count(F.lit(1)).alias("lost_licenses"))
    return densify(facts, explode_area_pairs(gone, ("lost_licenses",)), areas)


def cube(licences: DataFrame, areas: DataFrame, house_types: tuple[str, str]) -> DataFrame:
    """Licences and areas -> the ranked long cube."""
    return rank_in_context(cumulative_metrics(base(licences, areas, house_types)))


def widen(long: DataFrame, since: str = "2012-01-01") -> DataFrame:
    """The long cube -> a row for each (area_id, year_month): each metric's values and its ranks by context, in one aggregation."""
    columns = []
    for m in METRICS:
        own = F.col("metric_name") == m
        columns += [F.max(F.when(own, F.col(v))).alias(f"{v}_{m}") for v in ("value", "cumulative_value")]
        columns += [
            F.max(F.when(own & (F.col("context_area_type") == t), F.col("rank_cumulative"))).alias(f"{t}_rank_{m}") for t in ("municipality", "region", "country")
        ]
    return long.where(F.col("year_month") >= F.lit(since).cast("date")).groupBy("area_id", "year_month").agg(*columns)
