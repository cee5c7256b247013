"""Data checks: each is a query that should return no rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import fold
from tessera.operators.names import close_names
from tessera.operators.relational import shuffled
from tessera.operators.staging import area_chain


def not_unique(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def several_parents(df: DataFrame, child: str, parent: str) -> DataFrame:
    return df.groupBy(child).agg(F.count_distinct(parent).alias("parents")).where("parents > 1")


def unknown(df: DataFrame, column: str, *known: DataFrame) -> DataFrame:
    """Values that none of the known one-column frames has."""
    for k in known:
        df = df.join(shuffled(k.select(F.col(k.columns[0]).alias(column))), column, "left_anti")
    return df


def low_coverage(df: DataFrame, by: str, column: str, least: float = 80.0) -> DataFrame:
    return df.groupBy(by).agg((F.count(column) * 100.0 / F.count(F.lit(1))).alias("coverage")).where(F.col("coverage") < least)


def out_of_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.where((F.col(column) < low) | (F.col(column) > high))


def missing_growth(summary: DataFrame, wide: DataFrame, areas: DataFrame, before: str) -> DataFrame:
    """Regions without growth although the wide cube has licences of theirs in the month before."""
    had = wide.where((F.col("year_month") == F.lit(before).cast("date")) & (F.col("cumulative_value_c") > 0)).select("area_id")
    regions = areas.where("admin_type = 'region'").join(had, F.col("osm_id") == F.col("area_id"), "left_semi").select(F.col("slug").alias("area_slug"))
    return summary.where("al_count_growth_pcnt IS NULL").join(regions, "area_slug", "left_semi")


def far_names(licences: DataFrame, areas: DataFrame, limit: int = 1) -> DataFrame:
    """Licences whose locality's name is more than `limit` edits from every locality of their municipality, with the distance of the
    nearest one. Those without a locality's name, and those of municipalities without localities, are no violations. Only names that
    have no close one meet all names of their municipality."""
    chain = area_chain(areas).select(fold(F.col("municipality_name")).alias("m"), fold(F.col("locality_name")).alias("own")).where("own IS NOT NULL").distinct()
    keyed = licences.select("al_id", fold(F.col("municipality")).alias("m"), fold(F.col("locality")).alias("own")).where("own IS NOT NULL")
    near = close_names(keyed, chain, "own", ["m"], limit).select("m", F.col("name").alias("own"))
    far = keyed.select("m", "own").distinct().join(near.distinct(), ["m", "own"], "left_anti")
    far = far.join(chain.withColumnRenamed("own", "l"), "m").groupBy("m", "own").agg(F.min(F.levenshtein("own", "l")).alias("distance"))
    return keyed.join(shuffled(far), ["m", "own"]).select("al_id", "distance")


def run_checks(checks: dict[str, DataFrame]) -> DataFrame:
    """name, violations: one row for each check, counted in one job."""
    counted = [df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("name"), "violations") for name, df in checks.items()]
    return reduce(DataFrame.unionByName, counted)
