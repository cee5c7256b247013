"""Sources and sinks with declared schemas: CSV snapshots, seeds, GeoJSON, and OSM-style tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.fixpoint import reached_states


def read_csv(spark: SparkSession, path: str, schema: str, timestamp_format: str | None = None) -> DataFrame:
    """CSV files by glob, plain or gzip, with a header, quoted commas and either kind of line end. Gzip files can't be split, so
    they are dealt out again after reading."""
    reader = spark.read.option("header", True).option("multiLine", False).option("quote", '"').option("escape", '"').option("ignoreTrailingWhiteSpace", True)
    if timestamp_format:
        reader = reader.option("timestampFormat", timestamp_format)
    df = reader.schema(schema).csv(path)
    return df.repartition(spark.sparkContext.defaultParallelism) if path.endswith(".gz") else df


def write_csv(df: DataFrame, path: str, compression: str | None = None) -> None:
    """CSV with a header; values with commas or quotes are quoted, quotes doubled. Null and empty text are one there."""
    writer = df.write.option("header", True).option("quote", '"').option("escape", '"')
    (writer.option("compression", compression) if compression else writer).csv(path)


#: Columns of a look-up's file as it is written, and as they are read: the second name is what was asked for. Fixed values.
LOOKUP_COLUMNS = (
    ("postal_code", "postcode"), ("title", "title"), ("returned_postal_code", "query_postcode"), ("district", "district"), ("municipality", "municipality"), ("locality", "locality"),
    ("lat", "lat"), ("lng", "lng"),
)


def write_lookups(df: DataFrame, path: str) -> None:
    """Look-ups under the names of their file."""
    write_csv(df.select(*[F.col(read).alias(written) for written, read in LOOKUP_COLUMNS]), path)


def read_lookups(spark: SparkSession, path: str) -> DataFrame:
    """Look-ups under the names that staging knows, whatever the file's header says; columns are in the file's order."""
    kinds = {"lat": "double", "lng": "double"}
    return read_csv(spark, path, ", ".join(f"{read} {kinds.get(read, 'string')}" for _, read in LOOKUP_COLUMNS))


def write_parquet(df: DataFrame, path: str, by: str | None = None) -> None:
    (df.write.partitionBy(by) if by else df.write).parquet(path)


_POLYGONS = "array<array<array<double>>>"


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """A row for each feature of a FeatureCollection: its properties (a DDL schema) and polygons, as lists of rings of (x, y)."""
    schema = f"features array<struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: string>>>"
    features = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("features").alias("f"))
    text = F.col("f.geometry.coordinates")
    parts = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json(text, _POLYGONS))).otherwise(F.from_json(text, f"array<{_POLYGONS}>"))
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    polygons = F.transform(parts, lambda part: F.transform(part, lambda ring: F.transform(ring, point)))
    return features.select("f.properties.*", polygons.alias("polygons"))


def features(df: DataFrame, polygon_col: str) -> DataFrame:
    """One GeoJSON feature a row, as text: all other columns are properties, the geometry is a MultiPolygon."""
    properties = F.struct(*[F.col(c) for c in df.columns if c != polygon_col])
    coordinates = F.array(F.transform(F.col(polygon_col), lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))))
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))).alias("feature"))


def feature_collection(df: DataFrame, polygon_col: str, by: list[str]) -> DataFrame:
    """A FeatureCollection for each key in `by`, for groups that fit a row; features() is for anything larger."""
    polygons = F.array(F.transform(F.col(polygon_col), lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))))
    properties = F.struct(*[F.col(c) for c in df.columns if c not in (polygon_col, *by)])
    one = F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.lit("MultiPolygon").alias("type"), polygons.alias("coordinates")).alias("geometry"))
    grouped = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.to_json(one))).alias("features"))
    return grouped.select(*by, F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join("features", ","), F.lit("]}")).alias("json"))


def _windows(first: Column, last: Column) -> Column:
    months = F.sequence(F.trunc(first, "MM"), last, F.expr("INTERVAL 1 MONTH"))
    return F.inline(F.transform(months, lambda m: F.struct(F.greatest(m, first).alias("window_start"), F.least(F.last_day(m), last).alias("window_end"))))


def month_windows(spark: SparkSession, start: str, end: str) -> DataFrame:
    """The calendar months from start to end: window_start, window_end (clipped to the two dates)."""
    return spark.range(1).select(_windows(F.lit(start).cast("date"), F.lit(end).cast("date")))


def month_windows_of(df: DataFrame, day_col: str) -> DataFrame:
    """The calendar months from a table's first day to its last, with the number of its rows in each, 0 in gaps: window_start, window_end,
    rows. Rows without a day are in none; without days there are no windows."""
    days = df.select(F.col(day_col).cast("date").alias("day")).where("day IS NOT NULL")
    per = days.groupBy(F.trunc("day", "MM").alias("m")).agg(F.count(F.lit(1)).alias("rows"), F.min("day").alias("first"), F.max("day").alias("last"))
    windows = per.agg(F.min("first").alias("first"), F.max("last").alias("last")).where("first IS NOT NULL").select(_windows(F.col("first"), F.col("last")))
    counted = windows.join(per.select("m", "rows"), F.trunc("window_start", "MM") == F.col("m"), "left")
    return counted.select("window_start", "window_end", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))


def resolve_relations(members: DataFrame, max_depth: int | None = None) -> DataFrame:
    """members (relation, kind "w" or "r", ref, role) -> (relation, way, role): the ways of a relation and of the relations in it.

    A blank role is outer; `subarea` members are skipped; below a relation that isn't outer, inner and outer change places. A
    relation inside itself is not entered again. Where max_depth is given, relations nested deeper are an error.
    """
    plain = members.where(F.coalesce("role", F.lit("")) != "subarea").select(
        "relation", "kind", "ref", F.when(F.coalesce("role", F.lit("")) == "", "outer").otherwise(F.col("role")).alias("role")
    )
    ways = plain.where("kind = 'w'").select("relation", F.col("ref").alias("way"), "role")
    links = plain.where("kind = 'r'").select(F.col("relation").alias("up"), F.col("ref").alias("down"), (F.col("role") != "outer").alias("turns"))
    below = reached_states(links, max_depth)
    other = F.when(F.col("turned") & (F.col("role") == "outer"), "inner").when(F.col("turned") & (F.col("role") == "inner"), "outer").otherwise(F.col("role"))
    found = below.join(ways, below.node == ways.relation).select(F.col("top").alias("relation"), "way", other.alias("role"))
    return ways.unionByName(found).distinct()


def html_field(html, pattern: str):
    """The first group of a pattern in a page, without tags and surrounding space."""
    return F.trim(F.regexp_replace(F.regexp_extract(html, pattern, 1), "<[^>]*>", ""))
