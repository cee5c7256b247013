"""Snapshots as they arrive. An extension: incremental reading of a folder to which a snapshot a month is appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def monthly_counts(spark: SparkSession, folder: str, schema: str, ts_col: str, key_cols: list[str]) -> DataFrame:
    """A stream of the number of rows by calendar month and keys, for update or complete mode. The state is one row a month and
    key, so late rows are counted however late they come and nothing needs a watermark."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.groupBy(F.date_trunc("month", ts_col).alias("month"), *key_cols).agg(F.count(F.lit(1)).alias("n"))


def upsert_latest(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str, key: str, order: str) -> StreamingQuery:
    """Reads what is new in the folder and keeps the latest row of each key in target, a folder of one version per batch."""
    rows = spark.readStream.schema(schema).parquet(folder)

    def merge(batch: DataFrame, number: int) -> None:
        before = [spark.read.parquet(f"{target}/version={number - 1}")] if number else []
        both = batch if not before else batch.unionByName(before[0])
        columns = [c for c in both.columns if c not in (key, order)]
        best = both.groupBy(key).agg(F.max(F.struct(order, *columns)).alias("r")).select(key, "r.*")
        best.write.mode("overwrite").parquet(f"{target}/version={number}")

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
