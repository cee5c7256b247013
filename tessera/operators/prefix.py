"""Running values over keys of any size: a key that holds all rows is spread over all tasks.

Spark's windows put a key into one task. Here rows are cut into ranges by key and order, each range computes its own running
values, and what the ranges before or behind it hold of the same key is added: two passes over ranges of one size instead of one
over keys of any.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans.store import written

#: A range's place is in the high bits of its rows' places, as monotonically_increasing_id() numbers them.
_PART_BITS = 33


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column], parts: int | None = None) -> DataFrame:
    """df with __at, each row's place by keys, then order, and __part, the range that holds it. Written to the shared folder: ranges
    are sampled, and later passes must meet the same ones. Only rows equal in keys and order must share a range, so order should end
    in an id."""
    spark = df.sparkSession
    by = [F.col(k).asc() for k in keys] + list(order)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    return written(placed.withColumn("__part", F.shiftright("__at", _PART_BITS)), "ranges")


def over_ranges(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], *, sums: Mapping[str, Column] | None = None, before: Mapping[str, Column] | None = None, after: Mapping[str, Column] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """df with running values by name: sums up to each row and with it, the last value before it that isn't null, and the first one
    behind it. Rows of one key, null being one, follow each other by order; without keys all rows do. Rows equal in order follow
    each other in any way."""
    sums, before, after = dict(sums or {}), dict(before or {}), dict(after or {})
    inputs = {f"__of_{name}": value for name, value in {**sums, **before, **after}.items()}
    ranged = in_ranges(df.withColumns(inputs), keys, order, parts)
    # Frames that end at the last row are quadratic in Spark, so what is behind a row is read in descending order.
    mine = W.partitionBy("__part", *keys)
    up_to, ahead = mine.orderBy("__at").rowsBetween(W.unboundedPreceding, 0), mine.orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    behind = mine.orderBy(F.desc("__at")).rowsBetween(W.unboundedPreceding, -1)
    own = {f"__own_{n}": F.sum(f"__of_{n}").over(up_to) for n in sums}
    own |= {f"__own_{n}": F.last(f"__of_{n}", True).over(ahead) for n in before} | {f"__own_{n}": F.last(f"__of_{n}", True).over(behind) for n in after}

    known = lambda n: F.when(F.col(f"__of_{n}").isNotNull(), F.col("__at"))
    ends = [F.sum(f"__of_{n}").alias(n) for n in sums] + [F.max_by(f"__of_{n}", known(n)).alias(n) for n in before] + [F.min_by(f"__of_{n}", known(n)).alias(n) for n in after]
    edges = ranged.groupBy("__part", *keys).agg(*ends)
    # One row a range of each key, so a key has at most as many as there are ranges.
    across = W.partitionBy(*keys)
    earlier, later = across.orderBy("__part").rowsBetween(W.unboundedPreceding, -1), across.orderBy(F.desc("__part")).rowsBetween(W.unboundedPreceding, -1)
    carried = {f"__in_{n}": F.sum(n).over(earlier) for n in sums}
    carried |= {f"__in_{n}": F.last(n, True).over(earlier) for n in before} | {f"__in_{n}": F.last(n, True).over(later) for n in after}
    brought = edges.select(F.col("__part").alias("__to"), *[F.col(k).alias(f"__key_{k}") for k in keys], *[c.alias(n) for n, c in carried.items()])
    # Only a key that goes past a range's end brings anything: at most two rows a range, whatever the table.
    brought = brought.where(" OR ".join(f"`{n}` IS NOT NULL" for n in carried))
    on = F.col("__part") == F.col("__to")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    rows = ranged.withColumns(own).join(F.broadcast(brought), on, "left")
    total = lambda n: F.when(F.col(f"__own_{n}").isNull(), F.col(f"__in_{n}")).otherwise(F.col(f"__own_{n}") + F.coalesce(f"__in_{n}", F.lit(0)))
    found = {n: total(n) for n in sums} | {n: F.coalesce(f"__own_{n}", f"__in_{n}") for n in (*before, *after)}
    return rows.select(*[F.col(c) for c in df.columns if c not in found], *[c.alias(n) for n, c in found.items()])
