"""Relational operators that SQL dialects have shorthands for, by column names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.prefix import over_ranges


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that must not be broadcast. Spark goes by compressed files and the share of their columns, so of tables that grow
    with the input it would broadcast what is many times larger in memory."""
    return df.hint("merge")


def latest_by(df: DataFrame, keys: Sequence[str], order: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """The row with the greatest `order` of each key (then of the tie-breaks); ROW_NUMBER() = 1, limited before the shuffle."""
    by = W.partitionBy(*keys).orderBy(F.desc_nulls_last(order), *[F.desc_nulls_last(c) for c in tiebreak])
    return df.withColumn("__place", F.row_number().over(by)).where("__place = 1").drop("__place")


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order (DISTINCT ON)."""
    return df.withColumn("__place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__place = 1").drop("__place")


def nearest_within(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_value: str, right_value: str, tiers: Sequence[tuple[str, Sequence[str]]], parts: int | None = None) -> DataFrame:
    """For each left row the right row with the nearest value, from the first tier (name, shared key columns) that has one.

    left_id, right_id, tier, distance; ties go to the smaller right_id, and of several rows of a left_id the nearest counts. Each row
    stands once in each tier; both sides' values are put in one order by tier, key and value, and each left row takes the nearest
    right one below and above it, across ranges of the order. So all tiers are one pass, and a key may hold all rows. Null ids,
    values and keys meet nothing.
    """
    columns = list(dict.fromkeys(k for _, keys in tiers for k in keys))
    left, right = _in_tiers(left, left_id, left_value, tiers, columns), _in_tiers(right, right_id, right_value, tiers, columns)
    keys = ["place", *[f"k{n}" for n in range(len(columns))]]
    targets = right.groupBy(*keys, "v").agg(F.min("i").alias("hit"))
    both = left.withColumn("hit", F.lit(None).cast(targets.schema["hit"].dataType)).unionByName(targets, allowMissingColumns=True)
    at = F.when(F.col("hit").isNotNull(), F.struct("v", F.col("hit").alias("i")))
    # A target comes before what asks for the same value; who asks is told apart by its id.
    near = over_ranges(both, keys, [F.col("v"), F.col("hit").asc_nulls_last(), F.col("i")], before={"below": at}, after={"above": at}, parts=parts).where("hit IS NULL")
    gap = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)["v"] - F.col("v")).alias("distance"), F.col(c)["i"].alias("i")))
    hits = near.select("i", "place", F.least(gap("below"), gap("above")).alias("hit")).where("hit IS NOT NULL")
    best = hits.groupBy("i").agg(F.min(F.struct("place", "hit")).alias("best"))
    names = F.array(*[F.lit(name) for name, _ in tiers])
    return best.select(F.col("i").alias(left_id), F.col("best.hit.i").alias(right_id), F.get(names, F.col("best.place")).alias("tier"), F.col("best.hit.distance").alias("distance"))


def _in_tiers(df: DataFrame, i: str, v: str, tiers: Sequence[tuple[str, Sequence[str]]], columns: Sequence[str]) -> DataFrame:
    """place, k0, k1, ..., v, i: a row for each tier that it has all keys of; key columns that a tier doesn't use are null."""
    rows = []
    for place, (_, keys) in enumerate(tiers):
        key = [(F.col(k) if k in keys else F.lit(None).cast(df.schema[k].dataType)).alias(f"k{n}") for n, k in enumerate(columns)]
        rows.append(F.when(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)), F.struct(F.lit(place).alias("place"), *key)))
    known = df.where(F.col(i).isNotNull() & F.col(v).isNotNull())
    return known.select(F.explode(F.array_compact(F.array(*rows))).alias("t"), F.col(v).alias("v"), F.col(i).alias("i")).select("t.*", "v", "i")


def shared_position(df: DataFrame, code: str, x: str, y: str) -> DataFrame:
    """Codes whose exact position another code has too, with the smallest other one: code, alias."""
    placed = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(code, x, y).distinct()
    groups = placed.groupBy(x, y).agg(F.count(F.lit(1)).alias("n"), F.min(code).alias("low")).where("n > 1")
    second = placed.join(shuffled(groups), [x, y]).where(F.col(code) != F.col("low")).groupBy(x, y).agg(F.min(code).alias("next"))
    joined = placed.join(shuffled(groups.join(shuffled(second), [x, y])), [x, y])
    alias = F.when(F.col(code) == F.col("low"), F.col("next")).otherwise(F.col("low"))
    return joined.groupBy(code).agg(F.min(alias).alias("alias"))


def not_in_null_aware(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """SQL's NOT IN: nothing is left if the other side holds a null, and a null on this side is left only if the other is empty."""
    spark = df.sparkSession
    return spark.sql(f"SELECT * FROM {{df}} WHERE `{column}` NOT IN (SELECT `{other_column}` FROM {{other}})", df=df, other=other)


def equal_or_both_missing(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys in which null equals null."""
    renamed = right.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns])
    on = None
    for k in keys:
        same = left[k].eqNullSafe(renamed[f"__{k}"])
        on = same if on is None else on & same
    return left.join(renamed, on, how).drop(*[f"__{k}" for k in keys])


def ordered_text(df: DataFrame, keys: Sequence[str], value: str, order: str, separator: str = ", ") -> DataFrame:
    """Values of each key joined in descending order (ordered STRING_AGG)."""
    rows = F.reverse(F.array_sort(F.collect_list(F.struct(order, value))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r[value]), separator).alias(value))


def first_rows(df: DataFrame, order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of a whole table; planned as a top-n, not as a window over one partition."""
    return df.orderBy(*order).limit(n)


def in_or(df: DataFrame, column: str, other: DataFrame, other_column: str, otherwise: Column) -> DataFrame:
    """Rows whose value the other side has, or that meet another condition (IN (subquery) OR ...)."""
    known = other.select(F.col(other_column).alias("__known")).where("__known IS NOT NULL").distinct()
    return df.join(known, F.col(column) == F.col("__known"), "left").where(F.col("__known").isNotNull() | otherwise).drop("__known")


def union_of_distinct(*parts: DataFrame) -> DataFrame:
    """Each part without its own repeats; rows that two parts have stay twice."""
    out = parts[0].distinct()
    for p in parts[1:]:
        out = out.unionByName(p.distinct())
    return out
