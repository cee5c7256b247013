"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Sources get shares of all words by weight, capped at `max_copies` times what they have (the excess goes to the others by
weight until none is above). Documents have relative weights: short texts half that of others, unless told otherwise.
Each is expected as often as the source's rate times its weight, max_copies times at most; the rate is such that a source's
expected words are its target. A document is taken as many whole times as that for certain; the rest, p, is its inclusion
probability in a sample without replacement. Documents are ranked by Pareto's order variable, the odds of a random number
over the odds of p, and the lowest are taken until their words reach the remainder.

No source is ever sorted as a whole: ranks are found through a histogram of the order variable (`buckets` a source). All
documents of the buckets below the remainder are in, all above are out, and only the one bucket of each source in which
the remainder falls is ordered document by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import materialised, n_words

#: Sources up to this many are broadcast (under 100 bytes each); beyond it Spark joins them by shuffling.
BROADCAST_SOURCES = 100_000


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from the first 52 bits of a digest of the key: the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_copies: int = 3) -> DataFrame:
    """(source, source_size) -> the same with target (double). Sources in code-point order, null last, take the weights
    in turn. A source is capped if its share, once all sources that fill up earlier are capped, is above max_copies times
    its size. The windows without keys order one row a source, not documents."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn + 1).cast("int")).cast("long")
    cap = F.col("source_size") * max_copies
    weighed = sources.withColumn("weight", weight).withColumn("cap", cap).withColumn("fill", F.col("cap") / F.col("weight"))
    by_fill = W.orderBy("fill", F.col("source").asc_nulls_last())
    before, whole = by_fill.rowsBetween(W.unboundedPreceding, -1), W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nothing = F.lit(0).cast("long")
    rest_words = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), nothing)
    rest_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), nothing)
    shared = weighed.withColumn("level", rest_words.cast("double") / rest_weight)
    shared = shared.withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
    # All sources before the first that isn't capped are capped; the others share at that one's level.
    level = F.min(F.when(~F.col("capped"), F.struct("fill", F.col("source").isNull(), "source", "level"))).over(whole)["level"]
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return shared.select("source", "source_size", target.alias("target"))


#: Texts of fewer characters than this, and their weight beside that of others.
SHORT = (100, 0.5)


def _weight(docs: DataFrame, text_col: str, weight_col: str | None, short: tuple[int, float]) -> Column:
    """The relative weight, in steps of an eighth of an octave: a source has few different ones. Null and negative ones are 0."""
    w = F.when(F.length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) < short[0], F.lit(float(short[1]))).otherwise(F.lit(1.0))
    if weight_col is None:
        return w
    own = F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0))
    return w * F.when(own > 0, F.pow(F.lit(2.0), F.round(F.log2(own) * 8) / 8)).otherwise(F.lit(0.0))


def _drawn(rows: DataFrame, plan: DataFrame, small: bool, max_copies: int, seed: int) -> DataFrame:
    """rows (doc_id, source, w, ...) with the plan's columns, whole (certain copies) and order (of those that are drawn for one
    more; null where nothing is left to draw)."""
    keyed = plan.withColumnRenamed("source", "__source")
    joined = rows.join(F.broadcast(keyed) if small else keyed, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    expected = F.least(F.col("rate") * F.col("w"), F.lit(float(max_copies)))
    p = expected - F.floor(expected)
    u = uniform(F.col("doc_id"), seed)
    odds = (u / (1 - u)) / (p / (1 - p))
    # odds / (1 + odds) keeps the order and lies in (0, 1), so that equal slices are a histogram.
    return joined.withColumn("whole", F.floor(expected).cast("long")).withColumn("order", F.when(p > 0, odds / (1 + odds)))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight_col: str | None, short: tuple[int, float]) -> DataFrame:
    w = _weight(docs, text_col, weight_col, short)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), w.alias("w"))


def _rates(levels: DataFrame, targets: DataFrame, max_copies: int) -> DataFrame:
    """(source, w, words) and targets -> targets with rate: the heaviest weights reach max_copies first; with those that do, the
    others share what is left by weight. A source has few different weights, so its window is short."""
    keyed = targets.withColumnRenamed("source", "__source")
    rows = levels.where("w > 0 AND words > 0").join(keyed, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    down = W.partitionBy("source").orderBy(F.desc("w"))
    heavier = F.coalesce(F.sum("words").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("w") * F.col("words")).over(down.rowsBetween(W.currentRow, W.unboundedFollowing))
    rated = rows.withColumn("rate", (F.col("target") - heavier * max_copies) / rest).where(F.col("rate") * F.col("w") <= max_copies)
    first = rated.groupBy("source").agg(F.max(F.struct("w", "rate"))["rate"].alias("rate")).withColumnRenamed("source", "__source")
    # Without one, all that may be taken is taken max_copies times; a source without words has nothing to take.
    rate = F.when(F.col("source_size") > 0, F.coalesce("rate", F.lit(1e300))).otherwise(F.lit(0.0))
    return targets.join(first, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source").withColumn("rate", rate)


def mixing_plan(sized: DataFrame, weights: tuple[int, ...], max_copies: int, buckets: int, seed: int) -> tuple[DataFrame, bool]:
    """(doc_id, source, size, w) -> a row for each source: source, source_size, target, rate, cut. A document is drawn if its order
    is at most its source's cut. And whether there are few enough sources to broadcast."""
    levels = materialised(sized.groupBy("source", "w").agg(F.sum("size").alias("words")))
    sources = materialised(levels.groupBy("source").agg(F.sum("words").alias("source_size")))
    small = sources.count() <= BROADCAST_SOURCES
    targets = materialised(_rates(levels, source_targets(sources, weights, max_copies), max_copies))
    drawn = _drawn(sized, targets, small, max_copies, seed)
    bucket = F.least(F.floor(F.col("order") * buckets), F.lit(buckets - 1)).cast("int")
    drawn = drawn.withColumn("bucket", bucket)

    slices = drawn.groupBy("source", "target", "bucket").agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("whole")).alias("certain"))
    along = W.partitionBy("source").orderBy(F.col("bucket").asc_nulls_first())
    slices = slices.withColumn("rest", F.col("target") - F.sum("certain").over(W.partitionBy("source")))
    slices = slices.where("bucket IS NOT NULL").withColumn("upto", F.sum("words").over(along))
    edge = slices.where(F.col("upto") >= F.col("rest")).groupBy("source").agg(
        F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"), "rest")).alias("edge")
    )
    edge = materialised(edge.select(F.col("source").alias("__source"), F.col("edge.bucket").alias("edge_bucket"), "edge.before", "edge.rest"))
    at_edge = F.col("source").eqNullSafe(F.col("__source")) & (F.col("bucket") == F.col("edge_bucket"))
    in_edge = drawn.join(F.broadcast(edge) if small else edge, at_edge)
    along = W.partitionBy("source").orderBy("order", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    # Rises along the order, so those that it lets in come first.
    middle = F.col("before") + F.sum("size").over(along) - F.col("size") / 2
    last = in_edge.withColumn("in", middle <= F.col("rest")).groupBy("source", "edge_bucket").agg(F.max(F.when(F.col("in"), F.col("order"))).alias("last"))
    # Without one, the cut is just below the bucket; a source whose remainder its documents don't reach takes all.
    below = (F.col("edge_bucket") / F.lit(float(buckets))) - 1e-15
    cuts = last.select(F.col("source").alias("__source"), F.coalesce("last", below).alias("cut"))
    plan = targets.join(cuts, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    return materialised(plan.withColumn("cut", F.coalesce("cut", F.lit(2.0)))), small


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    max_copies: int = 3,
    weight_col: str | None = None,
    short: tuple[int, float] = SHORT,
    buckets: int = 2048,
    seed: int = 17,
) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken (words), copies.

    Null or empty text has size 0. A null source is a source of its own, last in order. Rows that share an id are drawn
    together. Reruns agree. A source's taken words miss its target by half a document at most, where ids are unique and no
    weight is 0. An empty table gives an empty result; further columns are ignored.
    """
    sized = materialised(_sized(docs, id_col, text_col, source_col, weight_col, short))
    plan, small = mixing_plan(sized, weights, max_copies, buckets, seed)
    drawn = _drawn(sized, plan, small, max_copies, seed)
    copies = F.col("whole") + F.coalesce((F.col("order") <= F.col("cut")).cast("int"), F.lit(0))
    return drawn.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1),
    max_copies: int = 3, short: tuple[int, float] = SHORT, buckets: int = 2048, seed: int = 17,
) -> DataFrame:
    """The rows of docs, with all their columns, each as often as mix() takes it; odd rows are treated as there. Texts stay
    where they are."""
    sized = materialised(_sized(docs, id_col, text_col, source_col, None, short))
    plan, small = mixing_plan(sized, weights, max_copies, buckets, seed)
    whole_rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _weight(docs, text_col, None, short).alias("w"))
    drawn = _drawn(whole_rows, plan, small, max_copies, seed)
    copies = (F.col("whole") + F.coalesce((F.col("order") <= F.col("cut")).cast("int"), F.lit(0))).cast("int")
    repeated = drawn.where(copies > 0).select("row", F.explode(F.sequence(F.lit(1), copies)).alias("copy"))
    return repeated.select("row.*")


ORACLE = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, length(coalesce(text, '')) < 100 AS short FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, coalesce(sum(size) FILTER (short), 0)::BIGINT AS short_size FROM d GROUP BY source),
w AS (SELECT *, source_size * 3 AS cap,
  CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
f AS (SELECT *,
  (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level,
  row_number() OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST) AS place
  FROM w WINDOW before AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, level * weight >= cap AS capped FROM f),
l AS (SELECT level FROM g WHERE NOT capped ORDER BY place LIMIT 1),
t AS (SELECT source, source_size, short_size, CASE WHEN capped THEN cap::DOUBLE ELSE (SELECT level FROM l) * weight END AS target FROM g),
c AS (SELECT *, CASE WHEN source_size = 0 THEN 0.0::DOUBLE
  WHEN source_size = short_size OR target / (source_size - short_size + 0.5::DOUBLE * short_size) <= 3 THEN target / (source_size - short_size + 0.5::DOUBLE * short_size)
  ELSE (target - 3 * (source_size - short_size)) / (0.5::DOUBLE * short_size) END AS rate FROM t),
r AS (SELECT d.doc_id, d.source, size, source_size, target, least(CASE WHEN short THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END * rate, 3.0::DOUBLE) AS e,
  (('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source),
o AS (SELECT *, floor(e)::BIGINT AS whole, e - floor(e) AS p FROM r),
q AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM o),
a AS (SELECT *, sum(size * whole) OVER (PARTITION BY source) AS certain,
  sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY p = 0, odds / (1 + odds), size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM q)
SELECT doc_id, size, source_size, target,
  ((whole + CASE WHEN p > 0 AND upto - size / 2.0 <= target - certain THEN 1 ELSE 0 END) * size)::BIGINT AS taken,
  whole + CASE WHEN p > 0 AND upto - size / 2.0 <= target - certain THEN 1 ELSE 0 END AS copies
FROM a
"""
