"""What links lead to, in rounds that each cut their lineage: no round's plan holds the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.store import shared_dir


def _cut(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ancestors_of(links: DataFrame, max_depth: int | None = None) -> DataFrame:
    """links (child, parent) -> (node, ancestor, depth): all that a node's links lead to but itself, with the fewest links it takes.

    Rounds double: what is reached by exactly 2**k links is joined with all that is reached by at most so many, so the number of
    rounds is the logarithm of the depth. On a cycle each node has all the others. Null ends are no links. Where max_depth is
    given, nodes further apart are an error.
    """
    ends = links.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).where("node <> ancestor")
    reached, step = _cut(ends.distinct().withColumn("depth", F.lit(1))), 1
    while not reached.where(F.col("depth") == step).isEmpty():
        far = reached.where(F.col("depth") == step).select("node", F.col("ancestor").alias("via"))
        near = reached.select(F.col("node").alias("via"), "ancestor", (F.col("depth") + step).alias("depth"))
        more = far.join(near, "via").where("node <> ancestor").select("node", "ancestor", "depth")
        reached = _cut(reached.unionByName(more).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")))
        step *= 2
    if max_depth is not None and not reached.where(F.col("depth") > max_depth).isEmpty():
        raise ValueError(f"areas are nested deeper than {max_depth} levels")
    return reached


def reached_states(links: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """links (up, down, turns: whether the link changes sides) -> (top, node, turned): all nodes below each one, in every state that some
    way down leads to. A state is entered once, whatever the ways, so cycles end; nothing leads back into its top."""
    start = links.where("up <> down").select(F.col("up").alias("top"), F.col("down").alias("node"), F.col("turns").alias("turned")).distinct()
    fresh = seen = _cut(start)
    rounds = 1
    while not fresh.isEmpty():
        if max_rounds is not None and rounds > max_rounds:
            raise RuntimeError(f"relations are nested deeper than {max_rounds} rounds")
        step = fresh.join(links, F.col("node") == F.col("up")).where("top <> down")
        step = step.select("top", F.col("down").alias("node"), (F.col("turned") != F.col("turns")).alias("turned")).distinct()
        fresh = _cut(step.join(seen, ["top", "node", "turned"], "left_anti"))
        seen = _cut(seen.unionByName(fresh))
        rounds += 1
    return seen
