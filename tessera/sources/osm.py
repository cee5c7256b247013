"""Areas from relations, ways and nodes, as joins of three tables; the tracing of a relation's rings runs by relation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.rings import faces
from tessera.operators.spatial import contains_polygon


def admin_relations(relations: DataFrame, above: int = 2, upto: int = 8) -> DataFrame:
    """Relations (id, tags) whose admin_level is a number in digits, greater than `above` and at most `upto`, with admin_level."""
    level = F.col("tags")["admin_level"]
    return relations.where(level.rlike(r"\A[0-9]+\z")).withColumn("admin_level", level.try_cast("int")).where(F.col("admin_level").between(above + 1, upto))


def assemble_rings(members: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """members (relation, way, role), ways (id, nodes), nodes (id, x, y) -> relation, role, ring, points: the ring around each face that
    a relation's ways of one role cut out, counter-clockwise. Ways meet at their ends; spurs and bridges are cut off, and rings that
    touch come out apart. Missing nodes are left out, and ways of under two nodes. A relation's ways meet in one task."""

    def traced(group: pd.DataFrame) -> pd.DataFrame:
        lines = [([p["node"] for p in w], [(p["x"], p["y"]) for p in w]) for w in group["line"]]
        first = group.iloc[0]
        rows = [(first["relation"], first["role"], i, [{"x": x, "y": y} for x, y in at]) for i, (_, at) in enumerate(faces(lines))]
        return pd.DataFrame(rows, columns=["relation", "role", "ring", "points"], dtype=object)

    wanted = members.select("relation", "way", "role").distinct()
    steps = ways.join(wanted.select(F.col("way").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("way"), F.posexplode("nodes").alias("at", "node"))
    steps = steps.join(nodes.select(F.col("id").alias("node"), "x", "y"), "node")
    lines = steps.groupBy("way").agg(F.sort_array(F.collect_list(F.struct("at", "node", "x", "y"))).alias("line")).where(F.size("line") > 1)
    return wanted.join(lines, "way").groupBy("relation", "role").applyInPandas(traced, "relation long, role string, ring long, points array<struct<x: double, y: double>>")


def multipolygons(rings: DataFrame) -> DataFrame:
    """assemble_rings() -> relation, polygons: each outer ring with the inner rings that lie in it."""
    side = lambda role: rings.where(F.col("role") == role).select("relation", F.col("ring").alias(f"{role}_ring"), F.col("points").alias(role))
    outer, inner = side("outer"), side("inner").withColumnRenamed("relation", "of")
    holds = (F.col("relation") == F.col("of")) & contains_polygon(F.array("outer"), F.array("inner"))
    joined = outer.join(inner, holds, "left")
    holes = F.transform(F.sort_array(F.collect_list(F.when(F.col("inner").isNotNull(), F.struct("inner_ring", "inner")))), lambda h: h["inner"])
    polygons = joined.groupBy("relation", "outer_ring").agg(F.concat(F.array(F.first("outer")), holes).alias("polygon"))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("outer_ring", "polygon"))), lambda p: p["polygon"])
    return polygons.groupBy("relation").agg(in_order.alias("polygons"))
