"""Links of any depth, and cycles."""

import pytest

from tessera.operators import analytics, fixpoint
from tessera.sources import files


def links(spark, pairs):
    return spark.createDataFrame(pairs, "child long, parent long")


def test_a_hundred_levels(spark):
    found = fixpoint.ancestors_of(links(spark, [(i, i + 1) for i in range(100)] + [(100, None)])).collect()
    assert {(r.node, r.ancestor): r.depth for r in found} == {(i, j): j - i for i in range(101) for j in range(i + 1, 101)}


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_cycles_end(spark, size):
    pairs = [(i, (i + 1) % size) for i in range(size)] + [(50, 0), (51, 50)]
    found = {(r.node, r.ancestor): r.depth for r in fixpoint.ancestors_of(links(spark, pairs)).collect()}
    want = {(i, (i + d) % size): d for i in range(size) for d in range(1, size)}
    want |= {(50, i): 1 + i for i in range(size)} | {(51, 50): 1} | {(51, i): 2 + i for i in range(size)}
    assert found == want


def test_the_shortest_of_several_ways(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (1, 4), (4, 5), (5, 6), (6, 7)]
    found = {(r.node, r.ancestor): r.depth for r in fixpoint.ancestors_of(links(spark, pairs)).collect()}
    assert found[1, 4] == 1 and found[1, 7] == 4 and found[2, 7] == 5


def test_filters_behind_ancestors(spark):
    """The check of the depth is no column, so nothing can move it to rows that it isn't about."""
    areas = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "osm_id long, parent_id long")
    for depth in (None, 2):
        above = analytics.ancestors(areas, depth, None).where("depth > 0")
        assert sorted((r.group_id, r.area_id, r.depth) for r in above.join(areas.select(areas.osm_id.alias("area_id")), "area_id").collect()) == [(2, 1, 1), (3, 1, 2), (3, 2, 1)]
    with pytest.raises(ValueError):
        analytics.ancestors(areas, 1, None)


def test_relations_nested_deep_and_in_a_cycle(spark):
    members = [(i, "r", i + 1, "inner") for i in range(16)] + [(16, "w", 7, "outer"), (16, "r", 14, "outer")]
    df = spark.createDataFrame(members, "relation long, kind string, ref long, role string").coalesce(2)
    found = {(r.relation, r.role) for r in files.resolve_relations(df).collect() if r.way == 7}
    # From 15 and 14 a cycle leads back, but not into the relation itself.
    assert {(16, "outer"), (15, "inner"), (14, "outer"), (1, "inner"), (0, "outer")} <= found
    assert {r for r, _ in found} == set(range(17))
