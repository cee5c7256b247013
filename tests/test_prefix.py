"""Running values and nearest joins over ranges, against brute force; one key may hold all rows."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import analytics, relational
from tessera.operators.prefix import in_ranges, over_ranges


def running(rows):
    """(key, place, value) -> (sum up to it, last value before it, first value behind it), by loops."""
    out = {}
    for k, i, v in rows:
        same = sorted((j, w) for q, j, w in rows if q == k)
        known = [w for j, w in same if j <= i and w is not None]
        before, after = [w for j, w in same if j < i and w is not None], [w for j, w in same if j > i and w is not None]
        out[k, i] = (sum(known) if known else None, before[-1] if before else None, after[0] if after else None)
    return out


@pytest.mark.parametrize("keys", [1, 3, 200])
@pytest.mark.parametrize("parts", [1, 7])
def test_running_values(spark, keys, parts):
    pick = random.Random(keys * 10 + parts)
    rows = [(pick.choice([None, *range(keys)]) if keys > 1 else 0, i, pick.choice([None, None, pick.randrange(9)])) for i in pick.sample(range(10_000), 300)]
    df = spark.createDataFrame(rows, "k int, i int, v int")
    found = over_ranges(df, ["k"], [F.col("i")], sums={"s": F.col("v")}, before={"b": F.col("v")}, after={"a": F.col("v")}, parts=parts).collect()
    assert len(found) == len(rows)
    assert {(r.k, r.i): (r.s, r.b, r.a) for r in found} == running(rows)


def test_without_keys_downwards_and_empty(spark):
    df = spark.range(100).select(F.col("id").alias("i"))
    found = over_ranges(df, [], [F.desc("i")], sums={"n": F.lit(1)}, before={"b": F.col("i")}, after={"a": F.col("i")}, parts=5).collect()
    assert {r.i: (r.n, r.b, r.a) for r in found} == {i: (100 - i, i + 1 if i < 99 else None, i - 1 if i else None) for i in range(100)}
    assert over_ranges(df.where("i < 0"), [], [F.col("i")], sums={"n": F.lit(1)}).count() == 0


def test_one_key_is_spread(spark):
    df = spark.range(10_000).select(F.lit("hot").alias("k"), F.col("id").alias("i"))
    sizes = [r["count"] for r in in_ranges(df, ["k"], [F.col("i")], 8).groupBy("__part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 10_000 / 8


def nearest(left, right, tiers):
    out = {}
    for i, v, *keys in left:
        for name, places in tiers:
            near = [(abs(v - w), j) for j, w, *others in right if v is not None and w is not None and all(keys[p] is not None and keys[p] == others[p] for p in places)]
            if near:
                out[i] = (min(near)[1], name, min(near)[0])
                break
    return out


@pytest.mark.parametrize("groups", [1, 4, 60])
def test_nearest_within(spark, groups):
    pick = random.Random(groups)
    some = lambda n, null: [(i, float(pick.randrange(400)) if pick.random() > null else None, pick.choice([None, *range(groups)]) if groups > 1 else 0, pick.randrange(3)) for i in range(n)]
    left, right = some(300, 0.05), some(80, 0.05)
    frame = lambda rows, i, v: spark.createDataFrame(rows, f"{i} long, {v} double, g int, h int")
    tiers = [("both", ["g", "h"]), ("group", ["g"]), ("all", ["h"])]
    for r in (right, []):
        found = relational.nearest_within(frame(left, "i", "v"), frame(r, "j", "w"), "i", "j", "v", "w", tiers, parts=5).collect()
        assert {x.i: (x.j, x.tier, x.distance) for x in found} == nearest(left, r, [("both", (0, 1)), ("group", (0,)), ("all", (1,))])
        assert len(found) == len({x.i for x in found})


def test_lost_over_many_snapshots(spark):
    rows = [(f"l{i}", t) for i in range(40) for t in range(0, 400, 10) if t <= i * 10]
    lost = {r.id: (r.last_seen, r.lost_in) for r in analytics.lost_licences(spark.createDataFrame(rows, "id string, t long"), "id", "t").collect()}
    assert lost == {f"l{i}": (i * 10, i * 10 + 10) for i in range(39)}
