import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import analytics, relational, spatial
from tessera.sources import files


def test_not_in_keeps_sql_nulls(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    some, null, none = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1,), (None,)], "k int"), spark.createDataFrame([], "k int")
    assert [r.k for r in relational.not_in_null_aware(left, "k", some, "k").collect()] == [2]
    assert relational.not_in_null_aware(left, "k", null, "k").count() == 0
    assert relational.not_in_null_aware(left, "k", none, "k").count() == 3


def test_nearest_within_takes_the_first_tier(spark):
    left = spark.createDataFrame([(1, 10.0, "a"), (2, 10.0, "b"), (3, 5.0, "a"), (4, None, "a")], "i int, v double, g string")
    right = spark.createDataFrame([(7, 12.0, "a"), (8, 8.0, "a"), (9, 100.0, "c")], "j int, w double, g string")
    left, right = left.withColumn("h", F.lit(1)), right.withColumn("h", F.lit(1))
    found = relational.nearest_within(left, right, "i", "j", "v", "w", [("group", ["g"]), ("all", ["h"])])
    assert sorted(map(tuple, found.collect())) == [(1, 7, "group", 2.0), (2, 7, "all", 2.0), (3, 8, "group", 3.0)]


def test_lost_licences(spark):
    seen = [("a", 1), ("b", 1), ("b", 2), ("c", 1), ("c", 3), ("d", 1), ("d", 2), ("d", 3)]
    df = spark.createDataFrame(seen, "id string, t int")
    assert sorted(map(tuple, analytics.lost_licences(df, "id", "t").collect())) == [("a", 1, 2), ("b", 2, 3)]
    assert sorted(map(tuple, analytics.lost_licences(df, "id", "t", exact=True).collect())) == [("a", 1, 2), ("b", 2, 3), ("c", 1, 2)]


def test_polygon_with_hole(spark):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    shape = [ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((1, 1), (3, 1), (3, 3), (1, 3))]
    polygons = spark.createDataFrame([(1, shape)], "id int, polygon array<array<struct<x: double, y: double>>>")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 9.0, 9.0), (4, None, 1.0)], "p int, x double, y double")
    found = spatial.point_in_polygon_join(points, polygons, "x", "y", "polygon", 1.0, "left").select("p", "id").collect()
    assert sorted(map(tuple, found)) == [(1, 1), (2, None), (3, None), (4, None)]
    made = json.loads(files.feature_collection(polygons.withColumn("k", F.lit(1)), "polygon", ["k"]).first()["json"])
    assert made["features"][0]["geometry"]["coordinates"][0][1][0] == [1.0, 1.0]


def test_geojson_round_trip(spark, tmp_path):
    feature = {"type": "Feature", "properties": {"name": "A", "osm_id": "1"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}}
    path = tmp_path / "a.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [feature]}))
    row = files.read_geojson(spark, str(path), "name string, osm_id string").first()
    assert row["name"] == "A" and [(p.x, p.y) for p in row["polygons"][0][0]] == [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]


def test_csv_line_ends_and_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'day,name\r\n2020-01-01,"x, y"\r\n2020-01-02,z\r\n')
    rows = files.read_csv(spark, str(tmp_path / "a.csv"), "day date, name string").collect()
    assert [r["name"] for r in rows] == ["x, y", "z"]


def test_relations_flip_roles_and_stop_at_cycles(spark):
    members = [(1, "w", 10, ""), (1, "r", 2, "inner"), (2, "w", 20, "outer"), (2, "w", 21, "inner"), (2, "r", 1, "outer"), (1, "w", 11, "subarea")]
    df = spark.createDataFrame(members, "relation long, kind string, ref long, role string")
    found = {tuple(r) for r in files.resolve_relations(df).collect() if r.relation == 1}
    assert found == {(1, 10, "outer"), (1, 20, "inner"), (1, 21, "outer")}


def test_relations_nested_too_deep_are_an_error(spark):
    members = [(i, "r", i + 1, "outer") for i in range(1, 5)] + [(5, "w", 50, "outer")]
    df = spark.createDataFrame(members, "relation long, kind string, ref long, role string").coalesce(1)
    assert (1, 50, "outer") in {tuple(r) for r in files.resolve_relations(df, max_depth=4).collect()}
    with pytest.raises(RuntimeError):
        files.resolve_relations(df, max_depth=3)


def test_stream_keeps_the_latest(spark, tmp_path):
    from tessera.streaming.snapshots import upsert_latest

    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    for t, rows in enumerate([[("a", 1, "x"), ("b", 1, "y")], [("a", 2, "z")]]):
        spark.createDataFrame(rows, "id string, t int, v string").write.mode("append").parquet(folder)
        upsert_latest(spark, folder, "id string, t int, v string", target, str(tmp_path / "cp"), "id", "t").awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(f"{target}/version=1").select("id", "t", "v").collect())) == [("a", 2, "z"), ("b", 1, "y")]


@pytest.mark.parametrize("rows", [[], [("a", 1.0, 1.0)]])
def test_no_shared_positions(spark, rows):
    df = spark.createDataFrame(rows, "code string, x double, y double")
    assert relational.shared_position(df, "code", "x", "y").count() == 0
