"""Staging, mapping, shapes, sources and streams on small fixtures."""

import gzip

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import analytics, postcodes, relational, spatial, staging
from tessera.plans import checks
from tessera.sources import files, osm
from tessera.streaming import snapshots

AREAS = [(1, "Norte", "region", 4, None), (2, "Sul", "region", 4, None), (11, "São João", "municipality", 7, 1), (12, "Faro", "municipality", 7, 2), (111, "Água", "locality", 8, 11), (121, "Sé", "locality", 8, 12), (122, "Pó", "locality", 8, 12)]


@pytest.fixture
def areas(spark):
    return spark.createDataFrame(AREAS, "osm_id long, name string, admin_type string, admin_level int, parent_id long")


def ring(*points):
    return [(float(x), float(y)) for x, y in points]


def square(x0, y0, x1, y1):
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))


def folded(spark, *names):
    df = spark.createDataFrame([(n,) for n in names], "n string")
    return [r.f for r in df.select(text.fold(F.col("n")).alias("f")).collect()]


def test_folding_covers_latin_letters(spark):
    assert folded(spark, "Őcsény Čakovec ÿŸ", "Ações Ǻḍ", "é", "straße ø", None) == ["ocseny cakovec yy", "acoes ad", "e", "straße ø", None]


def test_names_of_municipalities_and_islands(spark):
    df = spark.createDataFrame([("Lagoa (Faro)", "Ilha Da Madeira"), ("Faro(x)", "Ilha De Porto Santo"), ("A  (b) c", "Ilha Do Faial"), (None, None), ("Faro", "Faro")], "m string, d string")
    found = df.select(text.without_suffix(F.col("m")), text.island_district(F.col("d"))).collect()
    assert [tuple(r) for r in found] == [("Lagoa", "Madeira"), ("Faro(x)", "Açores"), ("A  c", "Açores"), (None, None), ("Faro", "Faro")]


def raw_rows(spark, rows):
    names = [raw for raw, _, _ in staging.RAW_COLUMNS]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names))


def test_staging_cleans_and_takes_the_latest(spark):
    one = {"etl_timestamp": "2024-01-01", "Nº de registo": "7/AL", "Data do registo": " 2020-02-30 ", "Nome do Alojamento": "CASA DA  PRAIA", "Imóvel posterior a 1951": "S ", "Nº Quartos": " 3 ", "Nº Camas": "many", "Localização (Código postal)": "1234", "Localização (Concelho)": "LAGOA (FARO)", "Localização (Distrito)": "ILHA DE SÃO JORGE", "modalidade": " Moradia "}
    rows = [one, one | {"etl_timestamp": "2024-02-01", "Imóvel posterior a 1951": "N"}, {"etl_timestamp": "2024-01-01", "Nº de registo": "8"}, {"etl_timestamp": "2024-01-01"}]
    staged = staging.stage_licences(raw_rows(spark, rows))
    found = {r.al_id: r for r in staged.collect()}
    assert set(found) == {"7", "8", None} and len(staged.columns) == len(staging.RAW_COLUMNS) + 1
    r = found["7"]
    assert (r.registration_number, r.registration_date, r.lodging_name, r.is_building_post_1951) == ("7/AL", None, "Casa Da Praia", False)
    assert (r.rooms, r.beds, r.postal_code, r.municipality, r.district, r.house_type) == (3, None, "1234-000", "Lagoa", "Açores", " Moradia ")
    assert found["8"].postal_code == "0000-000" and found["8"].is_building_post_1951 is None
    assert staging.stage_licences(raw_rows(spark, [])).count() == 0


def test_mapping_by_name_then_code_then_similar_code(spark, areas):
    rows = [("a", "ÁGUA", "sao joao", "NORTE", "1"), ("b", "nowhere", "Faro", "Sul", "2"), ("c", None, None, None, "3"), ("d", "nowhere", "Faro", "Sul", "9"), ("e", "Sé", "São João", "Norte", None), ("f", "sé", "FARO", "Norte", "2")]
    df = spark.createDataFrame(rows, "al_id string, locality string, municipality string, district string, real_postcode string")
    codes = spark.createDataFrame([("1", 121), ("2", 121)], "postcode string, locality_id long")
    like = spark.createDataFrame([("3", 122), ("2", 111)], "postcode string, locality_osm_id long")
    found = {r.al_id: r for r in staging.map_licences(df, areas, codes, like, excluded_regions=(77,)).collect()}
    assert {k: r.locality_osm_id for k, r in found.items()} == {"a": 111, "b": 121, "c": 122, "f": 121}
    assert found["a"].region_name == "Norte" and found["c"].municipality_osm_id == 12
    assert {r.al_id for r in staging.map_licences(df, areas, codes, like, excluded_regions=(2,)).collect()} == {"a"}


def test_active_licences_know_the_last_snapshot(spark):
    rows = [{"etl_timestamp": t, "Nº de registo": n, "Localização (Código postal)": "1000-001"} for t, n in (("2024-01-01", "1"), ("2024-02-01", "2"))]
    codes = spark.createDataFrame([("1000-001", 1.0, 2.0, "1000-002")], "postcode string, lng double, lat double, real_postcode string")
    found = {r.al_id: r for r in staging.active_licences(staging.stage_licences(raw_rows(spark, rows)), codes).collect()}
    assert (found["2"].is_active, found["2"].closed_month, found["2"].real_postcode) == (True, None, "1000-002")
    assert (found["1"].is_active, found["1"].closed_month) == (False, "2024-02-01")


def test_postcode_chain_prefers_names_and_falls_back_to_place(spark, areas):
    api = [("1000-001", "1000-001", "norte", "são joão", "agua", 0.5, 0.5), ("1000-009", "1000-001", "norte", "são joão", "x", 0.6, 0.5), ("2000-001", "2000-001", "sul", "faro", "unknown", 5.5, 0.5), ("3000-001", "3000-001", "sul", "faro", "nowhere", 50.0, 50.0), ("4000-001", "4000-001", "sul", "faro", None, 5.6, 0.5)]
    api = spark.createDataFrame(api, "postcode string, query_postcode string, district string, municipality string, locality string, lng double, lat double")
    bulk = api.select("postcode", "district", "municipality", "locality", "lng", "lat").limit(0)
    used = spark.createDataFrame([("1000-005", "são joão", "norte"), ("abc", None, None)], "postcode string, municipality string, district string")
    shapes = spark.createDataFrame([(111, [square(0, 0, 1, 1)]), (121, [square(5, 0, 6, 1)]), (12, [square(0, 0, 9, 9)])], "osm_id long, polygon array<array<struct<x: double, y: double>>>")
    found = {r.postcode: r for r in postcodes.postcode_chain(used, api, bulk, areas, shapes, 1.0).collect()}
    assert {k: r.locality_id for k, r in found.items()} == {"1000-001": 111, "1000-009": 111, "2000-001": 121, "3000-001": None}
    assert found["2000-001"].municipality_name == "Faro" and found["1000-001"].locality == "Água"
    near = {r.postcode: (r.near_postcode, r.locality_osm_id) for r in postcodes.similar_codes(used, postcodes.postcode_chain(used, api, bulk, areas, shapes, 1.0), areas, shapes, 1.0).collect()}
    assert near == {"1000-005": ("1000-001", 111)} or near == {"1000-005": ("1000-009", 111)}
    aliases = {r.postcode: (r.alias_postcode, r.correction_type) for r in postcodes.code_aliases(used, api, *postcodes.clean_codes(api, bulk)).collect()}
    assert aliases["1000-009"] == ("1000-001", "api") and aliases["1000-005"][1] == "district" and "abc" not in aliases


def test_hierarchy_of_odd_shapes(spark):
    u = ring((0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6))
    inner_u = ring((0.5, 0.5), (5.5, 0.5), (5.5, 5), (5, 5), (5, 1), (1, 1), (1, 5), (0.5, 5))
    rows = [
        (1, "u", 4, [[u]]), (2, "gap", 4, [[square(2.5, 2.5, 3.5, 5)]]), (3, "in u", 7, [[inner_u]]), (4, "over the gap", 7, [[square(1, 4, 5, 5)]]),
        (5, "two parts", 4, [[square(20, 0, 22, 2)], [square(30, 0, 32, 2)]]), (6, "both", 7, [[square(20, 0, 21, 1)], [square(31, 1, 32, 2)]]), (7, "one outside", 7, [[square(20, 1, 21, 2)], [square(40, 0, 41, 1)]]),
        (8, "holed", 4, [[square(50, 0, 56, 6), square(52, 2, 54, 4)]]), (9, "in the hole", 7, [[square(52.5, 2.5, 53, 3)]]), (10, "around the hole", 7, [[square(51, 1, 55, 5)]]), (11, "beside the hole", 7, [[square(50, 0, 52, 2)]]), (12, "same shape", 7, [[square(50, 0, 56, 6), square(52, 2, 54, 4)]]),
    ]
    df = spark.createDataFrame(rows, "osm_id long, name string, admin_level int, polygons array<array<array<struct<x: double, y: double>>>>")
    found = {r.osm_id: r for r in spatial.assign_hierarchy(df, 3.0).collect()}
    assert {k: r.parent_id for k, r in found.items()} == {1: None, 2: None, 3: 1, 4: None, 5: None, 6: 5, 7: None, 8: None, 9: None, 10: None, 11: 8, 12: 8}
    assert not found[8].is_leaf and found[9].is_leaf and found[3].parent_path == "u" and found[1].depth == 0
    table = {r.osm_id: r for r in spatial.area_table(df, 3.0).collect()}
    assert (table[3].full_name, table[3].slug, table[3].municipality_slug, table[3].region_slug) == ("In U, U", "in_u_u", "in_u_u", "u")


def test_rings_are_chained_whatever_their_direction(spark):
    members = spark.createDataFrame([(1, 1, "outer"), (1, 2, "outer"), (1, 3, "outer"), (1, 4, "inner"), (2, 1, "outer"), (3, 9, "outer"), (1, 8, "outer")], "relation long, way long, role string")
    ways = spark.createDataFrame([(1, [1, 2]), (2, [3, 2]), (3, [3, 4, 1]), (4, [5, 6, 7, 5]), (8, [1])], "id long, nodes array<long>")
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 0.0), (3, 9.0, 9.0), (4, 0.0, 9.0), (5, 1.0, 1.0), (6, 2.0, 1.0), (7, 1.0, 2.0)], "id long, x double, y double")
    rings = osm.assemble_rings(members, ways, nodes)
    assert sorted((r.relation, r.role, len(r.points)) for r in rings.collect()) == [(1, "inner", 3), (1, "outer", 4)]
    (shape,) = osm.multipolygons(rings).collect()
    assert shape.relation == 1 and [len(x) for x in shape.polygons[0]] == [4, 3]
    tags = spark.createDataFrame([(i, {"admin_level": v} if v else {"name": "x"}) for i, v in enumerate(["2", "3", "8", "9", "4a", "", "10", "07"])], "id long, tags map<string, string>")
    assert sorted(r.admin_level for r in osm.admin_relations(tags).collect()) == [3, 7, 8]


def test_gzip_files_by_glob_and_look_ups(spark, tmp_path):
    for i, lines in enumerate((['id,name\r\n', '1,"a, ""b"""\r\n'], ["id,name\n", "2,\n"])):
        with gzip.open(tmp_path / f"part{i}.csv.gz", "wt", newline="") as f:
            f.writelines(lines)
    found = files.read_csv(spark, f"{tmp_path}/*.csv.gz", "id int, name string").collect()
    assert sorted(map(tuple, found)) == [(1, 'a, "b"'), (2, None)]
    assert files.read_csv(spark, f"{tmp_path}/part0.csv.gz", "id int, name string").count() == 1
    rows = spark.createDataFrame([("1000-001", "t", "1000-002", "d", "m, x", None, 1.5, -2.5)], "postcode string, title string, query_postcode string, district string, municipality string, locality string, lat double, lng double")
    files.write_lookups(rows, f"{tmp_path}/lookups")
    assert spark.read.option("header", True).csv(f"{tmp_path}/lookups").columns[:3] == ["postal_code", "title", "returned_postal_code"]
    assert files.read_lookups(spark, f"{tmp_path}/lookups").collect() == rows.collect()
    files.write_parquet(rows.withColumn("year", F.lit(2024)), f"{tmp_path}/parquet", "year")
    assert spark.read.parquet(f"{tmp_path}/parquet").where("year = 2024").count() == 1


def test_areas_nested_too_deep_fail(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(4)], "osm_id long, parent_id long")
    assert analytics.ancestors(chain, 3, None).where("group_id = 3").count() == 4
    with pytest.raises(Exception, match="nested deeper"):
        analytics.ancestors(chain, 2, None).collect()


def test_far_names_and_small_helpers(spark, areas):
    al = spark.createDataFrame([("1", "Aguas", "São João"), ("2", "Algures", "Faro"), ("3", None, "Faro")], "al_id string, locality string, municipality string")
    assert [(r.al_id, r.distance) for r in checks.far_names(al, areas).collect()] == [("2", 6)]
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c")], "k int, v string")
    assert relational.union_of_distinct(df, df.where("k = 1")).count() == 4
    assert sorted(r.v for r in relational.in_or(df, "k", spark.createDataFrame([(2,), (None,)], "x int"), "x", F.col("v") == "c").collect()) == ["b", "c"]
    assert relational.first_rows(df, [F.desc("v")], 1).first().v == "c"


def test_counts_by_calendar_month(spark, tmp_path):
    days = ["2024-01-31", "2024-02-01", "2024-02-29", "2024-03-01", "2024-01-01"]
    rows = spark.createDataFrame([(d, "x") for d in days], "d string, kind string").select(F.col("d").cast("timestamp").alias("ts"), "kind")
    rows.write.parquet(str(tmp_path / "in"))
    stream = snapshots.monthly_counts(spark, str(tmp_path / "in"), "ts timestamp, kind string", "ts", ["kind"])
    query = stream.writeStream.outputMode("complete").format("memory").queryName("by_month").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((str(r.month)[:7], r.n) for r in spark.table("by_month").collect()) == [("2024-01", 2), ("2024-02", 2), ("2024-03", 1)]


def in_files(df, path):
    """df read from Parquet files, whose small size Spark knows."""
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def plan(df, optimized=False):
    execution = df._jdf.queryExecution()
    return (execution.optimizedPlan() if optimized else execution.executedPlan()).toString()


def test_names_are_cleaned_of_chosen_rows_only(spark):
    rows = [{"etl_timestamp": t, "Nº de registo": n, "Nome do Alojamento": f"CASA {t}-d'água"} for t in "12" for n in ("7/AL", "8/AL/AL", "9/ALx", None)]
    staged = staging.stage_licences(raw_rows(spark, rows))
    text = plan(staged, optimized=True)
    assert "lambda" in text and "lambda" not in text[text.index("Window [") :]
    assert {(r.al_id, r.registration_number, r.lodging_name) for r in staged.collect()} == {(i, n, "Casa 2-D'Água") for i, n in (("7", "7/AL"), ("8/AL", "8/AL/AL"), ("9/ALx", "9/ALx"), (None, None))}


def test_no_broadcast_of_codes_and_licences(spark, areas, tmp_path):
    rows = [("a", "ÁGUA", "sao joao", "NORTE", "1"), ("b", "nowhere", "Faro", "Sul", "2"), ("c", None, None, None, "3"), ("d", "x", "Faro", "Sul", None)]
    al = in_files(spark.createDataFrame(rows, "al_id string, locality string, municipality string, district string, real_postcode string"), tmp_path / "al")
    codes = in_files(spark.createDataFrame([("1", 121), ("2", 121), ("3", None)], "postcode string, locality_id long"), tmp_path / "codes")
    like = in_files(spark.createDataFrame([("3", 122), ("2", 111)], "postcode string, locality_osm_id long"), tmp_path / "like")
    mapped = staging.map_licences(al, in_files(areas, tmp_path / "areas"), codes, like, excluded_regions=(77,))
    assert "SortMergeJoin [real_postcode" in plan(mapped)
    assert {r.al_id: r.locality_osm_id for r in mapped.collect()} == {"a": 111, "b": 121, "c": 122}
    missing = checks.unknown(al.select("real_postcode"), "real_postcode", codes.select("postcode"))
    assert "Broadcast" not in plan(missing) and missing.count() == 1


def test_codes_are_not_broadcast(spark, tmp_path):
    rows = [("1000-001", "1000-001", "n", "m", "l", 0.0, 0.0), ("1000-002", "1000-002", "n", "m", "l", 0.0, 0.0), ("1000-003", "1000-001", "n", "m", "l", 1.0, 0.0)]
    api = in_files(spark.createDataFrame(rows, "postcode string, query_postcode string, district string, municipality string, locality string, lng double, lat double"), tmp_path / "api")
    clean, shared = postcodes.clean_codes(api, api.drop("query_postcode"))
    assert "Broadcast" not in plan(clean) + plan(shared)
    assert [r.postcode for r in clean.collect()] == ["1000-003"] and sorted(map(tuple, shared.collect())) == [("1000-001", "1000-002"), ("1000-002", "1000-001")]
    aliases = in_files(spark.createDataFrame([("1000-002", "1000-003", "all")], "postcode string, alias_postcode string, correction_type string"), tmp_path / "aliases")
    placed = postcodes.with_localities(in_files(clean, tmp_path / "clean"), aliases, api)
    assert "Broadcast" not in plan(placed)
    assert sorted((r.postcode, r.is_valid, r.x) for r in placed.collect()) == [("1000-002", False, 1.0), ("1000-003", True, 1.0)]


def test_lost_licences_are_written_before_they_are_mapped(spark):
    from conftest import SF

    from tessera.plans import registry

    assert "lost-licences" in plan(registry.QUERIES["lost_mapped"](spark, SF), optimized=False)
