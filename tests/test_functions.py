from datetime import date

import pytest
from pyspark.sql import functions as F

from tessera.functions import similarity, text


def _one(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("s"))).collect()]


def test_capitalize(spark):
    pairs = {
        None: None, "": "", "12  3": "12  3", "faro": "Faro", "(FARO": "(faro", "(faro) x": "() FaroX", "d'ouro": "D'Ouro",
        "a  b": "A B", "SÃO JOÃO-DA  SILVA (x)": "São João-Da Silva (X)",
    }
    assert _one(spark, list(pairs), text.capitalize) == list(pairs.values())


def test_normalize_postcode(spark):
    pairs = {
        None: "0000-000", "1234-567": "1234-567", " 1234-567 ": "1234-567", "1234-56": "1234-560", "1234": "1234-000", "123": "1230-000", "123-456": "0123-000",
        "12-345": "0012-000", "1-234": "0001-000", "12345": "1234-000", "1234-567, X": "1234-567", "abc": "abc", "1234\n": "1234\n",
    }
    assert _one(spark, list(pairs), text.normalize_postcode) == list(pairs.values())
    assert _one(spark, ["1234-567", "abcd-efg", None], text.postcode_number) == [1234567, None, None]


def test_fold_and_slug(spark):
    assert _one(spark, ["São Vicente", None, "ÉVORA"], text.fold) == ["sao vicente", None, "evora"]
    assert _one(spark, ["São -- Vicente!"], lambda c: text.slugify(c, F.lit("Évora, Land"))) == ["sao_vicente_evora_land"]
    assert _one(spark, ["Calheta (Madeira)", "Faro"], text.without_suffix) == ["Calheta", "Faro"]
    assert _one(spark, ["Ilha Da Madeira", "Ilha Do Pico", "Faro"], text.island_district) == ["Madeira", "Açores", "Faro"]


@pytest.mark.parametrize(("a", "b", "jaro", "damerau"), [("martha", "marhta", 0.944444, 1), ("", "a", 0.0, 1), ("abc", "abc", 1.0, 0), ("ca", "abc", 0.0, 2)])
def test_similarity(spark, a, b, jaro, damerau):
    df = spark.createDataFrame([(a, b), (None, b)], "a string, b string")
    found = df.select(similarity.jaro(F.col("a"), F.col("b")), similarity.damerau_levenshtein(F.col("a"), F.col("b"))).collect()
    assert round(found[0][0], 6) == jaro and found[0][1] == damerau and found[1][0] is None


def test_month_windows(spark):
    from tessera.sources.files import month_windows

    rows = month_windows(spark, "2020-01-15", "2020-03-02").collect()
    assert [tuple(r) for r in rows] == [(date(2020, 1, 15), date(2020, 1, 31)), (date(2020, 2, 1), date(2020, 2, 29)), (date(2020, 3, 1), date(2020, 3, 2))]


def test_month_windows_of_a_table(spark):
    from tessera.sources.files import month_windows_of

    days = spark.createDataFrame([(date(2020, 1, 15), 1), (date(2020, 1, 31), 2), (date(2020, 3, 2), 3), (None, 4)], "d date, rows int")
    want = [(date(2020, 1, 15), date(2020, 1, 31), 2), (date(2020, 2, 1), date(2020, 2, 29), 0), (date(2020, 3, 1), date(2020, 3, 2), 1)]
    assert sorted(map(tuple, month_windows_of(days, "d").collect())) == want
    assert month_windows_of(days.where("d IS NULL"), "d").count() == 0
