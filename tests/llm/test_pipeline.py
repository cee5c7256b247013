"""The pipeline's stages on the smallest table, each against a plain version of what it decides."""

import hashlib

from conftest import SF

import corpus_pipeline
from tessera.llm import mixing


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(path := str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(path)
        kept.append((before, docs))
        if k < 4:
            assert docs.columns == columns, name
    toxic, exact, near, mix, pack = kept
    assert 0.8 * toxic[0].count() < toxic[1].count() < toxic[0].count()
    best: dict = {}
    table = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for r in exact[0].collect():
        key = hashlib.sha256(r.text.translate(table).encode()).digest()
        best[key] = max(best.get(key, -1), r.doc_id)
    assert sorted(r.doc_id for r in exact[1].collect()) == sorted(best.values())
    sets = {r.doc_id: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for r in near[0].collect() if (w := r.text.encode().lower().split())}
    left = {r.doc_id for r in near[1].collect()}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for i in set(sets) - left:
        assert max(alike(i, j) for j in sets if j != i) > 0.65
    copies = {r.doc_id: r.copies for r in mixing.mix(mix[0]).collect()}
    counted = {r.doc_id: r["count"] for r in mix[1].groupBy("doc_id").count().collect()}
    assert counted == {i: n for i, n in copies.items() if n}
    assert pack[1].where("start = 0").count() == mix[1].count()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and columns whose names the stages use themselves."""
    long = " ".join(f"word{i % 997} line{i % 89}" for i in range(60_000))
    near = long.replace("word5 ", "other ", 1)
    rows = [(1, "Some text", "en", "web"), (1, "Some text", "en", "web"), (2, None, None, None), (3, "", "en", "web"), (None, "a b c d e f", "de", None), (4, long, None, "web"), (5, near, "en", None), (6, long.upper(), "en", "web"), (4, "same id, other text", "en", "web"), (7, " \t\n", "en", "x"), (None, None, None, None)]
    named = "doc_id long, text string, lang string, source string, n_chars long, row string, w double, copy int, __key string, __gone long, stays boolean"
    return spark.createDataFrame([(*r, len(r[1] or ""), "r", 0.5, 9, "k", 4, True) for r in rows], named)


def test_stages_of_odd_documents(spark):
    docs = odd_documents(spark)
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns, name
        seen.append(sorted((r.doc_id or 0, len(r.text or "")) for r in docs.collect()))
    toxic, exact, near, mix = seen
    assert len(toxic) == 11
    assert [i for i, _ in exact].count(1) == 1 and sum(n == 0 for _, n in exact) == 1 and (6, toxic[-2][1]) in exact
    long_ids = {i for i, n in exact if n > 100_000}
    assert long_ids == {5, 6} and {i for i, n in near if n > 100_000} == {5}
    assert set(mix) <= set(near)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sum(r.start == 0 for r in packed) == len(mix)


def test_stages_of_an_empty_table(spark):
    docs = odd_documents(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, SF)
        assert found.count() == 0, name
