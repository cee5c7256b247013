"""Vector codes, shards and phrases: against their SQL, brute force, and the odd cases."""

import collections
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import codes, collocation, phrases, sharding
from tessera.llm.common import fresh_path
from tessera.llm.hashes import column_hashes, word_hashes

VECTORS = "vec_id long, embedding array<float>, label int, code string, error long, v string"


def vectors(spark, rows):
    """Vectors with columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], VECTORS)


def lloyd(rows, parts, entries, rounds):
    """Plain Lloyd over integers: (codes, errors, codebooks)."""
    x = np.array([[int(np.floor(256 * np.float64(np.float32(c)))) for c in v] for v in rows], dtype=object).reshape(len(rows), parts, -1)
    books = [[list(x[e][p]) for e in range(min(entries, len(rows)))] for p in range(parts)]

    def nearest():
        far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
        return [[min((far(x[i][p], c), e) for e, c in enumerate(books[p])) for p in range(parts)] for i in range(len(rows))]

    for _ in range(rounds):
        at = nearest()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [x[i][p] for i in range(len(rows)) if at[i][p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    at = nearest()
    return ["".join(f"{e:02x}" for _, e in r) for r in at], [sum(d for d, _ in r) for r in at], books


@pytest.mark.parametrize("rounds", [0, 1, 5])
def test_codes_brute_force(spark, rounds):
    rng = np.random.default_rng(3)
    # Few different values: many ties, equal entries, and entries that nothing is nearest to.
    rows = [rng.integers(-2, 3, 8).astype(np.float32).tolist() for _ in range(150)]
    df = vectors(spark, [(i, r, i % 3 or None) for i, r in enumerate(rows)]).repartition(5)
    found, points = codes.learn(df, "vec_id", "embedding", "label", 4, 9, rounds)
    want, errors, books = lloyd(rows, 4, 9, rounds)
    assert [(r.code, r.error) for r in found.orderBy("vec_id").collect()] == list(zip(want, errors))
    assert points.tolist() == books


def test_bounds_save_scans_and_keep_ties():
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, (4000, 2, 4))
    books = codes.Codebooks(x[:32].transpose(1, 0, 2).copy())
    code, upper, lower = books.assigned(x)
    for _ in range(4):
        moved = books.points.copy()
        for p in range(2):
            for e in range(32):
                own = x[code[:, p] == e, p]
                moved[p, e] = own.sum(0) // len(own) if len(own) else moved[p, e]
        books = codes.Codebooks(moved, books.points)
        scanned = books.reassigned(x, code, upper, lower)
        fresh, _, _ = books.assigned(x)
        assert (fresh == code).all() and scanned < 0.9 * code.size
        d = np.sqrt(books.own(x, code).astype(float))
        assert (upper >= d).all()


def test_codes_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5] * 16, 1), (2, None, 1), (3, [nan] + [0.0] * 15, 1), (4, [None] + [0.0] * 15, 2), (5, [inf] + [0.0] * 15, 2), (None, [-0.501] * 16, None), (1, [0.5] * 16, 1), (7, [0.25] * 16, None)]
    found = codes.compress(vectors(spark, rows)).collect()
    assert sorted((r.vec_id or 0, r.error) for r in found) == [(0, 0), (1, 0), (1, 0), (7, 0)]
    assert len({r.codebooks_sha256 for r in found}) == 1 and all(len(r.code) == 32 and r.label_error == 0 for r in found)
    for empty in ([], [(2, None, 1)]):
        none = codes.compress(vectors(spark, empty))
        assert none.count() == 0 and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError):
        codes.compress(vectors(spark, [(1, [0.5] * 16, 1), (2, [0.5] * 32, 1)]))
    with pytest.raises(Exception, match="too large"):
        codes.compress(vectors(spark, [(1, [1e20] * 16, 1)])).collect()


DOCS = "doc_id long, text string, lang string, shard int, slot long, size string, hi string, bucket int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", "y", 3) for r in rows], DOCS)


def shard_rows(found):
    by = collections.defaultdict(list)
    for r in found:
        by[r.shard].append(r)
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    return by


def test_shards_are_even_whole_and_stable(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLICE_ROWS", 40)
    # A third are copies of one text, and one text is longer than a shard.
    rows = [(i, "copy of a text" if i % 3 == 0 else f"text {i} " * (i % 7 + 1), "en") for i in range(3000)] + [(9000, "long " * 4000, "en")]
    found = sharding.shards(docs(spark, rows)).collect()
    assert collections.Counter(r.doc_id for r in found) == collections.Counter(i for i, _, _ in rows)
    by = shard_rows(found)
    mean = sum(r.size for r in found) / 24
    sizes = [sum(r.size for r in by[k]) for k in range(24)]
    assert sorted(sizes)[-2] <= 1.03 * mean + 100 and max(sizes) <= mean + 20_008
    want = {i: (len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t, _ in rows}
    assert all((r.size, r.text_crc32) == want[r.doc_id] and r.law == "bytes" and r.grown_shard is None for r in found)
    again = sharding.shards(docs(spark, rows).repartition(7)).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in found}


def test_small_groups_stay_together(spark):
    rows = [(i, f"group {i % 4000}", "en") for i in range(12_000)]
    found = sharding.shards(docs(spark, rows)).collect()
    by = collections.defaultdict(set)
    for r in found:
        by[r.doc_id % 4000].add(r.shard)
    assert all(len(x) == 1 for x in by.values())


def test_shards_odd_rows(spark):
    long = "é" * 300_000
    rows = [(1, None, None), (None, "a", None), (None, "a", "x"), (2, "", "x"), (2, "", "x"), (3, long, "x"), (4, "b", "x")]
    found = sharding.shards(docs(spark, rows)).collect()
    shard_rows(found)
    assert sorted((r.doc_id or 0, r.size) for r in found) == [(0, 9), (0, 9), (1, 8), (2, 8), (2, 8), (3, 600_008), (4, 9)]
    assert sharding.shards(docs(spark, [])).count() == 0
    same = sharding.shards(docs(spark, [(1, "same", "x")] * 240)).collect()
    assert [len(shard_rows(same)[k]) for k in range(24)] == [10] * 24


def test_write_shards(spark):
    rows = docs(spark, [(i, f"text {i % 900}", "en") for i in range(1000)])
    path = fresh_path(spark, "shards")
    sharding.write_shards(rows, path, shards=6)
    written = spark.read.parquet(path)
    dealt = {r.doc_id: r.shard for r in sharding.shards(rows, shards=6).collect()}
    assert {r.doc_id: r.shard_ for r in written.collect()} == dealt
    assert set(rows.columns) < set(written.columns)


def collocations(rows, least=10, most=2000, share=50):
    """Word by word, with Python's integers."""
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for run, a in f.items():
        lang, *w = run
        if len(w) < 2 or a < least:
            continue
        if len(w) == 2 and any(len(o) == 4 and o[0] == lang and b >= least and 100 * b >= share * a and (list(o[1:3]) == w or list(o[2:4]) == w) for o, b in f.items()):
            continue
        cuts = [((10**6 * a * a) // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, " ".join(w), a, f[(lang, *w[:k])], f[(lang, *w[k:])], n[lang], score))
    found = []
    for lang in n:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        found += [(x[0], i + 1, *x[1:]) for i, x in enumerate(own[:most])]
    return sorted(found)


@pytest.mark.parametrize("options", [{}, {"most": 3}, {"shard_bytes": 400, "bucket_bytes": 50, "fan": 4}])
def test_phrases_brute_force(spark, options):
    rng = np.random.default_rng(11)
    words = ["New", "york", "Éa", "éa", "x y", "b", "c\x0b", "d", "the", "e"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", "\t ", ". ", ",", " \n", " "], p=[0.5, 0.1, 0.1, 0.1, 0.1, 0.1]) for _ in range(rng.integers(0, 60))), [None, "en", "de", "und"][i % 4]) for i in range(160)]
    found = collocation.phrases(docs(spark, rows).repartition(6), least=4, **options).collect()
    want = collocations(rows, 4, options.get("most", 2000))
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found) == want


def test_phrases_odd_rows(spark):
    long = "of the " * 40_000
    rows = [(1, None, None), (None, "", "en"), (2, ".,;", "en"), (3, long, "en"), (3, long, "en"), (4, "word", None)]
    found = {(r.lang, r.phrase): r for r in collocation.phrases(docs(spark, rows)).collect()}
    assert found["en", "of the of"].a == 2 * 39_999 and found["en", "of the of"].n == 160_000
    assert set(found) == {("en", "of the of"), ("en", "the of the")}
    assert collocation.phrases(docs(spark, [])).count() == 0


def test_scores_are_exact(spark):
    big = [(999_999_999_999_999, 999_999_999_999_999, 999_999_999_999_999), (10**14 + 7, 10**15 - 1, 10**14 + 9), (3, 7, 11)]
    df = spark.createDataFrame(big, "a long, l long, r long").select("*", collocation._score("a", "l", "r").alias("score"))
    assert [r.score for r in df.collect()] == [10**6 * a * a // (x * y) for a, x, y in big]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aB .,\té\n", max_size=30), max_size=8))
def test_automaton_counts_runs(texts):
    words, pieces = phrases.split(pa.array(texts, pa.large_string()))
    want = [w for t in texts for p in re.split(r"[.,;:!?\x0A-\x0D]", t.replace("B", "b")) for w in re.findall(r"[^\x20\x09]+", p)]
    assert words.to_pylist() == want
    coded = words.dictionary_encode()
    names = coded.dictionary.to_pylist()
    automaton = phrases.PhraseAutomaton(coded.indices.to_numpy(), pieces, len(names))
    for length in (1, 2, 3):
        seen = collections.Counter()
        for t in texts:
            for p in re.split(r"[.,;:!?\x0A-\x0D]", t.replace("B", "b")):
                w = re.findall(r"[^\x20\x09]+", p)
                seen.update(tuple(w[i : i + length]) for i in range(len(w) - length + 1))
        runs, ends = automaton.runs(length)
        assert {tuple(names[i] for i in r): int(n) for r, n in zip(runs, ends)} == seen
    assert len(automaton.ends) <= sum(len(automaton.runs(k)[0]) for k in (1, 2, 3))


def test_blocks_round_trip():
    rng = np.random.default_rng(2)
    numbers = rng.integers(0, 2**63, 70_000).astype(np.uint64)
    runs, counts = rng.integers(0, len(numbers), (90_000, 3)), rng.integers(1, 2**31, 90_000)
    back, n = collocation._unpacked(collocation._packed(numbers, runs, counts, np.zeros(len(numbers), np.uint8)))
    assert (back == numbers[runs]).all() and (n == counts).all()
    huge = list(collocation._blocks(numbers, runs[:1], np.array([2**33 + 5]), (8,)))
    total = [c for _, c in collocation._summed([b for x in huge for b in x.column("block").to_pylist()])]
    assert total[0].tolist() == [2**33 + 5]


def test_long_words_hash_apart():
    words = [f"averylongbeginning{i}" for i in range(5000)] + [f"{i}averylongend" for i in range(5000)]
    assert len(set(word_hashes([w.encode() for w in words]).tolist())) == len(words)
    assert (column_hashes(pa.array(words, pa.large_string())) == word_hashes([w.encode() for w in words])).all()
