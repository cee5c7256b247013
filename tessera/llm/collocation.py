"""Phrases of two and three words that occur together more often than their parts explain.

Each task builds a suffix automaton of bounded depth for each language of a shard of its texts (phrases.py) and enumerates the
runs of words with how often they end. Words have 64-bit numbers, made from the language and the word; a first pass counts
all words by themselves, and starts anew with other numbers if two words should share one, so runs are compared exactly by
their words' numbers. Runs of two and three words travel as packed blocks, one for each shard and range of hashes ("bucket");
the number of buckets follows the input's bytes, and beyond `fan` of them blocks are dealt out in several rounds, each of which
combines counts again. A bucket's task adds up exact counts and keeps the frequent runs.

What follows is joins of frequent runs only: with the counts of their parts, and of runs of two words with the longer ones they
lie in, which are those whose suffix link or whose prefix they are. Ranks come from one sort by ranges, whose tasks count off
their first rows of each language, and the counts of the tasks before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import batches_of, discard, fresh_path
from tessera.llm.hashes import column_hashes, mixed, word_hashes
from tessera.llm.phrases import PhraseAutomaton, split

#: Bytes of text of a shard, and of text whose runs a bucket takes.
SHARD_BYTES, BUCKET_BYTES = 12 << 20, 4 << 20
#: Frequent words up to this many (about 60 bytes each) are broadcast; beyond it Spark joins them by shuffling.
BROADCAST_WORDS = 500_000
_RATE = np.uint64(0x9E3779B97F4A7C15)


def _shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[tuple[str, pa.LargeStringArray]]:
    """The texts (lang, text) of a task by shards of one language each."""
    held: list[pa.RecordBatch] = []
    size = 0

    def out() -> Iterator[tuple[str, pa.LargeStringArray]]:
        whole = pa.Table.from_batches(held).combine_chunks()
        langs = whole.column("lang").combine_chunks().dictionary_encode()
        langs = langs.chunk(0) if isinstance(langs, pa.ChunkedArray) else langs
        which = langs.indices.to_numpy()
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            texts = whole.column("text").take(pa.array(np.flatnonzero(which == i))).cast(pa.large_string()).combine_chunks()
            yield lang, texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
            if size >= shard_bytes:
                yield from out()
                held, size = [], 0
    if held:
        yield from out()


def _numbers(lang: str, words: pa.LargeStringArray, seed: int) -> np.ndarray:
    salt = word_hashes([f"{seed}\x00{lang}".encode()])
    return mixed(column_hashes(words) ^ salt)


def _words(seed: int, shard_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _shards(batches, shard_bytes):
            coded = split(texts)[0].dictionary_encode()
            if known := len(coded.dictionary):
                counts = np.bincount(coded.indices.to_numpy(), minlength=known)
                columns = [_numbers(lang, coded.dictionary, seed).view(np.int64), [lang] * known, coded.dictionary.cast(pa.string()), counts]
                yield pa.record_batch([pa.array(c) if not isinstance(c, pa.Array) else c for c in columns], ["id", "lang", "word", "n"])

    return run


def _keys(runs: np.ndarray) -> np.ndarray:
    """A hash of each row of numbers."""
    out = np.full(len(runs), runs.shape[1], np.uint64)
    for k in range(runs.shape[1]):
        out = out * _RATE + runs[:, k]
    return mixed(out)


def _packed(numbers: np.ndarray, runs: np.ndarray, counts: np.ndarray, scratch: np.ndarray) -> bytes:
    """runs (rows of indexes into numbers) with their counts as bytes: the numbers that occur, and where. scratch: zeros, one for
    each of the numbers, which stay zeros."""
    scratch[runs.reshape(-1)] = 1
    used = np.flatnonzero(scratch)
    place = np.cumsum(scratch, dtype=np.uint32) - 1
    scratch[used] = 0
    kind = np.uint16 if len(used) <= 1 << 16 else np.uint32
    body = numbers[used].tobytes() + counts.astype(np.uint32).tobytes() + place[runs].T.astype(kind).tobytes()
    head = np.array([runs.shape[1], len(used), len(runs), len(body)], np.uint32).tobytes()
    return head + pa.compress(body, "zstd", asbytes=True)


def _unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Rows of numbers, and their counts."""
    length, used, n, size = np.frombuffer(block[:16], np.uint32).tolist()
    body = memoryview(pa.decompress(block[16:], size, "zstd", asbytes=True))
    numbers, counts = np.frombuffer(body[: 8 * used], np.uint64), np.frombuffer(body[8 * used : 8 * used + 4 * n], np.uint32)
    places = np.frombuffer(body[8 * used + 4 * n :], np.uint16 if used <= 1 << 16 else np.uint32).reshape(length, n)
    return numbers[places.T], counts.astype(np.int64)


def _blocks(numbers: np.ndarray, runs: np.ndarray, counts: np.ndarray, fans: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Blocks of runs by bucket: the number that the first of fans leave of a run's hash, mixed."""
    if not len(runs):
        return
    bucket = _bucket(_keys(numbers[runs]), fans)
    order = np.argsort(bucket, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(bucket[order])) + 1, len(order))
    scratch = np.zeros(len(numbers), np.uint8)
    at, held, size = 0, [], 0
    for end in ends.tolist():
        rows = order[at:end]
        # Counts of one block fit 32 bits; what repeats more often is said again.
        big = counts[rows]
        while len(rows):
            held.append((int(bucket[rows[0]]), _packed(numbers, runs[rows], np.minimum(big, 0xFFFFFFFF), scratch)))
            size += len(held[-1][1])
            more = big > 0xFFFFFFFF
            rows, big = rows[more], big[more] - 0xFFFFFFFF
        at = end
        if size >= 4 << 20 or end == len(order):
            yield pa.record_batch([pa.array([b for b, _ in held], pa.int64()), pa.array([x for _, x in held], pa.binary())], ["bucket", "block"])
            held, size = [], 0


def _bucket(keys: np.ndarray, fans: tuple[int, ...]) -> np.ndarray:
    """The bucket of each hash after dealing it out by each of fans in turn."""
    out = np.zeros(len(keys), np.int64)
    for fan in fans:
        out = out * fan + (keys % np.uint64(fan)).astype(np.int64)
        keys = keys // np.uint64(fan)
    return out


def _enumerated(seed: int, shard_bytes: int, fans: tuple[int, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _shards(batches, shard_bytes):
            words, pieces = split(texts)
            coded = words.dictionary_encode()
            del words
            if known := len(coded.dictionary):
                automaton = PhraseAutomaton(coded.indices.to_numpy(), pieces, known)
                numbers = _numbers(lang, coded.dictionary, seed)
                del coded, pieces
                for length in (2, 3):
                    yield from _blocks(numbers, *automaton.runs(length), fans)

    return run


def _summed(blocks: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The different runs of the blocks, by length, with the sums of their counts."""
    for length in (2, 3):
        parts = [_unpacked(b) for b in blocks if b[0] == length]
        if not parts:
            continue
        runs, counts = np.concatenate([r for r, _ in parts]), np.concatenate([c for _, c in parts])
        del parts
        keys = _keys(runs)
        order = np.argsort(keys)
        new = np.append(True, np.diff(keys[order]) != 0)
        same = runs[order]
        if (same[1:][~new[1:]] != same[:-1][~new[1:]]).any():  # two runs share a hash
            order = np.lexsort(runs.T)
            same = runs[order]
            new = np.append(True, (same[1:] != same[:-1]).any(1))
        starts = np.flatnonzero(new)
        yield same[starts], np.add.reduceat(counts[order], starts)


def _dealt_again(fans: tuple[int, ...], most: int) -> Callable:
    """Blocks -> blocks of finer buckets, combined where a task meets a run again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []

        def out() -> Iterator[pa.RecordBatch]:
            for runs, counts in _summed(held):
                numbers, at = np.unique(runs, return_inverse=True)
                yield from _blocks(numbers, at.reshape(runs.shape), counts, fans)

        for batch in batches:
            held += batch.column("block").to_pylist()
            if sum(map(len, held)) >= most:
                yield from out()
                held = []
        if held:
            yield from out()

    return run


def _frequent(least: int) -> Callable:
    names = ["length", "w1", "w2", "w3", "a"]

    def run(blocks: pa.Table) -> pa.Table:
        found = [pa.table([pa.array([], pa.int32()), *[pa.array([], pa.int64())] * 4], names)]
        for runs, counts in _summed(blocks.column("block").to_pylist()):
            runs, counts = runs[counts >= least].view(np.int64), counts[counts >= least]
            third = runs[:, 2] if runs.shape[1] == 3 else np.zeros(len(runs), np.int64)
            found.append(pa.table([pa.array(np.full(len(runs), runs.shape[1], np.int32)), *map(pa.array, (runs[:, 0].copy(), runs[:, 1].copy(), third.copy(), counts))], names))
        return pa.concat_tables(found)

    return run


def _first_rows(most: int) -> Callable:
    """Numbers each language's rows of a task, and lets go those behind the first `most`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            which, place = langs.indices.to_numpy(), np.zeros(batch.num_rows, np.int64)
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                here = np.flatnonzero(which == i)
                place[here] = seen.get(lang, 0) + 1 + np.arange(len(here))
                seen[lang] = seen.get(lang, 0) + len(here)
            keep = pa.array(place <= most)
            yield pa.record_batch([*batch.columns, pa.array(place)], [*batch.schema.names, "place"]).filter(keep)

    return run


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (left right)) in decimals of 38 digits: exact for counts below 10**15."""
    d = lambda c: f"CAST({c} AS DECIMAL(18,0))"
    return F.expr(f"CAST({d(a)} * {d(a)} * CAST(1000000 AS DECIMAL(7,0)) AS DECIMAL(38,0)) div CAST({d(left)} * {d(right)} AS DECIMAL(38,0))")


def _counted(texts: DataFrame, least: int, shard_bytes: int, bucket_bytes: int, fan: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """(words with id, lang, word, n; frequent runs with length, w1, w2, w3, a), written, and where."""
    spark = texts.sparkSession
    for seed in range(8):
        path = fresh_path(spark, "phrase-words")
        rows = texts.mapInArrow(_words(seed, shard_bytes), "id long, lang string, word string, n long")
        both = F.struct("lang", "word")
        rows = rows.groupBy("id").agg(F.min(both).alias("one"), F.max(both).alias("other"), F.sum("n").alias("n"))
        rows.select("id", "one.*", "n", (F.col("one") != F.col("other")).alias("clash")).write.parquet(path)
        words = spark.read.parquet(path)
        if not words.where("clash").head(1):
            break
        discard(spark, path)
    else:
        raise RuntimeError("words share 64-bit numbers, whatever the seed")
    total = words.agg(F.sum(F.col("n") * (F.octet_length("word") + 1))).first()[0] or 0
    buckets, fans = max(total // bucket_bytes, 64), []
    while buckets > 1:
        fans.append(int(min(buckets, fan)))
        buckets = -(-buckets // fan)
    blocks = texts.mapInArrow(_enumerated(seed, shard_bytes, tuple(fans[:1])), "bucket long, block binary")
    for k in range(2, len(fans) + 1):
        # A few tasks' buckets are no whole task's data: rounds go on dealing out what the round before brought together.
        blocks = blocks.repartition("bucket").mapInArrow(_dealt_again(tuple(fans[:k]), shard_bytes), "bucket long, block binary")
    found = fresh_path(spark, "phrase-runs")
    blocks.groupBy("bucket").applyInArrow(_frequent(least), "length int, w1 long, w2 long, w3 long, a long").write.parquet(found)
    return words, spark.read.parquet(found), [path, found]


def phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, most: int = 2000, share: int = 50,
    shard_bytes: int = SHARD_BYTES, bucket_bytes: int = BUCKET_BYTES, fan: int = 1024,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `most` best phrases of each language that occur `least` times or more.

    A phrase is dropped if a longer one that it lies in occurs share percent as often. Null text is empty, a null language is
    `und`; texts without words add nothing. Repeated rows count again. An empty table gives no rows; further columns, whatever
    their names, are ignored. Rows without ids are rows like others.
    """
    spark = docs.sparkSession
    text, lang = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    with batches_of(spark, "4m"):
        words, runs, paths = _counted(docs.select(lang.alias("lang"), text.alias("text")), least, shard_bytes, bucket_bytes, fan)
    per_lang = words.groupBy("lang").agg(F.sum("n").alias("total"))
    known = words.where(F.col("n") >= least).select("id", "lang", "word", "n")
    small = known.count() <= BROADCAST_WORDS
    known = F.broadcast(known) if small else known
    two, three = runs.where("length = 2"), runs.where("length = 3")

    pair = lambda of, x, y: of.join(known.alias("x"), F.col(x) == F.col("x.id")).join(known.alias("y"), F.col(y) == F.col("y.id"))
    # A run of two words lies in a run of three as its prefix, or as what its suffix link leads to.
    longer = three.select(F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("w"), "a")
    longer = longer.groupBy("w.w1", "w.w2").agg(F.max("a").alias("longer"))
    kept = two.join(longer, ["w1", "w2"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    kept = pair(kept, "w1", "w2").select(
        F.col("x.lang").alias("lang"), F.concat_ws(" ", "x.word", "y.word").alias("phrase"), "a", F.col("x.n").alias("l"), F.col("y.n").alias("r")
    )
    kept = kept.withColumn("score", _score("a", "l", "r"))

    first, second = two.select("w1", "w2", F.col("a").alias("prefix")), two.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("suffix"))
    whole = pair(three.join(first, ["w1", "w2"]).join(second, ["w2", "w3"]), "w1", "w3").join(known.alias("z"), F.col("w2") == F.col("z.id"))
    whole = whole.select(
        F.col("x.lang").alias("lang"), F.concat_ws(" ", "x.word", "z.word", "y.word").alias("phrase"), "a",
        F.col("x.n").alias("l1"), F.col("suffix").alias("r1"), F.col("prefix").alias("l2"), F.col("y.n").alias("r2"),
    )
    cut = lambda k: F.struct(_score("a", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
    whole = whole.select("lang", "phrase", "a", F.least(cut(1), cut(2)).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    scored = fresh_path(spark, "phrase-scores")
    kept.unionByName(whole).write.parquet(scored)
    order = [F.col("lang"), F.desc("score"), F.desc("a"), F.col("phrase")]
    ordered = spark.read.parquet(scored).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    best = fresh_path(spark, "phrase-best")
    ordered.mapInArrow(_first_rows(most), "lang string, phrase string, a long, l long, r long, score long, part int, place long").write.parquet(best)
    totals = fresh_path(spark, "phrase-totals")
    per_lang.write.parquet(totals)
    for x in (*paths, scored):
        discard(spark, x)
    found = spark.read.parquet(best)
    # One row a task and language.
    parts = found.groupBy("lang", "part").agg(F.max("place").alias("rows"))
    upto = W.partitionBy("lang").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("lang", "part", F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("before"))
    ranked = found.join(parts, ["lang", "part"]).withColumn("rank", F.col("before") + F.col("place")).where(F.col("rank") <= most)
    return ranked.join(spark.read.parquet(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


ORACLE = r"""
WITH p AS (
  SELECT row_number() OVER () AS piece, lang, regexp_extract_all(part, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part FROM documents)),
t AS MATERIALIZED (SELECT piece, lang, unnest(w) AS a1, generate_subscripts(w, 1) AS i FROM p),
g AS MATERIALIZED (SELECT lang, a1, lead(a1) OVER x AS a2, lead(a1, 2) OVER x AS a3 FROM t WINDOW x AS (PARTITION BY piece ORDER BY i)),
c1 AS MATERIALIZED (SELECT lang, a1, count(*) AS f FROM g GROUP BY ALL),
c2 AS MATERIALIZED (SELECT lang, a1, a2, count(*) AS f FROM g WHERE a2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
c3 AS MATERIALIZED (SELECT lang, a1, a2, a3, count(*) AS f FROM g WHERE a3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM c1 GROUP BY lang),
s2 AS (SELECT lang, a1 || ' ' || a2 AS phrase, c2.f AS a, x.f AS l, y.f AS r, 1 AS k FROM c2
  JOIN c1 x USING (lang, a1) JOIN (SELECT lang, a1 AS a2, f FROM c1) y USING (lang, a2)
  WHERE NOT EXISTS (SELECT 1 FROM c3 WHERE c3.lang = c2.lang AND 100 * c3.f >= 50 * c2.f AND ((c3.a1 = c2.a1 AND c3.a2 = c2.a2) OR (c3.a2 = c2.a1 AND c3.a3 = c2.a2)))),
s3 AS (
  SELECT lang, a1 || ' ' || a2 || ' ' || a3 AS phrase, c3.f AS a, x.f AS l, y.f AS r, 1 AS k FROM c3
    JOIN c1 x USING (lang, a1) JOIN (SELECT lang, a1 AS a2, a2 AS a3, f FROM c2) y USING (lang, a2, a3)
  UNION ALL
  SELECT lang, a1 || ' ' || a2 || ' ' || a3, c3.f, x.f, y.f, 2 FROM c3
    JOIN c2 x USING (lang, a1, a2) JOIN (SELECT lang, a1 AS a3, f FROM c1) y USING (lang, a3)),
s AS (SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM (FROM s2 UNION ALL FROM s3)),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM b JOIN n USING (lang) QUALIFY rank <= 2000
"""
