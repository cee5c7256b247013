"""Removing passages that repeat an earlier document, by suffix automata of reference shards.

A window is `window` consecutive words of one document. Every word that lies in a window which an earlier document (one
with a smaller id) holds too is removed; windows are judged on the documents as they came.

Sending the automaton of every reference shard to every task would make the work grow with the square of the corpus.
So shards are made such that a passage can only match inside one of them, and each automaton meets just those passages:

1. Each window is keyed by its minimizer, the smallest hash among its runs of `gram` words. Equal windows have equal
   keys. Neighbouring windows mostly share one, so a document falls into short passages with a key each.
2. Keys that only one document has are dropped: Spark aggregates narrow (key, id) rows.
3. The passages of the other keys are cut out of the texts and dealt by key, in the order of the ids. A task streams them
   past the automaton of their key: it takes the matching statistics of a passage, reports the spans in which they reach
   the window's length, and then adds the passage to the reference.
4. Spans are brought back to their documents.

Keys are hashes, matches are not: only equal words count. The passages of a key that more than `hot_rows` share don't go to
one task: Spark's partial aggregation finds the first document of each passage, and every later one loses the passage by a
join; of the different passages, a row each, the windows are compared in the same way. So an automaton meets `hot_rows`
passages at most, however common a phrase is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.automaton import SuffixAutomaton
from tessera.llm.common import fresh_path, materialised, release
from tessera.llm.hashes import run_hashes, word_hashes

#: A spot is 20 bits of a hash of the text (where ids repeat, they tell their rows apart), the first word, and the windows.
_MARK, _FIRST, _RUN = 20, 35, 8
#: Words hashed at once.
_BLOCK = 1 << 18


def passages(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, windows) of each maximal run of windows that share the place of their minimizer."""
    n = len(words) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    grams = run_hashes(word_hashes(words), gram)
    span = window - gram + 1
    best = np.empty(n, np.int64)
    for i in range(0, n, _BLOCK):
        part = np.lib.stride_tricks.sliding_window_view(grams[i : i + _BLOCK + span - 1], span)[: min(_BLOCK, n - i)]
        best[i : i + len(part)] = np.arange(i, i + len(part)) + part.argmin(axis=1)
    first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    return grams[best[first]].view(np.int64), first, np.diff(np.append(first, n))


def _mark_of(text: bytes, marked: bool) -> int:
    return xxhash.xxh64_intdigest(text) >> (64 - _MARK) if marked else 0


def _keyed(docs: DataFrame, window: int, gram: int, marked: bool) -> DataFrame:
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, spots = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                key, first, run = passages(text.split(), window, gram)
                keys.append(key)
                ids.append(np.full(len(key), doc_id, np.int64))
                spots.append(_mark_of(text, marked) << (_FIRST + _RUN) | first << _RUN | run)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, ids, spots)], ["key", "doc_id", "spot"])

    return docs.where("doc_id IS NOT NULL AND text <> ''").mapInArrow(keyed, "key long, doc_id long, spot long")


def _cut(window: int, marked: bool, hot: bool):
    """(text, doc_id, found) -> the passages found, with their words; only hot ones or only others. A passage that a document
    repeats is one row: `more` holds the first words of the repeats, as 64-bit integers."""
    wanted = hot

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "doc_id", "spot", "more", "passage"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]

        def rows(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)

        for batch in batches:
            out: list[tuple] = []
            size = 0
            for i in np.flatnonzero(batch.column(2).is_valid().to_numpy(zero_copy_only=False)).tolist():
                doc_id, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py().encode()
                words, mark = text.split(), _mark_of(text, marked)
                places: dict[tuple[int, bytes], list[int]] = {}
                found = batch.column(2)[i].values
                for spot, key, hot in zip(*(found.field(k).to_pylist() for k in range(3))):
                    if hot != wanted or spot >> (_FIRST + _RUN) != mark:
                        continue
                    first, run = spot >> _RUN & ((1 << _FIRST) - 1), spot & ((1 << _RUN) - 1)
                    passage = b" ".join(words[first : first + run + window - 1])
                    places.setdefault((key, passage), []).append(first)
                for (key, passage), at in places.items():
                    out.append((key, doc_id, mark << (_FIRST + _RUN) | at[0] << _RUN | passage.count(b" ") + 2 - window, at[1:] or None, passage))
                    size += len(passage) + 8 * len(at)
                if size > 8_000_000:
                    yield rows(out)
                    out, size = [], 0
            if out:
                yield rows(out)

    return cut


class _Shard:
    """The reference of one key: passages of documents before the one that is being judged."""

    def __init__(self) -> None:
        self.known: set[bytes] = set()
        self.waiting: list[bytes] = []
        self.automaton = SuffixAutomaton()

    def spans(self, passage: bytes, window: int) -> list[tuple[int, int]]:
        """Maximal runs of words covered by windows that the reference has: (first word, last word + 1)."""
        words = passage.split()
        if passage in self.known:  # its matching statistics are 1, 2, 3, ...
            return [(0, len(words))]
        for other in self.waiting:
            self.automaton.add(other.split())
        self.waiting = []
        out: list[tuple[int, int]] = []
        for end, length in enumerate(self.automaton.matching(words), 1):
            if length >= window:
                if out and out[-1][1] >= end - window:
                    out[-1] = (out[-1][0], end)
                else:
                    out.append((end - window, end))
        return out

    def add(self, passage: bytes) -> None:
        if passage not in self.known:
            self.known.add(passage)
            self.waiting.append(passage)


def _matched(window: int):
    """Passages by key and id -> (doc_id, spot of the passage, first word, last word + 1)."""

    def spans(out: tuple[list, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "mark", "start", "stop"])

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, doc, fresh = None, _Shard(), None, []
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for key, doc_id, spot, more, passage in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now:
                    now, shard, doc, fresh = key, _Shard(), doc_id, []
                elif doc_id != doc:
                    for x in fresh:
                        shard.add(x)
                    doc, fresh = doc_id, []
                if shard.known:
                    first = spot >> _RUN & ((1 << _FIRST) - 1)
                    firsts = [first, *more] if more else [first]
                    for start, end in shard.spans(passage, window):
                        for f in firsts:
                            for x, v in zip(out, (doc_id, spot >> (_FIRST + _RUN), f + start, f + end)):
                                x.append(v)
                fresh.append(passage)
                if len(out[0]) > 100_000:
                    yield spans(out)
                    out = ([], [], [], [])
            yield spans(out)

    return matched


def _removed(batches: Iterator[pa.RecordBatch], marked: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) -> the document's counts and the text that is left."""
    for batch in batches:
        counts, gone, left = [], [], []
        for i in range(batch.num_rows):
            text = batch.column(1)[i].as_py().encode()
            words = text.split()
            keep = np.ones(len(words), bool)
            spans, own = batch.column(2)[i], _mark_of(text, marked)
            if spans.is_valid:
                for mark, start, stop in zip(*(spans.values.field(k).to_pylist() for k in range(3))):
                    if mark == own:
                        keep[start:stop] = False
            counts.append(len(words))
            gone.append(len(words) - int(keep.sum()))
            left.append(b" ".join([words[k] for k in np.flatnonzero(keep).tolist()]) if gone[-1] else b" ".join(words))
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])


#: Hot passages that are broadcast at most (about 150 bytes each); beyond it Spark joins them by shuffling.
BROADCAST_PASSAGES = 100_000


def _hot_spans(with_found: DataFrame, window: int, marked: bool, columns: str) -> DataFrame:
    """(doc_id, mark, start, stop) of the windows of hot keys that an earlier document has."""
    path = fresh_path(with_found.sparkSession, "hot-passages")
    with_found.where(F.exists("found", lambda x: x["hot"])).mapInArrow(_cut(window, marked, True), columns).write.parquet(path)
    rows = with_found.sparkSession.read.parquet(path)
    first = materialised(rows.groupBy("key", "passage").agg(F.min("doc_id").alias("first_id")))
    held = rows.join(F.broadcast(first) if first.count() <= BROADCAST_PASSAGES else first, ["key", "passage"])
    at = F.shiftrightunsigned("spot", _RUN).bitwiseAND(F.lit((1 << _FIRST) - 1))
    starts = F.concat(F.array(at), F.coalesce("more", F.array().cast("array<long>")))
    mark, run = F.shiftright("spot", _FIRST + _RUN).alias("mark"), F.col("spot").bitwiseAND(F.lit((1 << _RUN) - 1))
    later = held.where("doc_id > first_id").select("doc_id", mark, F.explode(starts).alias("start"), run.alias("run"))
    later = later.select("doc_id", "mark", "start", (F.col("start") + F.col("run") + (window - 1)).alias("stop"))
    words = F.split(F.col("passage").cast("string"), " ")
    windows = F.transform(F.sequence(F.lit(1), run.cast("int")), lambda i: F.array_join(F.slice(words, i, window), " "))
    own = held.where("doc_id = first_id").select("doc_id", mark, starts.alias("starts"), F.posexplode(windows).alias("place", "words"))
    shared = own.groupBy("words").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id").drop("last_id")
    seen = own.join(shared, "words").where("doc_id > first_id").select("doc_id", "mark", "place", F.explode("starts").alias("at"))
    start = F.col("at") + F.col("place")
    return later.unionByName(seen.select("doc_id", "mark", start.alias("start"), (start + window).alias("stop")))


def drop_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, gram: int = 6, hot_rows: int = 2_000
) -> DataFrame:
    """One row for each row of docs: doc_id (long), n_words, n_removed, kept (the words that stay, joined by one space).

    Ids are integers. Null text has no words. A null id has no order: its row neither loses words nor takes any from
    others. Rows that share an id take none from each other. Texts under `window` words keep all. An empty table gives an
    empty result; further columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spark = docs.sparkSession
    marked = not rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()
    keyed = _keyed(rows, window, gram, marked)
    shared = keyed.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    shared = materialised(shared.select(F.col("key").alias("shared_key"), (F.col("n") > hot_rows).alias("hot")))
    release(spark)
    found = keyed.join(shared, F.col("key") == F.col("shared_key")).groupBy("doc_id").agg(F.collect_list(F.struct("spot", "key", "hot")).alias("found"))
    # Narrow rows, written in columns: a fraction of the shuffle that they came from and that can go now.
    path = fresh_path(spark, "passages")
    found.write.parquet(path)
    found = spark.read.parquet(path)
    release(spark)
    # Both joins are left joins of the same rows by id, so that the texts are dealt once.
    with_found = rows.join(found.withColumnRenamed("doc_id", "found_id"), F.col("doc_id") == F.col("found_id"), "left")
    with_found = with_found.select("doc_id", "text", "found")
    columns = "key long, doc_id long, spot long, more array<long>, passage binary"
    cold = with_found.mapInArrow(_cut(window, marked, False), columns)
    dealt = cold.repartition("key").sortWithinPartitions("key", "doc_id")
    spans = dealt.mapInArrow(_matched(window), "doc_id long, mark long, start long, stop long")
    if shared.where("hot").head(1):
        spans = spans.unionByName(_hot_spans(with_found, window, marked, columns))
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("mark", "start", "stop")).alias("spans"))
    with_spans = rows.join(spans.withColumnRenamed("doc_id", "span_id"), F.col("doc_id") == F.col("span_id"), "left")
    return with_spans.select("doc_id", "text", "spans").mapInArrow(lambda b: _removed(b, marked), "doc_id long, n_words long, n_removed long, kept string")


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
