"""Packing documents into windows of tokens by lexical retrieval.

The documents are sharded as Spark reads them: a shard is a run of one task's rows, of bounded length. Each shard has
a BM25 inverted index. A seed document opens a window, and the documents of its shard that match it best and are still
unused fill it, greedily. The document that no longer fits is cut; its rest opens the next window and is its seed. So
every window is full, save that the last tokens of each task go to windows whose lengths are powers of two, which need no
padding. Nothing is shuffled: a shard never meets another.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches
from tessera.llm.tokenize import END_ID, groups, ranges, terms_of, tokenizer  # noqa: F401

#: BM25's usual constants.
K1, B = 1.2, 0.75


class Bm25Index:
    """An inverted index over documents given as arrays of term numbers (hashes: only their equality counts).

    Terms that many documents hold are rows of a matrix instead of lists; the scores are the same."""

    def __init__(self, terms: list[np.ndarray]):
        self.n = len(terms)
        counted = [np.unique(t, return_counts=True) for t in terms]
        term = np.concatenate([c[0] for c in counted]) if terms else np.zeros(0, np.int32)
        doc = np.repeat(np.arange(self.n, dtype=np.int32), [len(c[0]) for c in counted])
        tf = np.concatenate([c[1] for c in counted]) if terms else np.zeros(0)
        order = np.argsort(term, kind="stable")
        term, self.doc, tf = term[order], doc[order], tf[order]
        edge = np.concatenate([[True], term[1:] != term[:-1]]) if len(term) else np.zeros(0, bool)
        self.begins = np.append(np.flatnonzero(edge), len(term))
        df = np.diff(self.begins)
        idf = np.log(1 + (self.n - df + 0.5) / (df + 0.5))
        length = np.array([len(t) for t in terms], float)
        norm = K1 * (1 - B + B * length / max(1.0, length.mean() if self.n else 1.0))
        self.weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[self.doc])
        # Each document's terms, but for those that find nothing else, as places in the index.
        place = np.empty(len(term), np.int64)
        place[order] = np.cumsum(edge) - 1
        ends = np.cumsum([len(c[0]) for c in counted])
        common = df > max(8, self.n // 3)
        row = np.cumsum(common) - 1
        self.matrix = np.zeros((int(common.sum()), self.n))
        often = np.repeat(common, df)
        self.matrix[np.repeat(row, df)[often], self.doc[often]] = self.weight[often]
        own = np.split(place, ends[:-1]) if self.n else []
        self.common = [row[x[common[x]]] for x in own]
        self.rare = [x[(df[x] > 1) & ~common[x]] for x in own]

    def forget(self, used: np.ndarray) -> None:
        """Takes the documents marked as used out of the lists; their scores mean nothing from now on."""
        kept = ~used[self.doc]
        self.begins = np.concatenate([[0], np.cumsum(kept)])[self.begins]
        self.doc, self.weight = self.doc[kept], self.weight[kept]

    def scores(self, doc: int) -> np.ndarray:
        """The BM25 score of every document for the terms of doc."""
        at = self.rare[doc]
        posting = ranges(self.begins[at], self.begins[at + 1] - self.begins[at])
        score = np.bincount(self.doc[posting], self.weight[posting], self.n)
        own = np.zeros(len(self.matrix))
        own[self.common[doc]] = 1
        return (score + own @ self.matrix).round(9)


class Packer:
    """Windows of one task, in order. A piece is (document, start, length, window, offset)."""

    def __init__(self, window: int):
        self.window, self.number, self.used = window, 0, 0
        self.open: list[list] = []  # pieces of the open window

    def add(self, doc, start: int, length: int) -> Iterator[list]:
        """Puts tokens of doc into the open window and as many more as it takes; gives the pieces of windows now full."""
        while length:
            take = min(length, self.window - self.used)
            self.open.append([doc, start, take, self.number, self.used])
            start, length, self.used = start + take, length - take, self.used + take
            if self.used == self.window:
                yield from self.open
                self.open, self.used, self.number = [], 0, self.number + 1

    def close(self) -> Iterator[list]:
        """The open window's tokens, as windows of falling powers of two."""
        sizes = [1 << k for k in range(self.used.bit_length() - 1, -1, -1) if self.used >> k & 1]
        held, room, offset = self.open, 0, 0
        for doc, start, length, *_ in held:
            while length:
                if not room:
                    room, offset = sizes.pop(0), 0
                take = min(length, room)
                yield [doc, start, take, self.number, offset]
                start, length, room, offset = start + take, length - take, room - take, offset + take
                if not room:
                    self.number += 1
        self.open, self.used = [], 0


def _best_first(score: np.ndarray, many: int = 64) -> Iterator[int]:
    """The places of positive scores, highest first, then by place; few of them are asked for as a rule."""
    found = np.flatnonzero(score > 0)
    least = 0.0 if len(found) <= many else np.partition(score[found], len(found) - many)[len(found) - many]
    for part in (found[score[found] >= least], found[score[found] < least]):
        yield from part[np.argsort(-score[part], kind="stable")].tolist()


def _fill(packer: Packer, index: Bm25Index, ids: list, lengths: list[int], base: int) -> Iterator[list]:
    """Packs the documents base, base + 1, ... of a shard. Copies of an id don't share a window while others are left."""
    unused = np.ones(index.n, bool)
    turn, seed, listed = 0, -1, index.n
    while True:
        if 4 * (left := int(np.count_nonzero(unused))) < 3 * listed:
            index.forget(~unused)
            listed = left
        if packer.used == 0 or seed < 0:
            while turn < index.n and not unused[turn]:
                turn += 1
            if turn == index.n:
                return
            seed = turn
            unused[seed] = False
            yield from packer.add(base + seed, 0, lengths[seed])
            if packer.used == 0:
                continue
        score = np.where(unused, index.scores(seed), 0)
        number, seed = packer.number, -1
        inside = {ids[p[0] - base] for p in packer.open if p[0] >= base}
        for d in _best_first(score):
            if ids[d] is not None and ids[d] in inside:
                continue
            unused[d] = False
            inside.add(ids[d])
            yield from packer.add(base + d, 0, lengths[d])
            if packer.number != number:
                seed = d if packer.used else -1  # its rest opens the next window
                break


def pack(
    docs: DataFrame,
    tokenizer_file: str,
    kind: str = "bytes",
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 2048,
    shard_docs: int = 1024,
    shard_chars: int = 8_000_000,
    cache_pieces: int = 1_000_000,
    group_chars: int = 8_000_000,
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each row of docs is a document of its own, repeated rows too: its ids and the end id. Null or empty text is the end id
    alone. cache_pieces bounds what a Python worker remembers (about 50 bytes a piece), group_chars the texts that it encodes at
    once. A text longer than a window fills
    windows by itself. Every id lies in one piece. Further columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = tokenizer(tokenizer_file, kind, cache_pieces, True), Packer(window)
        task = TaskContext.get().partitionId() << 32
        doc_ids: list = []
        tokens: list[np.ndarray] = []
        terms: list[np.ndarray] = []
        base = chars = 0
        carried: dict[int, tuple] = {}  # documents of earlier shards that the open window still holds

        def rows_of(pieces: list[list]) -> pa.RecordBatch:
            cut = []
            for d, start, length, number, offset in pieces:
                doc_id, own = carried[d] if d < base else (doc_ids[d - base], tokens[d - base])
                cut.append((doc_id, start, length, zlib.crc32(own[start : start + length].astype("<u4")), len(own), task + number, offset))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            columns = list(zip(*cut)) or [()] * 7
            kinds = [id_arrow[0], *[pa.int64()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        def shard() -> pa.RecordBatch:
            lengths = [len(t) for t in tokens]
            return rows_of(list(_fill(packer, Bm25Index(terms), doc_ids, lengths, base)))

        id_arrow: list = []
        for batch in batches:
            id_arrow[:] = [batch.schema.field(0).type]
            for part, texts in groups(batch, 1, group_chars):
                ids, lengths, words, counts = encoder.encode_all(texts, END_ID)
                doc_ids += part.column(0).to_pylist()
                tokens += np.split(ids, np.cumsum(lengths)[:-1])
                terms += np.split(words, np.cumsum(counts)[:-1])
                chars += sum(map(len, texts))
                if len(tokens) >= shard_docs or chars >= shard_chars:
                    yield shard()
                    keep = {p[0] for p in packer.open}
                    carried = {d: carried[d] if d < base else (doc_ids[d - base], tokens[d - base]) for d in keep}
                    base, chars = base + len(tokens), 0
                    doc_ids, tokens, terms = [], [], []
        if tokens:
            yield shard()
        if packer.open:
            yield rows_of(list(packer.close()))

    return rows.mapInArrow(
        packed, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
