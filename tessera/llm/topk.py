"""Exact top-k search by inner product with no-random-access aggregation over sorted lists.

Queries are few beside the candidates: they are sent to all tasks in blocks of a bounded number of bytes, one block after
the other, and candidates never leave their partition. A task takes its candidates by blocks too. In a block every
dimension is a list of the candidates sorted by their component, which a query reads from the end that its own component
favours. At each stop of the reading a candidate's score lies between what was read of it plus the worst that each unread
list can give, and what was read plus the last value read from each of them. The k-th best lower bound, or the k-th best
score of the blocks before if that is higher, is what a candidate's upper bound must reach; a query that no outsider can
qualify for stops, at the lists' heads already if the whole block is too low. Those left have their scores resolved. The
tasks' best are merged by a window; the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import materialised

#: Where reading stops to look at the bounds, as shares of the lists.
STOPS = (1 / 16, 1 / 8, 1 / 4, 1 / 2, 3 / 4, 7 / 8, 15 / 16)


class SortedLists:
    """A block of candidates as one sorted list for each dimension, which queries read from either end.

    What all lists have given down to a depth is kept as two bitmaps (from the high ends, from the low ends), so reading on
    is a matrix product for many queries at once."""

    def __init__(self, rows: np.ndarray):
        self.rows, (self.n, d) = rows.astype(np.float64), rows.shape
        order = np.argsort(self.rows, axis=0, kind="stable")
        self.values = np.take_along_axis(self.rows, order, axis=0)
        self.place = np.empty((self.n, d), np.int32)
        np.put_along_axis(self.place, order, np.arange(self.n, dtype=np.int32)[:, None], axis=0)

    def heads(self, q: np.ndarray) -> np.ndarray:
        """What the best candidate of the block could score at most, for each query: nothing is read."""
        return np.maximum(q, 0) @ self.values[-1] + np.minimum(q, 0) @ self.values[0]

    def bounds(self, depth: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (candidates x queries) of the scores after reading each list down to depth."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        high, low = (self.place >= self.n - depth).astype(np.float64), (self.place < depth).astype(np.float64)
        read = (self.rows * high) @ up.T + (self.rows * low) @ down.T

        def unread(from_high: np.ndarray, from_low: np.ndarray) -> np.ndarray:
            """The sum over the lists in which a candidate was not met yet, if each gave the value named."""
            a, b = up * from_high, down * from_low
            return (a + b).sum(1) - (high @ a.T + low @ b.T)

        lower = read + unread(self.values[0], self.values[-1])
        upper = read + unread(self.values[self.n - depth], self.values[depth - 1])
        return lower, upper


class Reader:
    """Reads one block after the other for the same queries. Lists are read to the first stop at which the block before
    ruled out anything, and from there stop by stop."""

    def __init__(self, k: int):
        self.k, self.first, self.read, self.size = k, 0, 0.0, 0.0

    def qualified(self, lists: SortedLists, q: np.ndarray, skip: np.ndarray, least: np.ndarray) -> list[np.ndarray]:
        """For each query the candidates that may be among its k best; skip (candidates x queries) marks those that may not, and
        least is the score that must be reached."""
        n, none = lists.n, np.zeros(0, np.int64)
        # Sums of doubles are off by less than this; bounds give way by it.
        slack = 1e-12 * (np.abs(q) @ np.maximum(np.abs(lists.values[0]), np.abs(lists.values[-1])))
        found = [np.flatnonzero(~skip[:, i]) if reaches else none for i, reaches in enumerate(lists.heads(q) + slack >= least)]
        upto = np.where([len(f) > 0 for f in found], 1.0, 0.0)
        ruled_out = len(STOPS) - 1
        for s in range(self.first, len(STOPS)):
            depth = int(STOPS[s] * n)
            active = [i for i in range(len(q)) if len(found[i]) > 4 * self.k]
            if not active or not 0 < depth < n:
                continue
            lower, upper = lists.bounds(depth, q[active])
            lower[skip[:, active]] = -np.inf
            kth = np.partition(lower, n - self.k, axis=0)[n - self.k] if n > self.k else np.full(len(active), -np.inf)
            for c, i in enumerate(active):
                before = len(found[i])
                found[i] = found[i][upper[found[i], c] + slack[i] >= max(kth[c] - slack[i], least[i])]
                if 2 * len(found[i]) < before:
                    ruled_out = min(ruled_out, s)
                if len(found[i]) <= 4 * self.k:
                    upto[i] = STOPS[s]
        self.first = ruled_out
        self.read, self.size = self.read + float(upto.sum()) * n, self.size + float(len(q)) * n
        return found


def _search(sent: Broadcast, k: int, block: int, at_once: int = 256):
    """sent: for each length of vectors the queries' ids, marks and components. Candidates (vec_id, v) -> each query's best of
    the task."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = sent.value
        readers = {d: [Reader(k) for _ in range(0, len(ids), at_once)] for d, (ids, _, _) in queries.items()}
        best = {d: [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids) for d, (ids, _, _) in queries.items()}
        held: dict[int, list] = {}
        rows = 0

        def flush() -> None:
            for d, parts in held.items():
                ids, marks, asks = queries[d]
                own, vectors = (np.concatenate(x) for x in zip(*parts))
                lists = SortedLists(vectors)
                for at in range(0, len(ids), at_once):
                    part = slice(at, at + at_once)
                    least = np.array([scores[-1] if len(scores) == k else -np.inf for _, scores in best[d][part]], float)
                    skip = own[:, None] == ids[None, part]
                    for i, found in enumerate(readers[d][at // at_once].qualified(lists, asks[part].astype(float), skip, least), at):
                        if len(found):
                            all_ids, scores = np.concatenate([best[d][i][0], own[found]]), np.concatenate([best[d][i][1], vectors[found] @ asks[i]])
                            order = np.lexsort((all_ids, -scores))[:k]
                            best[d][i] = all_ids[order], scores[order]
            held.clear()

        for batch in batches:
            size = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for d in np.unique(size).tolist():
                if d in queries:
                    own = batch.filter(pa.array(size == d))
                    for at in range(0, own.num_rows, block):
                        part = own.slice(at, block)
                        held.setdefault(d, []).append((part.column(0).to_numpy(), part.column(1).flatten().to_numpy().reshape(-1, d)))
                        rows += part.num_rows
                        if rows >= block:
                            flush()
                            rows = 0
        if held:
            flush()
        for d, (ids, marks, _) in queries.items():
            sizes = [len(x) for x, _ in best[d]]
            if sum(sizes):
                columns = [np.repeat(ids, sizes), np.repeat(marks, sizes), *(np.concatenate([x[c] for x in best[d]]) for c in (0, 1))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "mark", "vec_id", "score"])

    return search


def top_k(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    every: int = 50,
    scale: int = 256,
    candidate_block: int = 4096,
    query_block: int = 16_384,
    query_bytes: int = 32_000_000,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id is divisible by `every`, its k best among all other rows.

    Components become floor(scale * x), as 64-bit integers (what lies beyond them becomes the nearest of them), and scores are
    64-bit sums. Rows with a null id take no part, nor do vectors that are null, empty, or hold a null or non-finite
    component. Vectors of another length than the query's are no candidates for it. Ties go to the smaller id. A repeated
    query row is one query; repeated candidates are candidates of their own, but never for a query of their id. An empty
    table gives an empty result; further columns are ignored.
    """
    x, spark = F.col("x"), vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size(x) > 0) & finite)
    rows = materialised(rows.select("vec_id", F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v")))
    asks = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"]).withColumn("mark", F.xxhash64("v"))
    asks = materialised(asks)
    n, components = asks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    turns = max(1, -(-n // query_block), -(-8 * components // query_bytes))
    turn = F.pmod(F.xxhash64("vec_id", "mark"), F.lit(turns))
    found = None
    for t in range(turns):  # about query_block queries, or query_bytes of them, pass the driver at a time
        table = asks.where(turn == t).select("vec_id", "mark", "v").toArrow()
        sizes = pc.list_value_length(table.column("v")).to_numpy()
        asked = {}
        for d in np.unique(sizes).tolist():
            own = table.filter(pa.array(sizes == d))
            asked[d] = own.column("vec_id").to_numpy(), own.column("mark").to_numpy(), own.column("v").combine_chunks().flatten().to_numpy().reshape(-1, d)
        sent = spark.sparkContext.broadcast(asked)
        part = materialised(rows.mapInArrow(_search(sent, k, candidate_block), "query_id long, mark long, vec_id long, score long"))
        sent.unpersist()
        found = part if found is None else found.unionByName(part)
    order = W.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
