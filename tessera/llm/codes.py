"""Vector codes: Lloyd's iteration over the parts of vectors with Hamerly's bounds, in exact integers.

A vector's components become integers and are cut into `parts` equal runs; each part position has a codebook of `entries`
points. What is known of a vector's parts is written after each pass beside its integers: the nearest entry, one upper bound
of the distance to it, and one lower bound of the distance to the second-nearest. When entries move, the upper bound grows by
its own entry's move and the lower bound shrinks by the furthest move among the others. A part whose upper bound is strictly
below its lower bound (or below half the way from its entry to the next one) has kept its entry, and no other entry can tie
with it; else the upper bound is made exact, and only if that fails too is the part compared with all entries, in integers,
where the lowest index of the nearest wins.

Bounds are single floats, rounded outwards. Tasks hold one batch and one codebook; codebooks (parts x entries points) are all
that reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, fresh_path

#: Integers are at most this large: squared distances of vectors, and sums of them, must fit 64 bits.
LARGEST = 1 << 27
#: Labels up to this many (under 50 bytes each) are broadcast with their sums; beyond it Spark joins them by shuffling.
BROADCAST_LABELS = 200_000


def _up(x: np.ndarray) -> np.ndarray:
    """As single floats that are no smaller. Doubles may be off by one place, so they give way first."""
    x = np.nextafter(x, np.inf)
    y = x.astype(np.float32)
    return np.where(y < x, np.nextafter(y, np.float32(np.inf)), y)


def _down(x: np.ndarray) -> np.ndarray:
    return -_up(-x)


def _root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


class Codebooks:
    """One codebook for each part position: points[part, entry] are integers."""

    def __init__(self, points: np.ndarray, before: np.ndarray | None = None):
        self.points = points
        self.norms = (points * points).sum(-1)
        n, k, _ = points.shape
        apart = ((points[:, :, None, :] - points[:, None, :, :]) ** 2).sum(-1)
        apart[:, np.arange(k), np.arange(k)] = np.iinfo(np.int64).max
        #: Half the way from each entry to the next one.
        self.half = _down(_root(apart.min(-1)) / 2) if k > 1 else np.full((n, k), np.inf, np.float32)
        self.moved = np.zeros((n, k), np.float32) if before is None else _up(_root(((points - before) ** 2).sum(-1)))
        # The furthest move of any other entry.
        two = np.sort(np.concatenate([self.moved, np.zeros((n, 1), np.float32)], 1), 1)[:, -2:]
        self.others = np.where(np.arange(k) == self.moved.argmax(1)[:, None], two[:, :1], two[:, 1:])

    def own(self, x: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Squared distances of all parts to the entries in code."""
        return ((x - self.points[np.arange(x.shape[1]), code]) ** 2).sum(-1)

    def scan(self, part: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest entry of each row (the lowest index of equals), and bounds of the distances to it and to the second."""
        d = (x * x).sum(-1)[:, None] - 2 * (x @ self.points[part].T) + self.norms[part]
        first = d.argmin(1)
        here = np.arange(len(x))
        nearest = d[here, first]
        d[here, first] = np.iinfo(np.int64).max
        return first, _up(_root(nearest)), _down(_root(d.min(1)))

    def assigned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """code, upper and lower of vectors of which nothing is known."""
        n, parts, _ = x.shape
        code, upper, lower = np.zeros((n, parts), np.int16), np.zeros((n, parts), np.float32), np.zeros((n, parts), np.float32)
        for p in range(parts):
            code[:, p], upper[:, p], lower[:, p] = self.scan(p, x[:, p])
        return code, upper, lower

    def reassigned(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Moves code, upper and lower on from the codebooks before to these, in place; the number of parts that were scanned."""
        at = np.arange(x.shape[1])
        upper[:] = _up(upper.astype(np.float64) + self.moved[at, code])
        lower[:] = _down(lower.astype(np.float64) - self.others[at, code])
        least = np.maximum(lower, self.half[at, code])
        rows, part = np.nonzero(~(upper < least))
        exact = ((x[rows, part] - self.points[part, code[rows, part]]) ** 2).sum(-1)
        upper[rows, part] = _up(_root(exact))
        fails = ~(upper < least)
        for p in range(x.shape[1]):
            if len(rows := np.flatnonzero(fails[:, p])):
                code[rows, p], upper[rows, p], lower[rows, p] = self.scan(p, x[rows, p])
        return int(fails.sum())


def _blocks(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            yield batch, v.reshape(batch.num_rows, parts, -1)


def _known(batch: pa.RecordBatch, name: str, parts: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, parts).copy()


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.reshape(-1)))


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(vec_id, label, v): rows whose vector is whole and finite, as integers floor(scale * x)."""
    v = F.col(vector_col)
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    large = F.raise_error(F.concat(F.lit("a component is too large for exact distances: "), F.array_max(v).cast("string"))).cast("array<int>")
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("int"))
    whole = F.when(F.exists(v, lambda x: F.abs(x.cast("double") * scale) > float(LARGEST)), large).otherwise(whole)
    return vectors.where(good).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), whole.alias("v"))


def _pass(parts: int, books: Codebooks, first: bool, last: bool) -> Callable:
    """One pass over all rows; the last one gives codes and errors instead of what another pass needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, parts):
            if first:
                code, upper, lower = books.assigned(x)
            else:
                code, upper, lower = (_known(batch, name, parts) for name in ("code", "upper", "lower"))
                books.reassigned(x, code, upper, lower)
            kept = [batch.column("vec_id"), batch.column("label")]
            if last:
                digits = code.astype(np.uint8).tobytes().hex()
                text = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
                yield pa.record_batch([*kept, pa.array(text, pa.string()), pa.array(books.own(x, code).sum(1))], ["vec_id", "label", "code", "error"])
            else:
                yield pa.record_batch([*kept, batch.column("v"), _lists(code), _lists(upper), _lists(lower)], ["vec_id", "label", "v", "code", "upper", "lower"])

    return run


def _totals(parts: int, entries: int, width: int) -> Callable:
    """Sums of each entry's parts, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch, x in _blocks(batches, parts):
            where = np.broadcast_to(np.arange(parts), (len(x), parts)), _known(batch, "code", parts)
            np.add.at(sums, where, x)
            np.add.at(count, where, 1)
        part, entry = np.nonzero(count)
        columns = [part.astype(np.int32), entry.astype(np.int32), count[part, entry], *sums[part, entry].T]
        yield pa.record_batch([pa.array(c) for c in columns], ["part", "entry", "n", *(f"s{i}" for i in range(width))])

    return run


def _updated(state: DataFrame, points: np.ndarray) -> np.ndarray:
    """Each entry's parts' floor(sum / count) by component; unused entries stay. parts x entries rows reach the driver."""
    parts, entries, width = points.shape
    names = [f"s{i}" for i in range(width)]
    schema = ", ".join(["part int", "entry int", "n long", *(f"{x} long" for x in names)])
    partial = state.select("v", "code").mapInArrow(_totals(parts, entries, width), schema)
    out = points.copy()
    for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names]).collect():
        out[r.part, r.entry] = [r[x] // r.n for x in names]
    return out


def codebook_text(points: np.ndarray) -> str:
    """All entries' components by part, entry and position within the part."""
    return ",".join(map(str, points.reshape(-1).tolist()))


def learn(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame | None, np.ndarray]:
    """(rows with vec_id, label, code, error; the final codebooks). No rows if no vector takes part.

    The rows' types are those of the columns named. All vectors that take part must have one length, a multiple of parts.
    """
    if not (0 < entries <= 256 and parts > 0):
        raise ValueError("entries must be 1 to 256, and parts at least 1")
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, id_col, vector_col, label_col, scale)
    kinds = dict(rows.dtypes)
    kept = f"vec_id {kinds['vec_id']}, label {kinds['label']}"
    start = [r.v for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    if not start:
        return None, np.zeros((parts, 0, 0), np.int64)
    width, rest = divmod(len(start[0]), parts)
    odd = F.size("v") != len(start[0])
    if rest or rows.where(odd).head(1):
        raise ValueError(f"vectors must have one length that {parts} divides")
    points = np.array(start, np.int64).reshape(len(start), parts, width).transpose(1, 0, 2).copy()

    books, path, state = Codebooks(points), None, rows
    for turn in range(rounds):
        known = state.mapInArrow(_pass(parts, books, turn == 0, False), f"{kept}, v array<int>, code array<smallint>, upper array<float>, lower array<float>")
        path, old = fresh_path(spark, "codes-bounds"), path
        known.write.parquet(path)
        discard(spark, old)
        state = spark.read.parquet(path)
        books = Codebooks(_updated(state, books.points), books.points)
    codes = fresh_path(spark, "codes")
    state.mapInArrow(_pass(parts, books, rounds == 0, True), f"{kept}, code string, error long").write.parquet(codes)
    discard(spark, path)
    return spark.read.parquet(codes), books.points


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 for each row whose vector is whole and finite.

    Rows whose vector is null, or holds null or non-finite components, take no part. Null ids take part and come last when the
    codebook is started; equal ids are ordered by their vectors there. Repeated rows stay repeated. Fewer rows than entries give
    smaller codebooks. Null labels are one label. An empty table gives no rows; further columns are ignored. Vectors of different
    lengths, and integers above 2**27, are errors.
    """
    codes, points = learn(vectors, id_col, vector_col, label_col, parts, entries, rounds, scale)
    if codes is None:
        kind = dict(vectors.dtypes)[id_col]
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, code string, error long, label_error long, codebooks_sha256 string")
    labels = codes.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    digest: Column = F.lit(hashlib.sha256(codebook_text(points).encode()).hexdigest())
    few = codes.select("label").distinct().count() <= BROADCAST_LABELS
    joined = codes.join(F.broadcast(labels) if few else labels, F.col("label").eqNullSafe(F.col("__label")))
    return joined.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def _assign_sql(step: int) -> str:
    """The nearest entry of each part, by squared distance and then by index."""
    return f"""
a{step} AS MATERIALIZED (
  SELECT rid, part, x, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d
  FROM (SELECT p.rid, p.part, p.x, b.entry, list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM p JOIN b{step} b USING (part)) GROUP BY rid, part, x)"""


def _update_sql(step: int) -> str:
    return f"""
s{step} AS (SELECT part, entry, place, floor(sum(y)::DOUBLE / count(*))::BIGINT AS y
  FROM (SELECT part, entry, unnest(x) AS y, generate_subscripts(x, 1) AS place FROM a{step}) GROUP BY part, entry, place),
b{step + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, b.c) AS c FROM b{step} b
  LEFT JOIN (SELECT part, entry, list(y ORDER BY place) AS c FROM s{step} GROUP BY part, entry) m USING (part, entry))"""


ORACLE = f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rid, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS x FROM k, range(16) r(part)),
b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, x AS c FROM p WHERE rid <= 64),{_assign_sql(0)},{_update_sql(0)},{_assign_sql(1)},{_update_sql(1)},{_assign_sql(2)},
c AS (SELECT rid, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY rid),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN c USING (rid), h
"""
