"""Token ids of documents in files of Simple-8b words, in ascending order of the documents' ids.

The files are Parquet, so that any store Spark writes to will do. A row is a segment of whole documents: its shard (the
n-th range of ids), its number in the shard, how many ids of the shard come before it, its documents' ids and numbers
of tokens, and its token ids as Simple-8b words with the offset of each block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm import simple8b
from tessera.llm.tokenize import END_ID, groups, tokenizer

SEGMENT_IDS = 1 << 16


def encode_documents(
    docs: DataFrame, tokenizer_file: str, kind: str = "words", id_col: str = "doc_id", text_col: str = "text", shards: int | None = None,
    cache_pieces: int = 1_000_000,
) -> DataFrame:
    """Segments of all documents, in the order of (id, hash of the text, text); rows that share an id are split as well.

    Null text counts as empty: its end id alone. Null ids come first; repeated rows and ties are documents of their own. A
    text longer than a segment makes a longer one. Further columns are ignored; an empty table gives no segments.
    """
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    n = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text").select("doc_id", "text")
    schema = (
        f"shard int, segment int, before long, doc_ids array<{id_type.simpleString()}>, lengths array<int>, "
        "offsets array<int>, words binary"
    )

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(tokenizer_file, kind, cache_pieces)
        shard, number, before = TaskContext.get().partitionId(), 0, 0

        def segment(doc_ids: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
            words, offsets = simple8b.encode(ids)
            listed = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            columns = [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), listed(doc_ids)]
            columns += [listed(pa.array(lengths, pa.int32())), listed(pa.array(offsets, pa.int32())), pa.array([words.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["shard", "segment", "before", "doc_ids", "lengths", "offsets", "words"])

        for batch in batches:
            for part, texts in groups(batch, 1):
                ids, lengths, _, _ = encoder.encode_all(texts, END_ID)
                ends, first, at = np.cumsum(lengths), 0, 0
                while first < len(lengths):  # whole documents, until the segment has its ids or the group is at its end
                    last = min(int(np.searchsorted(ends, at + SEGMENT_IDS)) + 1, len(lengths))
                    yield segment(part.column(0).slice(first, last - first), lengths[first:last], ids[at : ends[last - 1]])
                    number, before, first, at = number + 1, before + int(ends[last - 1]) - at, last, int(ends[last - 1])

    return ordered.mapInArrow(segments, schema)


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, kind: str = "words", **columns: str) -> None:
    """Writes encode_documents() to path, which must be new; odd rows are treated as there."""
    encode_documents(docs, tokenizer_file, kind, **columns).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers): one row for each row that was written. Blocks are decoded some at a time, by their offsets, so
    that a very long document is never whole in memory as ids."""
    files = spark.read.parquet(path)
    id_type = files.schema["doc_ids"].dataType.elementType.simpleString()

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, before = (batch.column(k)[i].as_py() for k in range(2))
                doc_ids, lengths, offsets = (batch.column(k)[i].values for k in (2, 3, 4))
                lengths = lengths.to_numpy().astype(np.int64)
                words = np.frombuffer(batch.column(5)[i].as_buffer(), np.uint64)
                ends = np.cumsum(lengths)
                cuts, crc, doc, at = ends.tolist(), [0] * len(lengths), 0, 0
                for ids in simple8b.decode_blocks(words, offsets.to_numpy()):
                    raw, upto = memoryview(ids.astype("<u4")).cast("B"), at + len(ids)
                    while doc < len(cuts):
                        crc[doc] = zlib.crc32(raw[4 * (max(at, cuts[doc] - int(lengths[doc])) - at) : 4 * (min(upto, cuts[doc]) - at)], crc[doc])
                        if cuts[doc] > upto:
                            break
                        doc += 1
                    at = upto
                columns = [doc_ids, pa.array(ends - lengths + before), pa.array(lengths), pa.array(crc, pa.int64())]
                columns.append(pa.array(np.full(len(lengths), shard, np.int32)))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    read = files.select("shard", "before", "doc_ids", "lengths", "offsets", "words").mapInArrow(
        documents, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long, shard int"
    )
    # One row a shard, and there are no more shards than partitions: a bound that does not grow with the documents.
    sizes = files.select("shard", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    base = F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select(F.col("shard").alias("of"), base.alias("base"))
    out = read.join(F.broadcast(bases), F.col("shard") == F.col("of"))
    return out.select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
