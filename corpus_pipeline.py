"""A training corpus from raw documents, in five stages, each an operator of tessera.llm.

A stage gets what the stage before it kept. All but the last return rows of documents with their columns as they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact, mixing, packing, simhash, toxicity
from tessera.llm.common import fresh_path, release, table
from tessera.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold stay. Null text counts as empty and stays; equal texts go alike."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z the row with the largest id stays, null being the smallest; null text is empty text.
    Of rows that repeat id and text one stays."""
    return exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the row with the smallest id stays, and all rows
    without an id or without words."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's target asks for, at most three times. A null source is one too; rows without words take no
    part in the sums and come as often as others."""
    return mixing.mixed(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, in sequences of at most 2048 tokens; null or empty text is its end id alone. Executors that have been through the other stages have
    less memory left for the tokenizer."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), "bytes", cache_pieces=200_000, group_chars=2_000_000, shard_chars=4_000_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Trained models, SimHash and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name.replace(' ', '-').lower()}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
