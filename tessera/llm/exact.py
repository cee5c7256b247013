"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Texts are equal when they are identical after lower-casing A-Z. Three combining steps, each of which groups by the full
normalised text and not by its digest alone:

1. locally: Spark's partial aggregation merges equal texts inside each task before anything is shuffled;
2. by salt: (salt, digest, text), so that one huge group of copies is spread over `salts` tasks;
3. globally: (digest, text) over the salts' winners, at most `salts` rows a group.

Rows then look their group up by digest: narrow rows without text. That is exact, because a digest that turned out to
belong to two different texts in step 3 fails the job rather than merging them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, materialised, unused


def _normalised(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))


def content_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """(digest, keep_id, group_size): one row for each different normalised text; keep_id is its largest id."""
    salt = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(salts)).cast("int")
    by_salt = (
        _normalised(docs, id_col, text_col)
        .groupBy(salt.alias("salt"), "digest", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    groups = by_salt.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    one = groups.groupBy("digest").agg(
        F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )
    clash = F.when(F.col("texts") > 1, F.raise_error(F.lit("two different texts share a digest")).cast("long"))
    # Written, so that Spark may split a hot digest where rows look their group up.
    return materialised(one.select("digest", "keep_id", F.coalesce(clash, F.col("group_size")).alias("group_size")))


def _rows(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    """(doc_id, digest, repeats, keep_id, group_size): one row for each different pair of id and normalised text."""
    groups = content_groups(docs, id_col, text_col, salts)
    rows = _normalised(docs, id_col, text_col).groupBy("doc_id", "digest").agg(F.count(F.lit(1)).cast("int").alias("repeats"))
    return rows.join(groups, "digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. Null text counts as empty. A null id is smaller than any other.
    Of repeated rows (same id, equal text) one stays. Other columns, whatever their names, are ignored. An empty table
    gives an empty result.
    """
    rows = _rows(docs, id_col, text_col, salts).withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("repeat") == 1)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


#: Keys of dropped rows (under 100 bytes each) that are broadcast at most; beyond it the rows are joined by shuffling.
BROADCAST_KEYS = 500_000


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns, whatever their names. Of repeated rows (same id, equal text)
    the one stays whose columns, written as JSON, come first. Null text counts as empty; an empty table stays empty."""
    key_of = lambda i, d: F.concat(d, F.coalesce(i.cast("string"), F.lit("null")).cast("binary"))
    rows = _rows(docs.select(id_col, text_col), id_col, text_col, salts)
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    key = unused(docs, "__key")
    other = rows.where(~stays | (F.col("repeats") > 1)).select(key_of(F.col("doc_id"), F.col("digest")).alias(key), stays.alias("stays"))
    other = materialised(other)
    hint = F.broadcast if other.count() <= BROADCAST_KEYS else (lambda df: df)
    digest = F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), 256))
    mine = docs.withColumn(key, key_of(F.col(id_col), digest))
    single = mine.join(hint(other.select(key)), key, "left_anti").drop(key)
    if not other.where("stays").head(1):
        return single
    whole = F.struct(*[F.col(c) for c in docs.columns])
    repeated = mine.join(hint(other.where("stays").select(key)), key, "left_semi").groupBy(key).agg(F.min_by(whole, F.to_json(whole)).alias("row"))
    return single.unionByName(repeated.select("row.*"))


ORACLE = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
