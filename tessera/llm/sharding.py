"""Shards of near-equal bytes by histogram sort, in DataFrame operations only.

Rows are ordered by a hash of their text and then by a hash of their id, so that equal texts lie side by side. Splitters
between shards are keys in this order. Each round divides the part of the key's range that an open splitter must lie in by
1024 probes, counts the exact bytes below each of them with one aggregation over all partitions, and takes the probe next to
the splitter's target if it is within the tolerance; else the part between the two probes around the target is divided in the
next round. Probes lie between different texts at first, so a group of equal texts is only cut where the tolerance can't be
met without it. Rounds read keys and sizes, not texts. When all splitters are found, rows are exchanged once, into slices of
each shard, and counted off there.

Rows that repeat id and text travel as one row with their number, and a splitter may cut between them.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import discard, fresh_path, unused

#: Bits of each of the two hashes, and bits that a round finds.
BITS, DIGIT = 60, 10
#: How far the bytes below a splitter may be from their target, in percent of a shard.
TOLERANCE = 1
#: Rows of a slice, about: one task numbers them.
SLICE_ROWS = 50_000
#: Slices up to this many (under 50 bytes each) are broadcast; beyond it Spark joins them by shuffling.
BROADCAST_SLICES = 200_000


@dataclass(frozen=True)
class Splitter:
    """Rows with a smaller key are below it, and so are `copies` of each row with this key."""

    hi: int
    lo: int = 0
    copies: int = 0


@dataclass(frozen=True)
class Search:
    """What is known of a splitter: its target, the first `known` bits of its key, and the bytes below the keys that begin
    with them. Targets are times the number of shards, so that they are whole."""

    target: int
    known: int = 0
    prefix: int = 0
    below: int = 0

    def inside(self) -> Column:
        """Rows whose keys begin with the known bits."""
        first, second = min(self.known, BITS), max(self.known - BITS, 0)
        same = F.shiftright("hi", BITS - first) == self.prefix >> second
        return same & (F.shiftright("lo", BITS - second) == self.prefix & ((1 << second) - 1)) if second else same

    def digit(self) -> Column:
        """The bits that follow."""
        of, upto = ("hi", self.known) if self.known < BITS else ("lo", self.known - BITS)
        return F.shiftright(of, BITS - upto - DIGIT).bitwiseAND((1 << DIGIT) - 1)

    def key(self, digit: int) -> tuple[int, int]:
        """The lowest key with the known bits and this digit, which may be one past the last."""
        whole = ((self.prefix << DIGIT) + digit) << (2 * BITS - self.known - DIGIT)
        return whole >> BITS, whole & ((1 << BITS) - 1)


def _hash(of: Column) -> Column:
    """The first 60 bits of a digest."""
    return F.conv(F.substring(F.md5(of.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, size, text_crc32, hi, lo) of each row."""
    row = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return row.select(
        "doc_id",
        (F.octet_length("text") + 8).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        _hash(F.col("text")).alias("hi"),
        _hash(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("lo"),
    )


def _round(rows: DataFrame, searches: list[Search], shards: int, total: int) -> tuple[dict[int, Splitter], list[Search]]:
    """One round for all open splitters, of which several may look at the same part: those that it finds, and the rest."""
    parts = list({(s.known, s.prefix): s for s in searches}.values())
    part, digit = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, s in enumerate(parts):
        part, digit = F.when(s.inside(), F.lit(i)).otherwise(part), F.when(s.inside(), s.digit()).otherwise(digit)
    inside = rows.select(part.alias("part"), digit.alias("digit"), (F.col("size") * F.col("n")).alias("bytes"), "n", "hi").where("part IS NOT NULL")
    counts = inside.groupBy("part", "digit").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("hi").alias("first"), F.max("hi").alias("last"))
    # At most shards x 1024 rows reach the driver.
    cells: dict[tuple[int, int], list] = {}
    for r in sorted(counts.collect(), key=lambda r: (r.part, r.digit)):
        cells.setdefault((parts[r.part].known, parts[r.part].prefix), []).append(r)
    found, open_ = {}, []
    for s in searches:
        here = cells[s.known, s.prefix]
        upto = [x * shards for x in accumulate((r.bytes for r in here), initial=s.below)]
        at = min(bisect_right(upto, s.target), len(here)) - 1
        cell, before, after = here[at], s.target - upto[at], upto[at + 1] - s.target
        known, prefix = s.known + DIGIT, (s.prefix << DIGIT) + cell.digit
        if cell.n == 1 or min(before, after) * 100 <= total * TOLERANCE:
            found[s.target] = Splitter(*s.key(cell.digit + (before > after)))
        elif known == 2 * BITS:
            # Equal rows: the number of them that comes closest is cut off.
            found[s.target] = Splitter(*s.key(cell.digit), -((before + after - 2 * before * cell.n) // (2 * (before + after))))
        else:
            if known < BITS and cell.first == cell.last:  # one text: only ids are left to tell rows apart
                known, prefix = BITS, cell.first
            open_.append(Search(s.target, known, prefix, upto[at] // shards))
    return found, open_


def splitters(rows: DataFrame, shards: int) -> list[Splitter]:
    """rows (size, hi, lo, n) -> the shards - 1 splitters, ascending."""
    total = rows.agg(F.sum(F.col("size") * F.col("n"))).first()[0]
    if not total:
        return [Splitter(0)] * (shards - 1)
    found: dict[int, Splitter] = {}
    open_ = [Search(k * total) for k in range(1, shards)]
    while open_:
        more, open_ = _round(rows, open_, shards, total)
        found |= more
    return [found[k * total] for k in range(1, shards)]


def _pieces(at: list[Splitter], shards: int) -> Column:
    """Array of (shard, copies) of a row: one element, unless a splitter cuts between equal rows."""
    below = [F.lit(0).cast("long")]
    for s in at:
        here = (F.col("hi") == s.hi) & (F.col("lo") == s.lo)
        less = (F.col("hi") < s.hi) | ((F.col("hi") == s.hi) & (F.col("lo") < s.lo))
        below.append(F.when(less, F.col("n")).when(here, F.least("n", F.lit(s.copies).cast("long"))).otherwise(F.lit(0).cast("long")))
    below.append(F.col("n"))
    steps = F.array(*[F.struct(F.lit(k).alias("shard"), (below[k + 1] - below[k]).alias("copies")) for k in range(shards)])
    return F.filter(steps, lambda x: x["copies"] > 0)


def _combined(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """Keys and sizes of docs, written: rows that repeat id and text as one with n."""
    path = fresh_path(docs.sparkSession, "sharding-keys")
    keyed(docs, id_col, text_col).groupBy("doc_id", "size", "text_crc32", "hi", "lo").agg(F.count(F.lit(1)).alias("n")).write.parquet(path)
    return docs.sparkSession.read.parquet(path), path


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs.

    size is the text's bytes plus 8. Bytes below each border between shards are within 1 % of a shard of their share, or as close
    as whole rows allow. Null text counts as empty; null ids are rows like others. Rows that repeat id and text come out as often
    as they come in. An empty table gives no rows; further columns, whatever their names, are ignored. grown_shard is null: this
    law has nothing to say on another number of shards.
    """
    rows, _ = _combined(docs, id_col, text_col)
    piece = rows.withColumn("piece", F.explode(_pieces(splitters(rows, shards), shards))).select("*", "piece.*")
    largest = piece.groupBy("shard").agg(F.sum("copies").alias("rows")).agg(F.max("rows")).first()[0] or 0
    slices = -(-largest // SLICE_ROWS) or 1
    piece = piece.withColumn("slice", (F.pmod(F.xxhash64("hi", "lo"), F.lit(slices)) if slices > 1 else F.lit(0)).cast("int"))
    along = W.partitionBy("shard", "slice").orderBy("hi", "lo", "doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, -1)
    first = F.coalesce(F.sum("copies").over(along), F.lit(0))
    numbered = piece.withColumn("first", first)
    if slices > 1:
        upto = W.partitionBy("shard").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
        counts = piece.groupBy("shard", "slice").agg(F.sum("copies").alias("rows"))
        counts = counts.select("shard", "slice", F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("offset"))
        small = slices * shards <= BROADCAST_SLICES
        numbered = numbered.join(F.broadcast(counts) if small else counts, ["shard", "slice"]).withColumn("first", F.col("first") + F.col("offset"))
    slot = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1))
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, file_bytes: int = 256 << 20) -> None:
    """Writes docs, with all their columns, to path/shard=N in files of about file_bytes of text. Rows are dealt as shards() does it,
    but where a splitter cuts between rows that repeat id and text, all of them go to the later shard. Odd rows are treated as there."""
    rows, keys = _combined(docs, id_col, text_col)
    at = splitters(rows, shards)
    total = rows.agg(F.sum(F.col("size") * F.col("n"))).first()[0] or 0
    discard(docs.sparkSession, keys)
    key, shard = unused(docs, "__key"), unused(docs, "shard")
    hi, lo = _hash(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), _hash(F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    mine = docs.withColumn(key, F.struct(hi.alias("hi"), lo.alias("lo")))
    at_least = [(F.col(key) >= F.struct(F.lit(s.hi).cast("long").alias("hi"), F.lit(s.lo).cast("long").alias("lo"))).cast("int") for s in at]
    files = max(total // shards // file_bytes, 1)
    dealt = mine.withColumn(shard, sum(at_least, F.lit(0))).repartition(shard, F.pmod(F.xxhash64(key), F.lit(files)))
    dealt.drop(key).write.partitionBy(shard).parquet(path)


def _level_sql(bits: int) -> str:
    first, second = min(bits, BITS), max(bits - BITS, 0)
    by = f"hi >> {BITS - first}, " + (f"lo >> {BITS - second}" if second else "0::BIGINT")
    return f"SELECT {bits} AS bits, sum(n) AS n, sum(size * n) AS bytes, sum(sum(size * n)) OVER (ORDER BY {by}) AS upto FROM k GROUP BY {by}"


#: CRC-32 by bytes, from a table that is computed from the reflected polynomial; splitters by each round's probes over all rows.
ORACLE = f"""
WITH RECURSIVE w(i, bit, c) AS (
  SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, bit + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM w WHERE bit < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM w WHERE bit = 8),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
h AS MATERIALIZED (SELECT doc_id, text, list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)) AS bytes FROM d),
k AS MATERIALIZED (
  SELECT doc_id, len(bytes) - 1 + 8 AS size, xor(list_reduce(bytes, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32,
    ('0x' || substr(md5(text), 1, 15))::BIGINT AS hi, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS lo, count(*) AS n
  FROM h, crc GROUP BY ALL),
levels AS ({' UNION ALL '.join(_level_sql(b) for b in range(DIGIT, 2 * BITS + 1, DIGIT))}),
total AS (SELECT sum(size * n) AS total FROM k),
targets AS (SELECT total, r.i * total AS target FROM total, range(1, 24) r(i)),
near AS (
  SELECT target, bits, n, bytes, upto, target - (upto - bytes) * 24 AS before, upto * 24 - target AS after, total
  FROM targets, levels WHERE (upto - bytes) * 24 <= target AND target < upto * 24),
good AS (
  SELECT target, arg_min(CASE WHEN n > 1 AND least(before, after) * 100 > total * {TOLERANCE} THEN upto - bytes + (bytes // n) * ceil((2 * before * n - bytes * 24)::DOUBLE / (2 * bytes * 24))
    WHEN before <= after THEN upto - bytes ELSE upto END, bits) AS below
  FROM near WHERE bits = {2 * BITS} OR n = 1 OR least(before, after) * 100 <= total * {TOLERANCE} GROUP BY target),
cuts AS (SELECT list(below) AS cuts FROM good),
e AS (SELECT *, sum(size * n) OVER (ORDER BY hi, lo) - size * n + size * unnest(range(n)) AS start FROM k),
s AS (SELECT *, len(list_filter(cuts, lambda x: x <= start))::INT AS shard FROM e, cuts)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY hi, lo) - 1 AS slot, NULL::INT AS grown_shard
FROM s
"""
