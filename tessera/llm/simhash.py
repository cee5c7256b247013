"""Near-duplicates by SimHash: a binary trie of fingerprints is joined with itself.

The trie is never built as nodes. A sorted array of fingerprints is one: the fingerprints under a node are a range, and a
range splits where the next bit turns from 0 to 1. Pairs of nodes go down together; each step adds a differing bit to
those pairs that took different branches, and a pair is dropped once it has spent its budget. Pairs of nodes that are
small enough are finished by comparing their fingerprints.

The first `p` levels are done by Spark: a fingerprint goes to the bucket of its own p-bit prefix, and to those buckets
with a smaller prefix that differs in no more bits than the budget. Each pair of prefixes within the budget meets in
one bucket, once, with the bits it has left. p grows with the logarithm of the distinct fingerprints, so that a bucket
stays small; equal fingerprints are one row throughout. A task returns no pairs, but a spanning forest of the links it
found; components.py joins the forests.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD, materialised, small_batches, unused
from tessera.llm.components import components
from tessera.llm.hashes import mixed, run_hashes, word_hashes

SEED = 42
BITS = 64
#: Shingles whose bits are counted at once (64 bytes each).
BLOCK = 1 << 17


def shingle_digests(text: bytes, words: int, seed: int = SEED) -> bytes:
    """The XXH64 of each run of `words` words, A-Z in lower case, joined by spaces: 8 bytes each, big-endian."""
    found = text.lower().split()
    if not found:
        return b""
    if len(found) <= words:
        return xxhash.xxh64_digest(b" ".join(found), seed)
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate([[0], ends[: len(found) - words]]).tolist()
    hashed = xxhash.xxh64_digest
    return b"".join([hashed(line[s:e], seed) for s, e in zip(starts, (ends[words - 1 :] - 1).tolist())])


def fingerprint(text: bytes, words: int = 3, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half the shingles' hashes; no words: 0. As a signed 64-bit integer."""
    digests = np.frombuffer(shingle_digests(text, words, seed), np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(digests), BLOCK):
        ones += np.unpackbits(digests[i : i + BLOCK], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(digests)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): one row for each row of docs."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py() or b"", words) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return rows.mapInArrow(of, f"doc_id {kind}, fp long")


def _leaf_pairs(keys: np.ndarray, node: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs in node (columns a_lo, a_hi, b_lo, b_hi, budget) whose last `bits` bits, those below the nodes,
    differ in no more than the budget left."""
    below = np.uint64((1 << bits) - 1)
    for block in np.array_split(node, max(1, len(node) // 200_000)):
        sizes = (block[:, 1] - block[:, 0]) * (block[:, 3] - block[:, 2])
        of = np.repeat(np.arange(len(block)), sizes)
        at = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        wide = (block[:, 3] - block[:, 2])[of]
        a, b = block[of, 0] + at // wide, block[of, 2] + at % wide
        near = (np.bitwise_count((keys[a] ^ keys[b]) & below) <= block[of, 4]) & (a != b)
        yield a[near], b[near]


def trie_links(keys: np.ndarray, node: np.ndarray, bits: int, small: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Walks pairs of trie nodes, given as ranges of keys (sorted in each range): columns a_lo, a_hi, b_lo, b_hi, budget."""
    for bit in range(bits - 1, -1, -1):
        leaf = (node[:, 1] - node[:, 0]) * (node[:, 3] - node[:, 2]) <= small
        if leaf.any():
            yield from _leaf_pairs(keys, node[leaf], bit + 1)
            node = node[~leaf]
        if not len(node):
            return
        ones = np.concatenate([[0], np.cumsum((keys >> np.uint64(bit)) & np.uint64(1))]).astype(np.int64)
        a_lo, a_hi, b_lo, b_hi, left = node.T
        a_mid, b_mid = a_hi - (ones[a_hi] - ones[a_lo]), b_hi - (ones[b_hi] - ones[b_lo])
        self = (a_lo == b_lo) & (a_hi == b_hi)
        same0 = np.stack([a_lo, a_mid, b_lo, b_mid, left], 1)
        same1 = np.stack([a_mid, a_hi, b_mid, b_hi, left], 1)
        apart = np.stack([a_lo, a_mid, b_mid, b_hi, left - 1], 1)
        other = np.stack([a_mid, a_hi, b_lo, b_mid, left - 1], 1)[~self]
        node = np.concatenate([same0, same1, apart, other])
        node = node[(node[:, 1] > node[:, 0]) & (node[:, 3] > node[:, 2]) & (node[:, 4] >= 0)]
        alone = (node[:, 0] == node[:, 2]) & (node[:, 1] == node[:, 3]) & (node[:, 1] - node[:, 0] == 1)
        node = node[~alone]
    if len(node):
        yield from _leaf_pairs(keys, node, 0)


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Those of the pairs (a, b) that join two trees, taken in turn: as rows, the same components with the fewest links."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (above := up.get(top, top)) != top:
            top = above
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = root(x), root(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            kept.append((x, y))
    return np.array(kept, np.int64).reshape(-1, 2)


def _bucket_links(bucket: np.ndarray, used: np.ndarray, keys: np.ndarray, items: np.ndarray, bits: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole buckets, as a forest of pairs of items; bits: those below the prefix."""
    low = keys & np.uint64((1 << bits) - 1)
    order = np.lexsort((items, low, used, bucket))
    bucket, used, low, items = bucket[order], used[order], low[order], items[order]
    edge = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (used[1:] != used[:-1])]))
    ends = np.append(edge[1:], len(bucket))
    own = {int(bucket[s]): (s, e) for s, e in zip(edge, ends) if used[s] == 0}
    nodes = [(*own[k], s, e, budget - used[s]) for s, e in zip(edge, ends) if (k := int(bucket[s])) in own]
    if not nodes:
        return items[:0], items[:0]
    pairs = list(trie_links(low, np.array(nodes, np.int64), bits))
    if not pairs:
        return items[:0], items[:0]
    a, b = (items[np.concatenate([x[i] for x in pairs])] for i in (0, 1))
    kept = _forest(a, b)
    return kept[:, 0], kept[:, 1]


def trie_self_join(keys: DataFrame, bits: int = BITS, budget: int = 2, rows_a_bucket: int = 256, batch_rows: int = 200_000) -> DataFrame:
    """keys (lane, key, item), one row for each different lane and key of `bits` bits -> links (a, b) between items. In each
    lane they connect just those items that the pairs of keys within `budget` bits connect."""
    largest = keys.groupBy("lane").count().agg(F.max("count")).first()[0] or 0
    p = min(24, bits - 1, max(6, math.ceil(math.log2(max(1, largest) / rows_a_bucket))))
    masks = [sum(1 << i for i in flips) for k in range(budget + 1) for flips in combinations(range(p), k)]
    prefix = F.shiftrightunsigned("key", bits - p).cast("int")
    step = F.explode(F.array(*[F.lit(m) for m in masks]))
    dealt = keys.select("lane", "key", "item", prefix.alias("prefix"), step.alias("mask"))
    dealt = dealt.withColumn("met", F.col("prefix").bitwiseXOR(F.col("mask"))).where("met <= prefix")
    bucket = F.shiftleft(F.col("lane"), p).bitwiseOR(F.col("met"))
    dealt = dealt.select(bucket.alias("bucket"), F.bit_count("mask").cast("int").alias("used"), "key", "item")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(rows: np.ndarray) -> pa.RecordBatch:
            a, b = _bucket_links(rows[0], rows[1], rows[2].view(np.uint64), rows[3], bits - p, budget)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            if sum(x.shape[1] for x in held) >= batch_rows:
                rows = np.concatenate(held, axis=1)
                whole = int(np.searchsorted(rows[0], rows[0][-1]))  # the last bucket may go on
                if whole:
                    yield flush(rows[:, :whole])
                held = [rows[:, whole:]]
        if held:
            rows = np.concatenate(held, axis=1)
            if rows.shape[1]:
                yield flush(rows)

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(join, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, budget: int = 2) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable).

    Null text counts as empty. Texts without words have fingerprint zero, which links like any other. Repeated rows and
    ties share a component. Null ids are ignored by the minimum; a component of null ids alone has a null component_id.
    An empty table gives an empty result; further columns of docs are ignored.
    """
    rows = materialised(fingerprints(docs, id_col, text_col, words))
    classes = materialised(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    keys = classes.select(F.lit(0).alias("lane"), F.col("fp").alias("key"), F.col("fp").alias("item"))
    roots = components(trie_self_join(keys, BITS, budget))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialised(rooted.join(least, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: near_duplicates: bands, and the minima in each. Sets of a similarity of 0.8 share a band but for 0.4 % of them.
BANDS, BAND_SIZE = 14, 5
#: Of the fingerprints' 64 bits so many may differ in a pair of one bucket: at a similarity of 0.8, 10 do on average
#: (deviation 3), and 32 (4) in unlike texts. This saves exact tests and decides nothing else.
NEAR_BITS = 24
#: The pairs of buckets up to this size are tested one by one; the items of larger ones are joined.
FEW = 4
#: Buckets of more rows than this are joined whole.
BUCKET_ROWS = 4096
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND_SIZE, np.uint64) << np.uint64(1) | np.uint64(1)
_BAND_ODD = np.random.default_rng(SEED + 1).integers(0, 1 << 63, (BANDS, BAND_SIZE), np.uint64) << np.uint64(1) | np.uint64(1)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The 64-bit hashes of a text's different shingles, sorted. A-Z count as a-z; a shorter text is one shingle."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    return np.unique(run_hashes(word_hashes(found), min(words, len(found))))


def sketch(base: np.ndarray) -> tuple[int, int, np.ndarray]:
    """A set's number (the XXH64 of its hashes), its SimHash fingerprint, and a key for each band."""
    ones, least = np.zeros(BITS, np.int64), np.full(len(_ODD), (1 << 64) - 1, np.uint64)
    for i in range(0, len(base), 4096):
        part = base[i : i + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        np.minimum(least, (part[None, :] * _ODD[:, None]).min(axis=1), out=least)
    fingerprint = np.packbits(ones * 2 > len(base)).view(np.int64)[0]
    keys = mixed((mixed(least.reshape(BANDS, BAND_SIZE)) * _BAND_ODD).sum(axis=1, dtype=np.uint64))
    return int(np.uint64(xxhash.xxh64_intdigest(base.tobytes(), SEED)).astype(np.int64)), int(fingerprint), keys.view(np.int64)


def _sketches(texts: DataFrame, words: int) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(shingle_set(t.as_py(), words)) for t in batch.column(1).cast(pa.binary())]
            keys = np.concatenate([x[2] for x in found]) if found else np.zeros(0, np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * BANDS), pa.array(keys))
            columns = [batch.column(0), *(pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)), listed]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item", "fp", "keys"])

    return texts.mapInArrow(of, "doc_id long, item long, fp long, keys array<long>")


def _bucket_pairs(batches: Iterator[pa.RecordBatch], batch_rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    """(key, item, fp), by key -> (a, b): each bucket's trie is joined with itself, within NEAR_BITS. Buckets of up to FEW items give
    their pairs; larger ones give each item that has met another, as a pair with itself."""

    def near(rows: np.ndarray) -> pa.RecordBatch:
        rows = np.unique(rows.T[:, [0, 2, 1]], axis=0).T  # key, fp, item
        order = np.lexsort((rows[1].view(np.uint64), rows[0]))
        key, fp, item = rows[0][order], rows[1][order].view(np.uint64), rows[2][order]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.append(edge[1:], len(key))
        few = np.repeat(ends - edge <= FEW, ends - edge)
        node = np.stack([edge, ends, edge, ends, np.full(len(edge), NEAR_BITS)], 1)[ends - edge > 1]
        found = [np.zeros((0, 2), np.int64)]
        for x, y in trie_links(fp, node, BITS) if len(node) else []:
            a, b = np.maximum(item[x], item[y]), np.minimum(item[x], item[y])
            found.append(np.stack([a, b], 1)[few[x]])
            met = np.unique(np.concatenate([a[~few[x]], b[~few[x]]]))
            found.append(np.stack([met, met], 1))
        out = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])

    held: list[np.ndarray] = []
    for batch in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
        if sum(x.shape[1] for x in held) >= batch_rows:
            rows = np.concatenate(held, axis=1)
            whole = int(np.searchsorted(rows[0], rows[0][-1]))  # the last bucket may go on
            if whole:
                yield near(rows[:, :whole])
            held = [rows[:, whole:]]
    if held and (rows := np.concatenate(held, axis=1)).shape[1]:
        yield near(rows)


def _candidates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) to test, and the items that are to be joined."""
    banded = rows.select(F.explode("keys").alias("key"), "item", "fp")
    met = materialised(banded.groupBy("key").agg(F.min("item").alias("lo"), F.max("item").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("key", "n"))
    small = banded.join(met.where(F.col("n") <= BUCKET_ROWS).select("key"), "key", "left_semi").select("key", "item", "fp")
    large = banded.join(met.where(F.col("n") > BUCKET_ROWS).select("key"), "key", "left_semi").select("item")
    # Dealt by a hash of the key: Spark drops a repartition by the join's own key, and may then make the join a broadcast, which
    # leaves a key's rows where they were.
    dealt = small.repartition(F.xxhash64("key")).sortWithinPartitions("key")
    found = materialised(dealt.mapInArrow(_bucket_pairs, "a long, b long").distinct())
    return found.where("a <> b"), found.where("a = b").select(F.col("a").alias("item")).unionByName(large).distinct()


def _sets(texts: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(item, n, shingles) of the documents named: a row for each different set."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(1).cast(pa.binary()):
                base = shingle_set(text.as_py(), words)
                shingles = pa.ListArray.from_arrays(pa.array([0, len(base)], pa.int32()), pa.array(base.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([sketch(base)[0]], pa.int64()), pa.array([len(base)], pa.int32()), shingles], ["item", "n", "shingles"])

    named = ids.count()
    wanted = texts.join(F.broadcast(ids) if named <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    sets = materialised(wanted.mapInArrow(of, "item long, n int, shingles array<long>"))
    # One document stands for each set; only where rows share an id are there more.
    return sets if sets.count() == named else materialised(sets.dropDuplicates(["item"]))


def _shared_shingles(sets: DataFrame, similarity: float) -> DataFrame:
    """(item, n, shared, prefix): those of each set's shingles that another set has as well, rare ones first, and how many of them, from
    the first on, two sets must have one of in common if they are similar enough."""
    held = sets.select("item", "n", F.explode("shingles").alias("s"))
    often = held.groupBy("s").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    shared = held.join(often, "s").groupBy("item", "n").agg(F.sort_array(F.collect_list(F.struct("sets", "s")))["s"].alias("shared"))
    prefix = F.size("shared") - F.ceil(F.col("n") * similarity - 1e-9) + 1
    return materialised(shared.withColumn("prefix", prefix.cast("int")).where("prefix > 0"))


def _may_be_similar(a: str, b: str, similarity: float) -> Column:
    """Whether two sets of sizes n have enough shingles left, from the one they were met at on, to be similar if it is the first
    that they have in common. Similar sets pass at their first one; so others needn't."""
    least = (F.col(f"n{a}") + F.col(f"n{b}")) * (similarity / (1 + similarity)) - 1e-9
    return (F.least(f"left{a}", f"left{b}") >= least) & (F.col(f"item{a}") != F.col(f"item{b}"))


def _verified(pairs: DataFrame, sets: DataFrame, tokens: str, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of items whose sets have the similarity, exactly. tokens: the column of what a set may have in common."""
    side = lambda name: sets.select(F.col("item").alias(name), F.col("n").alias(f"n{name}"), F.col(tokens).alias(f"tokens{name}"))
    both = F.size(F.array_intersect("tokensa", "tokensb"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", both.alias("both"), "na", "nb")
    return materialised(joined.where(F.col("both") + 1e-9 >= similarity * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b"))


def _pair(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def _similar(sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between items that connect just those which pairs of at least the similarity connect.

    Similar sets share one of their first `prefix` shingles, rare ones first. Of each shingle's sets the one with the least of
    its own is tested against all others; then those in different components are, but for pairs inside the shingle's
    largest, each at the first shingle that it shares."""
    first = F.slice("shared", F.lit(1), F.col("prefix"))
    spread = sets.select("item", "n", F.size("shared").alias("m"), first.alias("head"), F.posexplode(first).alias("at", "s"))
    keyed = spread.select("item", "n", (F.col("n") - F.col("m")).alias("own"), (F.col("m") - F.col("at")).alias("left"), "head", "s")
    pivots = keyed.groupBy("s").agg(F.min(F.struct("own", "item", "n", "left")).alias("p"), F.count(F.lit(1)).alias("sets")).where("sets > 1")
    pivots = pivots.select("s", *[F.col(f"p.{c}").alias(f"{c}p") for c in ("item", "n", "left")])
    star = keyed.drop("head").join(pivots, "s").where(_may_be_similar("", "p", similarity)).select(*_pair("item", "itemp")).distinct()
    sure = _verified(star, sets, "shared", similarity)
    roots = components(sure)
    grouped = keyed.join(roots, keyed["item"] == roots["node"], "left").withColumn("group", F.coalesce("root", "item")).select("s", "item", "n", "left", "head", "group")
    of_group = grouped.groupBy("s", "group").agg(F.count(F.lit(1)).alias("c"))
    largest = of_group.groupBy("s").agg(F.max(F.struct("c", "group"))["group"].alias("largest"), F.count(F.lit(1)).alias("groups")).where("groups > 1").select("s", "largest")
    outside = grouped.join(largest, "s").where("group <> largest").select("s", *[F.col(c).alias(f"{c}o") for c in ("item", "n", "left", "head", "group")])
    apart = (F.col("group") != F.col("groupo")) & _may_be_similar("", "o", similarity) & (F.array_intersect("head", "heado")[0] == F.col("s"))
    pairs = grouped.join(outside, "s").where(apart).select(*_pair("item", "itemo")).distinct()
    return sure.unionByName(_verified(pairs, sets, "shared", similarity))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, keep_id) of the rows that a near-duplicate with a smaller id stands for.

    Texts are linked if the Jaccard similarity of their sets of shingles is `similarity` or more; groups are the components
    of these links. Texts that share a band of minima are in one bucket, whose trie of SimHash fingerprints is joined with
    itself: who meets nobody there has no near-duplicate. The pairs of small buckets are tested as they are, the sets of
    larger ones are joined exactly, through their rarest shingles; each link is a pair whose similarity was computed. Texts
    with the same set are one item. Rows with a null
    id, or without words, have no near-duplicates; further columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").rlike(WORD))
    rows = materialised(_sketches(texts, words))
    classes = materialised(rows.groupBy("item").agg(F.min("doc_id").alias("first_id")))
    pairs, wide = _candidates(rows)
    wide = materialised(wide)
    named = pairs.select(F.explode(F.array("a", "b")).alias("item")).unionByName(wide).distinct()
    ids = materialised(classes.join(named, "item", "left_semi").select(F.col("first_id").alias("doc_id")).distinct())
    sets = _sets(texts, ids, words)
    joined = _shared_shingles(sets.join(wide, "item", "left_semi"), similarity)
    links = _verified(pairs, sets, "shingles", similarity).unionByName(_similar(joined, similarity))
    roots = components(links)
    rooted = classes.join(roots, classes["item"] == roots["node"], "left").select("item", "first_id", F.coalesce("root", "item").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("keep_id"))
    kept = materialised(rooted.join(least, "root").select("item", "keep_id"))
    return rows.join(kept, "item").where("doc_id <> keep_id").select("doc_id", "keep_id")


#: Ids that are broadcast at most; beyond it the documents are joined by shuffling.
BROADCAST_IDS = 1_000_000


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that near_duplicates doesn't name, with all their columns, whatever their names. Rows with a null id, null or
    empty text stay; rows that share an id go together; an empty table stays empty."""
    name = unused(docs, "__gone")
    gone = materialised(near_duplicates(docs, id_col, text_col, words, similarity).select(F.col("doc_id").alias(name)).distinct())
    small = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if small else gone, docs[id_col].cast("long") == gone[name], "left_anti")
