"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding makes letters that look alike one and undoes digits and signs written for letters, so that one entry matches its
disguises. Entries are whole words or beginnings of words (which catches inflected and compounded
forms); exception phrases are entries too, and a match inside one counts for nothing. A document's score is a logistic
function of its matches' weights, summed and divided by a power of its length in words.

The lexicon's entries are learned from labelled documents, besides a short list of known insults: beginnings and words
that labelled toxic documents hold far more often than others. Spark counts them; the driver receives at most
the entries that pass the tests, and three numbers for each of at most `max_rows` labelled documents of each label for the
logistic function and the power. `max_rows` bounds both; everything else covers all documents.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialised, small_batches

#: Known insults, whole words.
SEED_WORDS = ("idiot", "moron", "stupid", "scum", "loser", "worthless", "pathetic", "disgusting", "trash", "clown")
#: Phrases in which such words are harmless.
EXCEPTIONS = ("trash can", "trash bin", "class clown", "clown fish", "pond scum", "sore loser rule", "idiot proof", "idiot board")
#: Letters of other scripts that look like Latin ones.
_LOOKALIKES = str.maketrans("аеорсхуіјѕԁһкмтвнгαορτυνικеβ", "aeopcxyijsdhkmtbhraoptuvikeb")
_FOREIGN = re.compile("[\u0370-\u04ff\u0500-\u052f]")
#: Signs written for letters.
_SIGNS = str.maketrans("0134578@$!", "oieastbasi")
#: Runs of letters, digits and signs that hold a digit or sign; each is looked at once, however long it is.
_SIGNED = re.compile(r"(?<![a-z0-9@$!])[a-z]*+[0-9@$!][a-z0-9@$!]*+")
#: In such a run, signs between letters or before at least two.
_WRITTEN_FOR_LETTERS = re.compile(r"[a-z][0134578@$!]++[a-z]|\A[0134578@$]++[a-z]{2}")
_LETTERS = re.compile(r"[^\W\d_]+")
SHORTEST, LONGEST, MOST = 4, 9, 5
#: Words added to every length, so that very short texts aren't judged by their length.
SHORT = 25.0
POWERS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6)


def fold(text: str) -> list[str]:
    """The words of a text, folded."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        if _FOREIGN.search(text):
            text = text.translate(_LOOKALIKES)
    text = _SIGNED.sub(lambda m: m[0].translate(_SIGNS) if _WRITTEN_FOR_LETTERS.search(m[0]) else m[0], text)
    return _LETTERS.findall(text)


def entries_of(words: list[str]) -> dict[str, int]:
    """The candidates that a document's words hold, " begin" for beginnings and " word " for whole words, and by how many
    different words (at most MOST)."""
    out: dict[str, int] = {}
    for w in set(words):
        for entry in (f" {w} ", *[f" {w[:k]}" for k in range(SHORTEST, min(len(w), LONGEST + 1))]):
            out[entry] = min(out.get(entry, 0) + 1, MOST)
    return out


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    exceptions: tuple[str, ...]
    slope: float
    offset: float
    power: float

    def matcher(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, None))
        found.make_automaton()
        return found

    def weight(self, words: list[str], matcher) -> float:
        """The weights of all matches outside exception phrases. A word counts once, by its heaviest entry."""
        line = f" {' '.join(words)} "
        best: dict[int, float] = {}
        free: list[tuple[int, int]] = []
        for end, (size, weight) in matcher.iter(line):
            start = end - size + 1
            if weight is None:
                free.append((start, end))
            else:
                best[start] = max(best.get(start, weight), weight)
        if not free:
            return sum(best.values())
        # Both in order of their starts; a match is free if an exception that began before it goes on beyond its start.
        free.sort()
        total, at, upto = 0.0, 0, -1
        for start in sorted(best):
            while at < len(free) and free[at][0] <= start:
                upto = max(upto, free[at][1])
                at += 1
            if start >= upto:
                total += best[start]
        return total

    def score(self, words: list[str], matcher) -> float:
        z = self.slope * self.weight(words, matcher) / (len(words) + SHORT) ** self.power + self.offset
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _counted(rows: DataFrame) -> DataFrame:
    """(toxic, half, text) -> (entry, times in toxic documents of each half, times in others)."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, half, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = entries_of(fold(text))
                times = np.fromiter(found.values(), np.int32, len(found))
                columns = [pa.array(list(found), pa.string()), *(pa.array(times * np.int32(x)) for x in (toxic * (half == 0), toxic * (half != 0), 1 - toxic))]
                yield pa.RecordBatch.from_arrays(columns, ["entry", "toxic0", "toxic1", "clean"])

    held = rows.mapInArrow(candidates, "entry string, toxic0 int, toxic1 int, clean int")
    return held.groupBy("entry").agg(*[F.sum(c).alias(c) for c in ("toxic0", "toxic1", "clean")])


#: How many times more often an entry must be met in toxic documents.
RATIO = 5
#: The least log likelihood ratio of an entry.
SURE = 12.0


def _choose(found: list, toxic: int, clean: int) -> dict[str, float]:
    """Entries that tell toxic documents apart; weights are log odds. Of a beginning and its continuations the shortest that
    qualifies is taken, then lengthened as long as a longer one keeps nearly all of its matches."""
    stats, longer = {}, {}
    for entry, a0, a1, c in found:
        a = a0 + a1
        stats[entry] = (a, math.log((a + 0.5) / toxic) - math.log((c + 0.5) / clean), c)
        longer.setdefault(entry[:-1], []).append(entry)
    chosen: dict[str, float] = {}
    covered: set[str] = set()
    for entry in sorted(stats, key=lambda e: (len(e), e)):
        if any(entry[:k] in covered for k in range(SHORTEST + 1, len(entry) + 1)):
            continue
        covered.add(entry)
        best = entry
        while ends := [e for e in longer.get(best, ()) if stats[e][0] >= 0.8 * stats[best][0]]:
            best = max(ends, key=lambda e: (stats[e][0], e))
        chosen[best] = stats[best][1]
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 0.05) -> tuple[float, float]:
    """Slope and offset by Newton steps, slightly pulled to zero."""
    design = np.stack([x, np.ones_like(x)], 1)
    beta = np.array([1.0, -2.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        pull = np.array([penalty, 1e-3])
        gradient = design.T @ (weight * (p - y)) + pull * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(pull)
        step = np.linalg.solve(hessian, gradient)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = 4000,
) -> Model:
    """A model from the labelled rows whose crc32(id as text) leaves a remainder other than 1 by 3.

    Of each label at most max_rows rows are used, those with the lowest hash of their id. Without labelled rows of both
    kinds the known insults alone make the model. Null ids and labels are ignored.
    """
    crc = F.crc32(F.col("id").cast("string").cast("binary"))
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IN (0, 1)")
    marked = marked.where(crc % 3 != 1).groupBy("id").agg(F.max("toxic").alias("toxic"))
    lowest = lambda t: marked.where(F.col("toxic") == t).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    used = lowest(1).unionByName(lowest(0))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # At most 2 * max_rows narrow rows: a broadcast of proven size.
    rows = texts.join(F.broadcast(used), "id").select("toxic", (F.xxhash64("id") % 2).alias("half"), "text")
    rows = materialised(rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("text")))
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    all_of = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    weights = {f" {w} ": 4.0 for w in SEED_WORDS}
    slope, offset, power = 4.0, -3.0, 0.3
    if toxic and clean:
        a = F.col("toxic0") + F.col("toxic1")
        often = (a + 0.5) * clean >= (F.col("clean") + 0.5) * toxic * RATIO
        # Twice the log likelihood ratio of "as often in both kinds" is far beyond what chance gives in so many entries.
        n, p = a + F.col("clean"), toxic / (toxic + clean)
        unlike = a * F.log(a / (n * p)) + F.col("clean") * F.log(F.greatest(F.col("clean"), F.lit(0.5)) / (n * (1 - p)))
        likely = _counted(rows).where((F.col("toxic0") > 0) & (F.col("toxic1") > 0) & (unlike >= SURE) & often)
        # As many as the labelled rows give, of which there are 2 * max_rows.
        learned = _choose(sorted(tuple(r) for r in likely.collect()), toxic, clean)
        weights = {**weights, **learned}
        model = Model(weights, EXCEPTIONS, slope, offset, power)

        def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = model.matcher()
            for batch in batches:
                words = [fold(t) for t in batch.column(1).to_pylist()]
                columns = [pa.array([model.weight(w, matcher) for w in words], pa.float64()), pa.array([len(w) for w in words], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["toxic", "weight", "words"])

        points = np.array(rows.select("toxic", "text").mapInArrow(weighed, "toxic int, weight double, words long").collect(), float)
        points = points[np.lexsort(points.T)]  # the same sums in every run
        y, share = points[:, 0], {t: all_of[t] / totals[t] for t in (0, 1)}
        w = np.where(y == 1, share[1], share[0])
        w /= w.mean()
        fits = []
        for q in POWERS:
            x = points[:, 1] / (points[:, 2] + SHORT) ** q
            fitted = _logistic(x, y, w)
            z = np.clip(fitted[0] * x + fitted[1], -30, 30)
            fits.append((round(float((w * (np.log1p(np.exp(z)) - y * z)).sum()), 6), q, fitted))
        _, power, (slope, offset) = min(fits)
    return Model(weights, EXCEPTIONS, slope, offset, power)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted.

    Null text counts as empty; an empty text has the score of no matches. held_out is false for a null id. Equal texts
    have equal scores. Further columns are ignored; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for batch in batches:
            found = [model.score(fold(t.as_py()), matcher) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    out = rows.mapInArrow(scored, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns and in their partitions; nothing is shuffled.

    Null text counts as empty, and an empty text has the score of no matches. Equal rows are kept or dropped alike. Text of
    another type is judged as a string. An empty table stays empty."""

    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for batch in batches:
            low = [model.score(fold(t.as_py() or ""), matcher) < threshold for t in batch.column(at).cast(pa.string())]
            yield batch.filter(pa.array(low, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
