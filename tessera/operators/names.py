"""Names a few edits apart, without comparing all with all: two texts within d edits have something in common once at most d letters
are taken from each, and what is left is an equi-join key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.relational import shuffled


def remainders(text: Column, limit: int) -> Column:
    """Hashes of all that is left of a text when up to `limit` letters are taken from it, the text itself among them."""
    without = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(t.substr(F.lit(1), i - 1), t.substr(i + 1, F.length(t))))
    left = F.array(text)
    for _ in range(limit):
        shorter = F.flatten(F.transform(F.filter(left, lambda t: F.length(t) > 0), without))
        left = F.array_distinct(F.concat(left, shorter))
    return F.array_distinct(F.transform(left, lambda t: F.xxhash64(t)))


def close_names(left: DataFrame, right: DataFrame, name_col: str, keys: Sequence[str] = (), limit: int = 1) -> DataFrame:
    """left and right (keys, name) -> keys, name, other, distance: each pair of different or equal names of one key, a left and a right one,
    that at most `limit` insertions, deletions and substitutions of letters part.

    A name of n letters is n + 1 rows for a limit of 1, of which each holds a hash and the name; the work grows with the names and
    the pairs found, whatever number of names a key has. Both sides are shuffled: Spark takes the rows of names for as many as the names, so it
    would broadcast them twenty times too large. Repeated names count once; null names and null keys meet nothing; the empty
    name is a name. Meant for names: remainders of long texts take memory by the square of their length for each limit.
    """

    def keyed(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(*keys, F.col(name_col).alias(name)).where(F.col(name).isNotNull()).distinct()
        return rows.withColumn("__left", F.explode(remainders(F.col(name), limit)))

    met = keyed(left, "name").join(shuffled(keyed(right, "other")), [*keys, "__left"])
    # Hashes only bring names together; Spark's own distance, which is -1 beyond the limit, decides.
    return met.select(*keys, "name", "other", F.levenshtein("name", "other", limit).alias("distance")).where("distance >= 0").distinct()
