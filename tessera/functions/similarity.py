"""String similarities. Levenshtein is Spark's own and jaccard is made of its functions; the others are Arrow UDFs over columns: give
them different pairs only."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = [True] * len(b)
    found = []
    for i, letter in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == letter:
                free[j] = False
                found.append(letter)
                break
    if not found:
        return 0.0
    other = [letter for j, letter in enumerate(b) if not free[j]]
    swaps = sum(x != y for x, y in zip(found, other)) // 2
    m = len(found)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def _jaro_winkler(a: str, b: str) -> float:
    score = _jaro(a, b)
    same = next((i for i in range(min(4, len(a), len(b))) if a[i] != b[i]), min(4, len(a), len(b)))
    return score + same * 0.1 * (1 - score) if score > 0.7 else score


def _damerau(a: str, b: str) -> int:
    """Edits with swaps of letters, also of letters that are edited again."""
    last: dict[str, int] = {}
    most = len(a) + len(b)
    grid = [[most] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        grid[i + 1][1] = i
    for j in range(len(b) + 1):
        grid[1][j + 1] = j
    for i in range(1, len(a) + 1):
        match = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), match
            cost = int(a[i - 1] != b[j - 1])
            if not cost:
                match = j
            grid[i + 1][j + 1] = min(grid[i][j] + cost, grid[i + 1][j] + 1, grid[i][j + 1] + 1, grid[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return grid[-1][-1]


def _over_columns(name: str, kind: str, one):
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b)])

    def column(a: Column, b: Column) -> Column:
        return F.pandas_udf(of, kind)(a, b)

    column.__name__ = name
    column.__doc__ = f"{name} of two columns; null if either is."
    return column


jaro = _over_columns("jaro", "double", _jaro)
jaro_winkler = _over_columns("jaro_winkler", "double", _jaro_winkler)
damerau_levenshtein = _over_columns("damerau_levenshtein", "int", _damerau)


def jaccard(a: Column, b: Column) -> Column:
    """Shared letters over all letters of two texts; 0 if neither has any, null if either is null."""
    letters = lambda t: F.array_remove(F.array_distinct(F.split(t, "")), "")
    both, all_letters = F.size(F.array_intersect(letters(a), letters(b))), F.size(F.array_union(letters(a), letters(b)))
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.try_divide(both.cast("double"), all_letters.cast("double")), F.lit(0.0)))
