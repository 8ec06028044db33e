"""Optimal string alignment: insertions, deletions, substitutions and swaps of neighbours, no part edited twice."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def osa(a: str, b: str, most: int) -> int:
    """The distance, or most + 1 where it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most and (i < 2 or min(before) > most):
            return most + 1
    return min(row[-1], most + 1)


def within(terms: DataFrame, column: str, query: str, most: int) -> DataFrame:
    """terms with `distance` where it is at most `most`. A length window and Spark's own levenshtein(), which counts a swap as
    two edits, leave few rows for the exact distance."""

    @F.pandas_udf("int")
    def exact(some: pd.Series) -> pd.Series:
        return some.map(lambda t: osa(t, query, most))

    near = F.length(column).between(len(query) - most, len(query) + most) & (F.levenshtein(F.col(column), F.lit(query), 2 * most) >= 0)
    return terms.where(near).withColumn("distance", exact(F.col(column))).where(F.col("distance") <= most)


def similarity(distance: Column, query: str) -> Column:
    return F.greatest(1 - distance / F.lit(float(max(1, len(query)))), F.lit(0.1))
