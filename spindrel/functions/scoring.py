"""BM25 as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def idf(docs: float, df: float) -> float:
    df = max(0.0, df)
    return math.log(1 + (max(docs, df) - df + 0.5) / (df + 0.5))


def tf_factor(tf: Column, length: Column, average: Column | float) -> Column:
    ratio = length / average if isinstance(average, Column) else length / F.lit(float(average)) if average > 0 else F.lit(1.0)
    return F.when(tf <= 0, 0.0).otherwise(tf * (K1 + 1) / (tf + K1 * (1 - B + B * ratio)))
