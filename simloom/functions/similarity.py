"""Similarity of token sequences: multiset Jaccard and longest common subsequence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def multiset(df: DataFrame, keys: list[str], token: str) -> DataFrame:
    """Counts of non-empty tokens per key."""
    return df.where(F.col(token) != "").groupBy(*keys, token).agg(F.count(F.lit(1)).alias("n"))


def jaccard(smin: Column, n1: Column, n2: Column) -> Column:
    """Sum of minima over sum of maxima; 0 where both are empty."""
    return F.when(n1 + n2 - smin > 0, smin / (n1 + n2 - smin)).otherwise(F.lit(0.0))


def grams(tokens: Column, q: int, sep: str = "\u0000") -> Column:
    """All length-q windows of a token array, joined; none if it is shorter."""
    n = F.size(tokens)
    return F.when(n >= q, F.transform(F.sequence(F.lit(1), n - q + 1), lambda i: F.array_join(F.slice(tokens, i, q), sep))).otherwise(F.array().cast("array<string>"))


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, one vectorised row per element of the shorter list."""
    a, b = (list(a), list(b)) if len(a) <= len(b) else (list(b), list(a))
    ids: dict = {}
    y = np.array([ids.setdefault(t, len(ids)) for t in b], dtype=np.int64)
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for t in a:
        best = row[1:].copy()
        np.maximum(best, np.where(y == ids.get(t, -1), row[:-1] + 1, 0), out=best)
        row[1:] = np.maximum.accumulate(best)
    return int(row[-1]) if len(b) else 0


def lcs_similarity(a: list, b: list) -> float:
    if not len(a) and not len(b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    return 2 * lcs_length(a, b) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def lcs_similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
