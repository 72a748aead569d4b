"""Sequence similarity of names, as Arrow-batched functions."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(a: str | None, b: str | None) -> float:
    """2 M / (len(a) + len(b)) with M the characters in matching blocks; the order of the arguments matters."""
    return SequenceMatcher(None, a or "", b or "").ratio()


def name_similarity(a: str, b: str) -> float:
    """ratio, 0.2 more (1 at most) if one name holds the other."""
    r = ratio(a, b)
    return min(r + 0.2, 1.0) if a in b or b in a else r


@F.pandas_udf(T.DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def name_similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([name_similarity(x, y) for x, y in zip(a, b)])


def length_bound(a: Column, b: Column) -> Column:
    """An upper bound of ratio by lengths alone."""
    la, lb = F.length(a), F.length(b)
    return F.when(la + lb == 0, 1.0).otherwise(2 * F.least(la, lb) / (la + lb))
