"""Similarity of short texts: the longest-matching-blocks ratio, and a bound of it that SQL can compute."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def sequence_ratio(a: str, b: str) -> Column:
    """The longest-matching-blocks ratio of two texts, in Arrow batches: neither edit distance nor set overlap gives it."""
    return F.pandas_udf(_ratios, "double")(a, b)


def can_reach(a: str, b: str, least: float) -> Column:
    """Whether the ratio of two text keys can be ``least``: matching blocks hold no more than the characters that both have."""
    of = lambda side, c: F.length(F.col(side)) - F.length(F.replace(F.col(side), F.lit(c), F.lit("")))
    shared = F.lit(0)
    for c in _LETTERS:
        shared = shared + F.least(of(a, c), of(b, c))
    total = F.length(F.col(a)) + F.length(F.col(b))
    return (2 * F.least(F.length(F.col(a)), F.length(F.col(b))) >= least * total) & (2 * shared >= least * total)
