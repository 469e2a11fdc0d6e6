"""Similarity of short texts. The ratio has no built-in counterpart, so it is an Arrow UDF over the
distinct values only."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, functions as F

# Below this score a hit is noise.
MIN_SCORE = 0.7


def ratio_bound(needle: str, text: Column) -> Column:
    """An upper bound of ``match_ratio`` from built-in functions.

    The ratio counts the letters in matching blocks, twice, over both lengths. A letter is in them at
    most as often as in either text, so the sum of the lesser counts bounds what can match.
    """
    shared = F.lit(0)
    for letter in sorted(set(needle)):
        seen = F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))
        shared = shared + F.least(seen, F.lit(needle.count(letter)))
    size = F.length(text) + len(needle)
    return F.when(size > 0, 2.0 * shared / size).otherwise(F.lit(1.0))


def match_ratio(needle: str, text: Column) -> Column:
    """Ratcliff/Obershelp similarity of a fixed needle with each text."""

    @F.pandas_udf("double")
    def ratio(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else SequenceMatcher(None, needle, v).ratio())

    return ratio(text)
