"""Join helpers: keys that may hold nulls, and keys that may be hot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def own_shuffle(df: DataFrame, key: str) -> DataFrame:
    """Let ``df`` get a shuffle of its own when it is joined on the integer ``key``.

    A frame that comes out of a join or aggregate on ``key`` already lies by that key, and Spark then
    joins it in place. But adaptive execution splits a hot key of the other side only where both
    sides of the join are plain shuffles. Meant for narrow frames that meet a large edge table: the
    extra shuffle is small, and a change or sample that holds much of the edges is split. The shift
    by zero keeps the value and hides from the planner that the rows already lie by it.
    """
    return df.withColumn(key, F.shiftright(key, 0))


def join_null_safe(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi-join where null equals null; the key columns of ``left`` are kept once."""
    keys = list(keys)
    if not keys:
        raise ValueError("a join needs keys")
    marked = right.select(
        *[right[k].alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    condition = reduce(lambda a, b: a & b, [left[k].eqNullSafe(marked[f"__r_{k}"]) for k in keys])
    return left.join(marked, condition, how).drop(*[f"__r_{k}" for k in keys])
