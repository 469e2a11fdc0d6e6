"""Exact quantiles per group that never hold a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from virosieve.plans.joins import join_null_safe

QUARTILES = (0.25, 0.5, 0.75)


def few_valued_quantiles(df: DataFrame, keys, value: str, probs: Sequence[float], names: Sequence[str],
                         weight: str | None = None) -> DataFrame:
    """Interpolated quantiles of a value with a small domain (day counts, bin midpoints, ...).

    Equal values are counted first, with map-side combine, so the state of a group is as large as
    the domain and not as the group.
    """
    keys = list(keys)
    n = F.count("*") if weight is None else F.sum(weight)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.alias("__n"))
    out = counted.groupBy(*keys).agg(F.percentile(F.col(value), list(probs), F.col("__n")).alias("__q"))
    return out.select(*keys, *[F.col("__q")[i].alias(name) for i, name in enumerate(names)])


#: Value ranges per unit of the natural logarithm; a range is about 0.1 % wide.
RANGES_PER_E = 1024
_LARGEST = 799  # more than the logarithm of any double
_OFFSET = 800 * RANGES_PER_E  # more than any logarithm in ranges, so codes keep the sign of the value


def value_range(value: Column) -> Column:
    """A whole number that never falls as the value rises: sign and logarithm of the value."""
    number = value.cast("double")
    size = F.floor(F.least(F.log(F.abs(number)), F.lit(float(_LARGEST))) * RANGES_PER_E) + _OFFSET
    return F.when(number == 0, 0).when(F.isnan(number), 2 * _OFFSET).otherwise(F.signum(number).cast("bigint") * size).cast("bigint")


def exact_quantiles(df: DataFrame, keys, value: str, probs: Sequence[float], names: Sequence[str],
                    discrete: bool = False, summary: Sequence[str] | None = None,
                    weight: str | None = None) -> DataFrame:
    """Quantiles of an unrestricted numeric value, interpolated or ``discrete`` (the value at that rank).

    Exact selection in two passes over counted values. The first sums the counts per (keys, value
    range): sparse rows, whose running sums tell which ranges hold a wanted rank. Only the values in
    those ranges are looked at again and sorted, a range at a time. It is one plan of which nothing
    runs before it is asked for, and both passes read the same shuffle of the counted values.

    ``summary`` names columns for the number of rows (nulls included), the least and the largest value;
    groups that hold only nulls are then returned, too. ``weight`` names a column of counts: a row stands
    for so many.
    """
    keys = list(keys)
    # a constant key lets the ungrouped case use the same joins
    work_keys = keys or ["__all"]
    if not keys:
        df = df.withColumn("__all", F.lit(1))
    if summary is None:
        df = df.filter(F.col(value).isNotNull())
    n = F.count("*") if weight is None else F.sum(weight)
    counted = df.groupBy(*work_keys, value).agg(n.alias("__n")).withColumn("__range", value_range(F.col(value)))

    by_keys = Window.partitionBy(*work_keys)
    # nulls have the range null, which comes first and holds no rank
    known = F.when(F.col(value).isNotNull(), F.col("__n")).otherwise(0)
    sums = counted.groupBy(*work_keys, "__range").agg(
        F.sum(known).alias("__size"), F.sum("__n").alias("__rows"), F.min(value).alias("__least"), F.max(value).alias("__most")
    )
    sums = sums.select(
        *work_keys,
        "__range",
        "__size",
        (F.sum("__size").over(by_keys.orderBy("__range")) - F.col("__size")).alias("__before"),
        F.sum("__size").over(by_keys).alias("__total"),
        F.sum("__rows").over(by_keys).alias("__count"),
        F.min("__least").over(by_keys).alias("__least"),
        F.max("__most").over(by_keys).alias("__most"),
    )

    def ranks(p: float) -> tuple[Column, Column]:
        if discrete:
            at = F.greatest(F.ceil(F.col("__total") * F.lit(float(p))) - 1, F.lit(0))
            return at, at
        place = (F.col("__total") - 1) * F.lit(float(p))
        return F.floor(place), F.ceil(place)

    def holds(rank: Column, size: str) -> Column:
        return (rank >= F.col("__before")) & (rank < F.col("__before") + F.col(size))

    def chosen(size: str) -> Column:
        return reduce(or_, [holds(rank, size) for p in probs for rank in ranks(p)], F.col("__total") == 0)

    carried = ["__total", "__count", "__least", "__most"]
    wanted = sums.filter(chosen("__size")).select(*work_keys, "__range", F.col("__before").alias("__start"), *carried)
    inside = join_null_safe(counted, wanted, [*work_keys, "__range"])
    in_range = Window.partitionBy(*work_keys, "__range").orderBy(value)
    inside = inside.withColumn("__before", F.col("__start") + F.sum("__n").over(in_range) - F.col("__n"))

    ends, out = [F.max(c).alias(c) for c in carried], []
    for i, (p, name) in enumerate(zip(probs, names)):
        for side, rank in zip(("lo", "hi"), ranks(p)):
            ends.append(F.max(F.when(holds(rank, "__n"), F.col(value))).alias(f"__{side}{i}"))
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        place = (F.col("__total") - 1) * F.lit(float(p))
        out.append((lo if discrete else lo + (hi - lo) * (place - F.floor(place))).alias(name))
    found = inside.filter(chosen("__n")).groupBy(*work_keys).agg(*ends)
    shown = [F.col(c).alias(name) for c, name in zip(("__count", "__least", "__most"), summary or ())]
    return found.select(*keys, *out, *shown)
