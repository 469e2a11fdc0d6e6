"""Surrogate ids for new dimension rows, assigned in parallel and the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from virosieve.plans.durable import cut


def assign_ids(rows: DataFrame, keys, after: Column, id_name: str = "id") -> DataFrame:
    """Number ``rows`` (unique on ``keys``) ``after + 1, after + 2, ...`` without gaps.

    Rows are dealt into 4096 groups by a digest of their key. Numbers run inside each group in key
    order, on top of the row counts of the groups before it. So no task sorts all rows; the only
    single-task step sums at most 4096 counts.
    """
    keys = list(keys)
    rows = cut(rows, "new-keys")  # they are read twice
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    dealt = rows.withColumn("__group", F.substring(F.md5(text), 1, 3))
    counts = dealt.groupBy("__group").agg(F.count("*").alias("__n"))
    before = counts.select(
        "__group",
        (F.sum("__n").over(Window.orderBy("__group")) - F.col("__n")).alias("__before"),
    )
    in_group = Window.partitionBy("__group").orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    numbered = dealt.withColumn("__rank", F.row_number().over(in_group)).join(before, "__group")
    new_id = (after + F.col("__before") + F.col("__rank")).cast("bigint").alias(id_name)
    return numbered.select(new_id, *rows.columns)


def highest(df: DataFrame, id_name: str = "id") -> Column:
    """Largest id in use, 0 for an empty table, as a scalar subquery."""
    return df.select(F.coalesce(F.max(id_name), F.lit(0)).cast("bigint")).scalar()
