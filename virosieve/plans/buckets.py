"""Tables kept in hash buckets of a key, of which a load reads and replaces only those it touches.

A table lies as ``path/of=<number of buckets>/bucket=<n>/``, so it tells its own number of buckets. A
merge finds the buckets of the incoming rows (as many numbers as there are buckets at most), reads those
of the stored table by partition pruning, writes the merged rows beside the table, and then replaces
exactly these buckets by dynamic partition overwrite. Merges here are idempotent, so one that was cut
short is simply run again; the merged rows lie whole beside the table until it has ended.

A bucket is split over several files where it is large: rows are rebalanced by bucket, and adaptive
execution cuts the large ones, so a key that holds much of the table doesn't make one long task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from virosieve.plans.durable import cut

BUCKETS = 256
_PLACE = ["of", "bucket"]


def bucket_of(keys: str | Sequence[str], buckets: int) -> Column:
    keys = [keys] if isinstance(keys, str) else keys
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, mode: str) -> None:
    dealt = rows.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", *[c for c in rows.columns if c not in _PLACE])
    dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*_PLACE).parquet(path)


def create(rows: DataFrame, path: str, key: str | Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Write a new table of ``rows`` in buckets of ``key`` and read it."""
    _write(rows.withColumns({"of": F.lit(buckets), "bucket": bucket_of(key, buckets)}), path, "errorifexists")
    # a file without rows tells the columns, should there be no other
    rows.limit(0).coalesce(1).write.mode("append").parquet(f"{path}/of={buckets}/bucket=0")
    return read(rows.sparkSession, path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(*_PLACE)


def read_touched(spark: SparkSession, path: str, wanted: DataFrame, key: str) -> DataFrame:
    """The rows in the buckets of the keys in ``wanted``; other buckets are not read."""
    numbers = wanted.select(bucket_of(key, count_of(spark, path)).alias("bucket")).distinct()
    touched = [r["bucket"] for r in numbers.collect()]
    return spark.read.parquet(path).filter(F.col("bucket").isin(touched)).drop(*_PLACE)


def count_of(spark: SparkSession, path: str) -> int:
    """The number of buckets of a table, as its folder says."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    found = [name for name in (entry.getPath().getName() for entry in listed) if name.startswith("of=")]
    if len(found) != 1:
        raise ValueError(f"{path} is no table in buckets")
    return int(found[0].removeprefix("of="))


def merge(spark: SparkSession, path: str, incoming: DataFrame, key: str | Sequence[str],
          combine: Callable[[DataFrame, DataFrame], DataFrame], written: bool = False) -> list[int]:
    """Replace each touched bucket by ``combine(stored rows, incoming rows)``; returns the touched buckets.

    Incoming rows are read twice and therefore written first, unless they are ``written`` already. ``combine`` sees whole buckets of both, gives the table's columns, and must keep every row's key.
    """
    stored = spark.read.parquet(path)
    columns = [c for c in stored.columns if c not in _PLACE]
    buckets = count_of(spark, path)
    incoming = incoming.withColumn("bucket", bucket_of(key, buckets))
    if not written:
        incoming = cut(incoming, "incoming")
    touched = sorted(r["bucket"] for r in incoming.select("bucket").distinct().collect())
    if not touched:
        return []
    old = stored.filter(F.col("bucket").isin(touched)).select(*columns)
    merged = combine(old, incoming.drop("bucket")).select(*columns)
    merged = cut(merged.withColumns({"of": F.lit(buckets), "bucket": bucket_of(key, buckets)}), "merged")
    _write(merged, path, "overwrite")
    return touched
