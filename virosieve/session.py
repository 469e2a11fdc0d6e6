"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime SQL settings. Sizes (shuffle partitions, broadcast threshold, memory) are left to the
# cluster; only behaviour that results or skew handling depend on is set here.
_RUNTIME = {
    # release/creation timestamps are cut to dates in UTC
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join partition even when the aggregate above then needs its own shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # let a selective sample subset prune the edge table before its shuffle
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in _RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "virosieve", cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and the local benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
