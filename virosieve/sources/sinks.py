"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from virosieve.tables import Tables


def append_table(df: DataFrame, root: str, name: str) -> None:
    """Append rows to a stored table."""
    df.write.mode("append").parquet(f"{root}/{name}")


def write_tables(tables: Tables, root: str, names, mode: str = "errorifexists") -> None:
    """Write some tables below ``root``, one job each. Write a changed table to a new root and swap
    roots; a table must not be written over the files it is read from."""
    for name in names:
        tables[name].write.mode(mode).parquet(f"{root}/{name}")


def write_conflict_report(conflicts: DataFrame, path: str) -> int:
    """Conflicts as CSV with a header, one file per task. Without conflicts the report is the line
    "no conflicts found". Returns their number."""
    stored = conflicts.sparkSession
    conflicts.write.mode("overwrite").option("header", True).csv(path)
    written = stored.read.csv(path, schema=conflicts.schema, header=True).count()
    if written == 0:
        note = stored.range(1).selectExpr("'no conflicts found' AS note")
        note.write.mode("overwrite").text(path)
    return written
