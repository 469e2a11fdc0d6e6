"""Reader of literature markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from virosieve.sources.delimited import cast_columns, read_delimited, renamed

# Model column -> header of the marker file.
MARKER_COLUMNS = {
    "aa_change": "mutation_name",
    "effect_detail": "effect_name",
    "title": "title",
    "authors": "authors",
    "publication_year": "year",
    "marker_id": "marker_id",
}


def read_annotations(spark: SparkSession, paths) -> DataFrame:
    raw = renamed(read_delimited(spark, paths, "\t", MARKER_COLUMNS.values()), MARKER_COLUMNS)
    return cast_columns(raw.drop("input_order"), {"publication_year": "bigint"})
