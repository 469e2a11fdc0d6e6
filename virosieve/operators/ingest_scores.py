"""Ingest of phenotype scores: look-up of changes, metric dimension and value upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from virosieve.plans.durable import cut
from virosieve.plans.ids import assign_ids, highest
from virosieve.tables import Tables

CHANGE_COLUMNS = ("gff_feature", "position_aa", "ref_aa", "alt_aa")
_VALUE_KEY = ["phenotype_metric_id", "amino_acid_id"]


def lookup_equivalent_changes(rows: DataFrame, amino_acids: DataFrame) -> DataFrame:
    """Rows with the id of every change that reads the same: one per codon. Rows without any drop
    out. The result may be far larger than the rows, so both sides are dealt to all tasks,
    however few they fill."""
    ids = amino_acids.select(F.col("id").alias("amino_acid_id"), *CHANGE_COLUMNS)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = [side.repartition(tasks, *CHANGE_COLUMNS) for side in (rows, ids)]
    return dealt[0].join(dealt[1], list(CHANGE_COLUMNS))


def last_scores(scores: DataFrame) -> DataFrame:
    """Of the scores of one metric that name the same change, the last value in input order."""
    return scores.groupBy(*CHANGE_COLUMNS, "phenotype_metric_name").agg(
        F.min("phenotype_metric_assay_type").alias("phenotype_metric_assay_type"),
        F.max_by("value", "input_order").alias("value"),
        F.max("input_order").alias("input_order"),
    )


def unknown_changes(rows: DataFrame, amino_acids: DataFrame) -> DataFrame:
    """The rows that name a change the catalog does not hold."""
    return rows.join(amino_acids.select(*CHANGE_COLUMNS), list(CHANGE_COLUMNS), "left_anti")


def metric_dimension_upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The metric table with the new names of ``incoming`` added. Of several assay types for a new
    name the smallest is kept."""
    names = incoming.groupBy("phenotype_metric_name").agg(
        F.min("phenotype_metric_assay_type").alias("phenotype_metric_assay_type")
    )
    new = names.join(existing.select("phenotype_metric_name"), "phenotype_metric_name", "left_anti")
    added = assign_ids(new, ["phenotype_metric_name"], highest(existing))
    return existing.unionByName(added)


def metric_value_upsert(existing: DataFrame, scores: DataFrame) -> DataFrame:
    """The value table after loading ``scores`` (metric id, change id, value, input_order).

    The last value of a (metric, change) in input order wins over earlier ones and over the stored
    one. ``updated`` marks stored values that changed.
    """
    last = scores.groupBy(*_VALUE_KEY).agg(F.max_by("value", "input_order").alias("__new"))
    stored = existing.select(*_VALUE_KEY, F.col("value").alias("__old"))
    return stored.join(last, _VALUE_KEY, "full").select(
        *_VALUE_KEY,
        F.coalesce("__new", "__old").alias("value"),
        F.coalesce(F.col("__new") != F.col("__old"), F.lit(False)).alias("updated"),
    )


def load_scores(tables: Tables, scores: DataFrame) -> Tables:
    """Load long scores (change columns, metric name and assay type, value, input_order): values of
    unknown changes are skipped, and a metric exists once it has a value."""
    # a change gets one value of a metric, so repeated scores are left out before each meets all its codons
    found = lookup_equivalent_changes(last_scores(scores.filter(F.col("value").isNotNull())), tables.amino_acids)
    # written before values refer to its ids
    metrics = cut(metric_dimension_upsert(tables.phenotype_metrics, found), "metrics")
    ids = metrics.select(F.col("id").alias("phenotype_metric_id"), "phenotype_metric_name")
    values = metric_value_upsert(tables.phenotype_metric_values, found.join(ids, "phenotype_metric_name"))
    return tables.replace(phenotype_metrics=metrics, phenotype_metric_values=values.drop("updated"))
