"""Derived tables that each load keeps up instead of making them anew.

* ``first_seen``: per (lineage, amino-acid change, side) the first collection start. It merges by minimum,
  so rows of new edges or new lineage calls are merged in without a look at older ones.
* ``metric_sum_cache`` and ``variant_sum_cache``: per (sample, metric) the sum of the scores that the
  sample's consensus or intra-host changes have, and their number. Only samples with new edges, or with a
  change whose scores changed, are summed again, and replace their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from virosieve.functions.dates import max_span_filter
from virosieve.plans.joins import own_shuffle
from virosieve.tables import Tables

# Widest collection window, in days, for first-seen comparisons.
FIRST_SEEN_MAX_SPAN_DAYS = 30

CONSENSUS, INTRAHOST = "consensus", "intrahost"
FIRST_SEEN_KEY = ["lineage_id", "change_id", "side"]
SUM_KEY = ["sample_id", "phenotype_metric_id"]


# --- first dates -------------------------------------------------------------------------------


def first_seen_rows(tables: Tables, consensus: DataFrame, intrahost: DataFrame) -> DataFrame:
    """``lineage_id, change_id, side, first_date`` of the given edges.

    Meant for all edges when the table is built, and for a load's new edges (or the edges of samples
    with new calls) afterwards.
    """
    sides = consensus.select("change_id", "sample_id", F.lit(CONSENSUS).alias("side")).unionByName(
        intrahost.select("change_id", "sample_id", F.lit(INTRAHOST).alias("side"))
    )
    dated = tables.samples.filter(max_span_filter(FIRST_SEEN_MAX_SPAN_DAYS)).select(
        F.col("id").alias("sample_id"), F.col("collection_start_date").alias("first_date")
    )
    calls = tables.samples_lineages.select("sample_id", "lineage_id").distinct()
    # samples with their lineages first: an edge then meets its lineages in one join
    members = own_shuffle(calls.join(dated, "sample_id"), "sample_id")
    return sides.join(members, "sample_id").groupBy(*FIRST_SEEN_KEY).agg(F.min("first_date").alias("first_date"))


def merge_first_seen(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The earlier date of each (lineage, change, side)."""
    both = stored.unionByName(fresh.select(*stored.columns))
    return both.groupBy(*FIRST_SEEN_KEY).agg(F.min("first_date").alias("first_date"))


def edges_of(edges: DataFrame, samples: DataFrame) -> DataFrame:
    """The edges of the samples in ``samples(sample_id)``."""
    return edges.join(samples.select("sample_id").distinct(), "sample_id", "left_semi")


# --- score sums --------------------------------------------------------------------------------


def score_sums(tables: Tables, edges: DataFrame, number: str, samples: DataFrame | None = None) -> DataFrame:
    """Per (sample, metric): the sum ``pmv_value_sum`` of the scores of a sample's distinct changes, and
    their number. ``samples(sample_id)`` narrows it to some samples."""
    dated = tables.samples.filter(
        F.col("collection_start_date").isNotNull() & F.col("collection_end_date").isNotNull()
    ).select(F.col("id").alias("sample_id"))
    if samples is not None:
        edges = edges_of(edges, samples)
    values = tables.phenotype_metric_values.withColumnRenamed("amino_acid_id", "change_id")
    if "freq_bin" in edges.columns:
        # scores first, they cut the edges; a change in two frequency bins counts once
        scored = edges.join(values.select("change_id").distinct(), "change_id", "left_semi")
        edges = scored.select("change_id", "sample_id").distinct()
    sums = edges.join(values, "change_id").groupBy(*SUM_KEY).agg(
        F.sum("value").alias("pmv_value_sum"), F.count("*").alias(number)
    )
    return sums.join(dated, "sample_id", "left_semi")


def touched_samples(new_edges: DataFrame, edges: DataFrame, changed_scores: DataFrame | None = None) -> DataFrame:
    """``sample_id`` of the samples with new edges, or with an edge to a change in
    ``changed_scores(amino_acid_id)``."""
    touched = new_edges.select("sample_id")
    if changed_scores is not None:
        changes = changed_scores.select(F.col("amino_acid_id").alias("change_id")).distinct()
        touched = touched.unionByName(edges.join(changes, "change_id", "left_semi").select("sample_id"))
    return touched.distinct()


def replace_samples(stored: DataFrame, fresh: DataFrame, samples: DataFrame) -> DataFrame:
    """``stored`` with the rows of ``samples`` exchanged for ``fresh``."""
    kept = stored.join(samples.select("sample_id"), "sample_id", "left_anti")
    return kept.unionByName(fresh.select(*stored.columns))


def refresh_sums(tables: Tables, stored: DataFrame, edges: DataFrame, number: str, samples: DataFrame) -> DataFrame:
    """Stored sums with those of the touched ``samples`` made anew from their ``edges``."""
    return replace_samples(stored, score_sums(tables, edges, number, samples), samples)
