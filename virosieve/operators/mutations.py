"""Consensus changes: rows, counts, and first appearance against the intra-host changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from virosieve.functions.dates import DEFAULT_MAX_SPAN_DAYS, MONTH, DateBin, max_span_filter, mid_collection_date
from virosieve.operators.common import (
    AA, Axis, Filter, as_filter, change_axis, filtered, lineage_samples, resolves, select_samples,
)
from virosieve.operators.upkeep import CONSENSUS, FIRST_SEEN_MAX_SPAN_DAYS, INTRAHOST
from virosieve.operators.variants import _one_change, counts_by_score
from virosieve.plans.joins import own_shuffle
from virosieve.tables import Tables


def mutations(tables: Tables, where: Filter, axis: str = "nt") -> DataFrame:
    """(sample, change) rows for a catalog filter."""
    axis = change_axis(axis)
    rows = tables[axis.consensus].join(filtered(axis.named(tables), where), "change_id")
    return _mutation_rows(rows, axis)


def mutations_by_sample(tables: Tables, where: Filter, axis: str = "nt") -> DataFrame:
    """The same rows for the samples that pass a sample filter."""
    axis = change_axis(axis)
    chosen = select_samples(tables, where).select(F.col("id").alias("sample_id"))
    edges = tables.edges_of_samples(axis.consensus).join(chosen, "sample_id", "left_semi")
    return _mutation_rows(edges.join(axis.named(tables), "change_id"), axis)


def _mutation_rows(rows: DataFrame, axis: Axis) -> DataFrame:
    ids = [F.col("change_id").alias("allele_id")] if axis.name == "nt" else []
    return rows.select("sample_id", *ids, *axis.columns, *axis.codons)


def mutation_sample_count(tables: Tables, change: str, axis: str = "aa") -> DataFrame:
    """Samples per change id for one change name: one row per codon on the amino-acid axis. The
    nucleotide axis gives the count without an id."""
    axis = change_axis(axis)
    edges = tables[axis.consensus].join(_one_change(tables, axis, change).select("change_id"), "change_id", "left_semi")
    counted = edges.groupBy("change_id").agg(F.count("*").alias("sample_count"))
    shown = F.col("change_id") if axis.name == "aa" else F.lit(None).cast("bigint")
    return counted.select(shown.alias("amino_sub_id"), "sample_count")


def mutation_count_by_date_and_lineage(tables: Tables, feature: str, position: int, alt: str, axis: str = "aa",
                                       date_bin: DateBin = MONTH, where: Filter = None,
                                       max_span_days: int = DEFAULT_MAX_SPAN_DAYS) -> DataFrame:
    """Distinct samples per (collection bin, lineage) that carry one change. The filter sees samples
    and lineages, no place."""
    axis = change_axis(axis)
    wanted = axis.named(tables).filter(
        (F.col(axis.feature) == feature) & (F.col(axis.position) == position) & (F.col(axis.alt) == alt)
    )
    # the change may be listed with several refs, which are counted apart
    carriers = tables[axis.consensus].join(wanted.select("change_id", axis.ref), "change_id")
    carriers = carriers.select("sample_id", axis.ref).distinct()
    samples = tables.samples.filter(max_span_filter(max_span_days))
    calls = tables.samples_lineages.join(tables.named_lineages, "lineage_id")
    condition = as_filter(where)
    if condition is not None and resolves(samples, condition):
        samples, condition = samples.filter(condition), None
    carriers = own_shuffle(carriers.join(samples.withColumnRenamed("id", "sample_id"), "sample_id"), "sample_id")
    rows = carriers.join(calls, "sample_id")
    if condition is not None:
        rows = rows.filter(condition)
    counted = (
        rows.select("sample_id", axis.ref, "lineage_name", *date_bin.columns(mid_collection_date()))
        .groupBy(*date_bin.names, axis.ref, "lineage_name")
        .agg(F.countDistinct("sample_id").alias("n"))
    )
    named = counted.select(
        *date_bin.names,
        "n",
        F.lit(feature).alias(axis.feature),
        axis.ref,
        F.lit(position).alias(axis.position),
        F.lit(alt).alias(axis.alt),
        "lineage_name",
    )
    return date_bin.labelled(named).orderBy(*date_bin.order, "lineage_name", axis.ref)


def mutation_counts_by_score(tables: Tables, region: str, metric: str, include_refs: bool = False,
                             where: Filter = None) -> DataFrame:
    """Consensus distinct samples per scored change of a feature."""
    return counts_by_score(tables, tables.cns_aa, region, metric, include_refs, where)


def _first_seen(tables: Tables, lineage: str, system: str) -> DataFrame:
    """First collection start of every amino-acid change in consensus and intra-host carriers of one
    lineage, for changes that have both.

    From the ``first_seen`` table where there is one; no edges are read then. Otherwise from the edges
    of the lineage's samples: both sides meet them in one join, and are reduced to one row per change
    id before names come in.
    """
    if "first_seen" in tables:
        wanted = tables.named_lineages.filter((F.col("lineage_name") == lineage) & (F.col("lineage_system_name") == system))
        rows = tables.first_seen.join(wanted.select("lineage_id"), "lineage_id", "left_semi")
    else:
        members = lineage_samples(
            tables, lineage, system, also=[max_span_filter(FIRST_SEEN_MAX_SPAN_DAYS)], keep=["collection_start_date"]
        )
        sides = [(CONSENSUS, tables.edges_of_samples("cns_aa")), (INTRAHOST, tables.edges_of_samples("ih_aa"))]
        edges = [e.select("change_id", "sample_id", F.lit(side).alias("side")) for side, e in sides]
        rows = edges[0].unionByName(edges[1]).join(members, "sample_id").withColumnRenamed("collection_start_date", "first_date")

    def first(side: str, name: str):
        return F.min(F.when(F.col("side") == side, F.col("first_date"))).alias(name)

    dates = {"mutations_start_date": CONSENSUS, "variants_start_date": INTRAHOST}
    per_id = rows.groupBy("change_id").agg(*[first(side, name) for name, side in dates.items()])
    named = per_id.join(AA.named(tables).select("change_id", *AA.columns), "change_id")
    seen = named.groupBy(*AA.columns).agg(*[F.min(name).alias(name) for name in dates])
    return seen.na.drop(subset=list(dates))


def _lag(seen: DataFrame, earlier: str, later: str) -> DataFrame:
    rows = seen.filter(F.col(earlier) < F.col(later))
    return rows.select(
        "variants_start_date",
        "mutations_start_date",
        F.datediff(later, earlier).alias("lag"),
        F.col("ref_aa").alias("ref"),
        F.col("position_aa").alias("pos"),
        F.col("alt_aa").alias("alt"),
        "gff_feature",
    )


def mutations_before_variants(tables: Tables, lineage: str, system: str) -> DataFrame:
    """Changes seen in a consensus before they were seen within a host, with the lag in days."""
    return _lag(_first_seen(tables, lineage, system), "mutations_start_date", "variants_start_date")


def variants_before_mutations(tables: Tables, lineage: str, system: str) -> DataFrame:
    """Changes seen within a host before they were seen in a consensus, with the lag in days."""
    return _lag(_first_seen(tables, lineage, system), "variants_start_date", "mutations_start_date")
