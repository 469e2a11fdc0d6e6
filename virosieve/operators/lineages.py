"""Lineage abundance, prevalence over time, and the changes that mark a lineage."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from virosieve.functions.dates import DEFAULT_MAX_SPAN_DAYS, MONTH, DateBin, max_span_filter, mid_collection_date
from virosieve.operators.common import (
    NT, Filter, as_filter, change_axis, lineage_samples, resolves, select_samples,
)
from virosieve.plans.closure import transitive_closure
from virosieve.plans.quantiles import QUARTILES, exact_quantiles
from virosieve.tables import Tables

# Prevalence thresholds and the plain nucleotides.
DEFAULT_PREVALENCE_THRESHOLD = 0.75
MIN_PREVALENCE_THRESHOLD = 0.01
NUCLEOTIDES = ("A", "C", "G", "T")


def lineages_in_system(tables: Tables, system: str) -> DataFrame:
    return tables.named_lineages.filter(F.col("lineage_system_name") == system)


def lineage_descendants(tables: Tables) -> DataFrame:
    """Every direct and indirect (parent, child) pair of the hierarchy, once; from the stored closure where
    there is one."""
    if "lineage_closure" in tables:
        return tables.lineage_closure
    return transitive_closure(tables.lineages_immediate_children)


def call_rows(tables: Tables, where: Filter, calls: DataFrame, sample_columns: Sequence[Column],
              also: Sequence[Column] = (), lineage_columns: Sequence[str] = ()) -> DataFrame:
    """Assignments with the wanted columns of their sample, filtered over samples, places, lineages
    and the assignment itself.

    A filter on sample and place columns runs on the samples alone, before the assignments join.
    """
    condition = as_filter(where)
    named = tables.named_lineages
    if condition is None or resolves(tables.samples_geo, condition):
        chosen = select_samples(tables, where, also=also)
        rows = calls.join(chosen.select(F.col("id").alias("sample_id"), *sample_columns), "sample_id")
        return rows.join(named, "lineage_id") if lineage_columns else rows
    base = tables.samples_geo
    for extra in also:
        base = base.filter(extra)
    rows = calls.join(named, "lineage_id").join(base.withColumnRenamed("id", "sample_id"), "sample_id")
    rows = rows.filter(condition)
    return rows.select(*calls.columns, *sample_columns, *lineage_columns)


def abundance_calls(tables: Tables) -> DataFrame:
    return tables.samples_lineages.filter(~F.col("is_consensus_call"))


def abundances(tables: Tables, where: Filter = None) -> DataFrame:
    """Per-sample abundance rows of the non-consensus assignments."""
    names = ["lineage_name", "lineage_system_id", "lineage_system_name"]
    rows = call_rows(tables, where, abundance_calls(tables), [F.col("accession")], lineage_columns=names)
    return rows.select("lineage_id", *names, "sample_id", "accession", "abundance")


def _summary(rows: DataFrame, keys: list[str], tables: Tables) -> DataFrame:
    """Count, extremes and quartiles of abundance per key; grouped by lineage id and named at the
    end."""
    keys = [*keys, "lineage_id"]
    out = exact_quantiles(
        rows.select(*keys, "abundance"), keys, "abundance", QUARTILES,
        ["abundance_q1", "abundance_median", "abundance_q3"],
        summary=["sample_count", "abundance_min", "abundance_max"],
    ).join(tables.named_lineages.select("lineage_id", "lineage_name", "lineage_system_name"), "lineage_id")
    return out.select(
        *[k for k in keys if k != "lineage_id"], "lineage_name", "lineage_system_name", "sample_count",
        "abundance_min", "abundance_q1", "abundance_median", "abundance_q3", "abundance_max",
    )


def abundance_summaries(tables: Tables, where: Filter = None) -> DataFrame:
    """Five-number summary of abundance per lineage."""
    return _summary(call_rows(tables, where, abundance_calls(tables), []), [], tables)


def abundance_summaries_by_collection_date(tables: Tables, date_bin: DateBin = MONTH, where: Filter = None,
                                           max_span_days: int = DEFAULT_MAX_SPAN_DAYS) -> DataFrame:
    """The same per collection bin."""
    rows = call_rows(
        tables, where, abundance_calls(tables), date_bin.columns(mid_collection_date()), [max_span_filter(max_span_days)]
    )
    return date_bin.labelled(_summary(rows, date_bin.names, tables)).orderBy(
        *date_bin.order, "lineage_system_name", "lineage_name"
    )


def lineage_counts_over_time(tables: Tables, date_bin: DateBin = MONTH, where: Filter = None,
                             lineage: str | None = None, days_before_today: int | None = None,
                             max_span_days: int = DEFAULT_MAX_SPAN_DAYS, today: dt.date | None = None) -> DataFrame:
    """Consensus calls per (bin, lineage) with the bin total over all lineages and the prevalence.
    The recency window acts before the totals, the lineage filter after them."""
    mid = mid_collection_date()
    also = [max_span_filter(max_span_days)]
    if days_before_today is not None:
        now = F.current_date() if today is None else F.lit(today)
        also.append(mid >= F.date_sub(now, days_before_today))
    calls = tables.samples_lineages.filter("is_consensus_call")
    rows = call_rows(tables, where, calls, date_bin.columns(mid), also)
    counted = rows.groupBy(*date_bin.names, "lineage_id").agg(F.count("*").alias("count"))
    # counted rows only: at most one per lineage in a bin
    total = F.sum("count").over(Window.partitionBy(*date_bin.names))
    names = tables.named_lineages.select("lineage_id", "lineage_name", "lineage_system_name")
    out = counted.withColumn("total", total).join(names, "lineage_id").drop("lineage_id")
    out = out.withColumn("prevalence", F.col("count") / F.col("total"))
    if lineage is not None:
        out = out.filter(F.col("lineage_name") == lineage)
    return date_bin.labelled(out).orderBy(*date_bin.order, F.desc("count"), "lineage_system_name", "lineage_name")


def mutation_incidence(tables: Tables, lineage: str, system: str, axis: str = "aa",
                       threshold: float = DEFAULT_PREVALENCE_THRESHOLD, match_reference: bool = False,
                       where: Filter = None) -> DataFrame:
    """Consensus changes carried by at least ``threshold`` of a lineage's samples."""
    if not MIN_PREVALENCE_THRESHOLD <= threshold <= 1:
        raise ValueError(f"the threshold must lie in [{MIN_PREVALENCE_THRESHOLD}, 1]")
    axis = change_axis(axis)
    members = lineage_samples(tables, lineage, system, where)
    sample_count = members.select(F.count("*")).scalar()
    per_change = (
        tables.edges_of_samples(axis.consensus)
        .join(members, "sample_id", "left_semi")
        .groupBy("change_id")
        .agg(F.count("*").alias("count"))
        .withColumn("sample_count", sample_count)
        # decimal, so that a count exactly on the threshold is kept
        .filter(F.col("count") >= F.lit(Decimal(str(threshold))) * F.col("sample_count"))
    )
    changes = axis.named(tables)
    if not match_reference:
        changes = changes.filter(F.col(axis.ref) != F.col(axis.alt))
    return per_change.join(changes, "change_id").select(
        axis.feature, axis.ref, axis.position, axis.alt, "count",
        (F.col("count") / F.col("sample_count")).alias("prevalence"), "sample_count",
    )


def mutation_profile(tables: Tables, lineage: str, system: str, where: Filter = None) -> DataFrame:
    """Spectrum of single-nucleotide changes in a lineage: observations per (region, ref, alt), and
    their share of the region."""
    members = lineage_samples(tables, lineage, system, where)
    plain = NT.named(tables).filter(F.col("ref_nt").isin(*NUCLEOTIDES) & F.col("alt_nt").isin(*NUCLEOTIDES))
    keys = ["region", "ref_nt", "alt_nt"]
    counted = (
        tables.edges_of_samples("cns_nt")
        .join(members, "sample_id", "left_semi")
        .groupBy("change_id")
        .agg(F.count("*").alias("n"))
        .join(plain.select("change_id", *keys), "change_id")
        .groupBy(*keys)
        .agg(F.sum("n").alias("count"))
    )
    # at most 16 rows per region
    total = F.sum("count").over(Window.partitionBy("region"))
    return counted.withColumn("total", total).withColumn("prevalence", F.col("count") / F.col("total"))
