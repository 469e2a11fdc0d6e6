"""Counts of samples, changes and lineage assignments by column or by date bin."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from virosieve.functions.changes import bin_text
from virosieve.functions.dates import DEFAULT_MAX_SPAN_DAYS, MONTH, DateBin, max_span_filter, mid_collection_date
from virosieve.operators.common import (
    Filter, as_filter, binned_samples, change_axis, change_keys, resolves, select_samples,
    with_change_names,
)
from virosieve.tables import GEO_COLUMNS, Tables

SIMPLE_DATE_FIELDS = ("release_date", "creation_date")


# --- samples ---------------------------------------------------------------------------------


def count_samples_by_column(tables: Tables, column: str, where: Filter = None) -> DataFrame:
    """Samples per value of any sample or place column, largest first."""
    if column in GEO_COLUMNS:
        # count per place id, then name the few places
        per_place = select_samples(tables, where).groupBy("geo_location_id").agg(F.count("*").alias("n"))
        names = tables.geo_locations.select(F.col("id").alias("geo_location_id"), column)
        counted = per_place.join(names, "geo_location_id", "left").groupBy(column).agg(F.sum("n").alias("n"))
    else:
        counted = select_samples(tables, where).groupBy(column).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), column)


def count_samples_by_simple_date(tables: Tables, field: str, date_bin: DateBin = MONTH,
                                 where: Filter = None) -> DataFrame:
    """Samples per bin of the release or creation date. Samples without it form a null bin."""
    if field not in SIMPLE_DATE_FIELDS:
        raise ValueError(f"not a single-date field: {field}")
    dates = select_samples(tables, where).select(*date_bin.columns(F.col(field).cast("date")))
    counted = dates.groupBy(*date_bin.names).agg(F.count("*").alias("n"))
    return date_bin.labelled(counted).orderBy(*date_bin.order)


def count_samples_by_collection_date(tables: Tables, date_bin: DateBin = MONTH, where: Filter = None,
                                     max_span_days: int = DEFAULT_MAX_SPAN_DAYS) -> DataFrame:
    """Samples per bin of the mid collection date."""
    binned = binned_samples(tables, date_bin, where, max_span_days=max_span_days)
    counted = binned.groupBy(*date_bin.names).agg(F.count("*").alias("n"))
    return date_bin.labelled(counted).orderBy(*date_bin.order)


def sample_counts(tables: Tables, group_by: str, date_bin: DateBin = MONTH, where: Filter = None,
                  max_span_days: int = DEFAULT_MAX_SPAN_DAYS) -> DataFrame:
    """Counts by one key (a column, a date field or ``lineage``) or by ``lineage`` plus a date field."""
    keys = set(group_by.split(","))
    if len(keys) > 2:
        raise ValueError("at most two group_by keys")
    if len(keys) == 2:
        dates = keys - {"lineage"}
        field = dates.pop()
        if not dates and field in SIMPLE_DATE_FIELDS:
            return count_lineages_by_simple_date(tables, field, date_bin, where)
        if not dates and field == "collection_date":
            return count_lineages_by_collection_date(tables, date_bin, where, max_span_days)
        raise NotImplementedError("two keys must be lineage and a date field")
    if group_by in SIMPLE_DATE_FIELDS:
        return count_samples_by_simple_date(tables, group_by, date_bin, where)
    if group_by == "collection_date":
        return count_samples_by_collection_date(tables, date_bin, where, max_span_days)
    if group_by == "lineage":
        return sample_counts_by_lineage(tables, where)
    return count_samples_by_column(tables, group_by, where)


# --- lineages --------------------------------------------------------------------------------


def _name_lineages(counted: DataFrame, tables: Tables) -> DataFrame:
    names = tables.named_lineages.select("lineage_id", "lineage_name", "lineage_system_name")
    return counted.join(names, "lineage_id").drop("lineage_id")


def sample_counts_by_lineage(tables: Tables, where: Filter = None) -> DataFrame:
    """Distinct samples per lineage, largest first."""
    calls = tables.samples_lineages.select("sample_id", "lineage_id")
    if as_filter(where) is not None:
        chosen = select_samples(tables, where).select(F.col("id").alias("sample_id"))
        calls = calls.join(chosen, "sample_id", "left_semi")
    counted = calls.groupBy("lineage_id").agg(F.countDistinct("sample_id").alias("n"))
    named = _name_lineages(counted, tables)
    return named.select("lineage_system_name", "lineage_name", "n").orderBy(
        F.desc("n"), "lineage_system_name", "lineage_name"
    )


def _count_calls(tables: Tables, dated: DataFrame, date_bin: DateBin) -> DataFrame:
    """Assignments per (bin, lineage); ``dated`` holds sample_id and bin columns."""
    calls = tables.samples_lineages.select("sample_id", "lineage_id").join(dated, "sample_id")
    counted = calls.groupBy(*date_bin.names, "lineage_id").agg(F.count("*").alias("n"))
    return date_bin.labelled(_name_lineages(counted, tables)).orderBy(
        *date_bin.order, "lineage_system_name", "lineage_name"
    )


def _calls_by(tables: Tables, where: Filter, date_bin: DateBin, date, also=()) -> DataFrame:
    condition = as_filter(where)
    by_sample = condition is None or resolves(tables.samples_geo, condition)
    if by_sample:
        chosen = select_samples(tables, where, also=also)
        dated = chosen.select(F.col("id").alias("sample_id"), *date_bin.columns(date))
        return _count_calls(tables, dated, date_bin)
    # the filter looks at the assignment itself, so it decides row by row
    base = tables.samples_geo
    for extra in also:
        base = base.filter(extra)
    calls = tables.samples_lineages.join(tables.named_lineages, "lineage_id")
    rows = base.join(calls.withColumnRenamed("sample_id", "id"), "id").filter(condition)
    counted = (
        rows.select("lineage_id", *date_bin.columns(date))
        .groupBy(*date_bin.names, "lineage_id")
        .agg(F.count("*").alias("n"))
    )
    return date_bin.labelled(_name_lineages(counted, tables)).orderBy(
        *date_bin.order, "lineage_system_name", "lineage_name"
    )


def count_lineages_by_simple_date(tables: Tables, field: str, date_bin: DateBin = MONTH,
                                  where: Filter = None) -> DataFrame:
    """Assignments per (bin of release or creation date, lineage)."""
    if field not in SIMPLE_DATE_FIELDS:
        raise ValueError(f"not a single-date field: {field}")
    return _calls_by(tables, where, date_bin, F.col(field).cast("date"))


def count_lineages_by_collection_date(tables: Tables, date_bin: DateBin = MONTH, where: Filter = None,
                                      max_span_days: int = DEFAULT_MAX_SPAN_DAYS) -> DataFrame:
    """Assignments per (bin of mid collection date, lineage)."""
    return _calls_by(tables, where, date_bin, mid_collection_date(), [max_span_filter(max_span_days)])


# --- changes by catalog column -----------------------------------------------------------------


def count_variants_by_column(tables: Tables, column: str, axis: str = "aa", where: Filter = None) -> DataFrame:
    """Intra-host (sample, change) observations per catalog column, or per ``alt_freq_range``.

    A sample seen in two frequency bins of one change is one observation, unless the bin is the key.
    Edges are counted per change before the catalog is joined, so a change carried by very many
    samples is one row there.
    """
    axis = change_axis(axis)
    edges = tables[axis.intrahost]
    if as_filter(where) is not None:
        chosen = select_samples(tables, where, lineages="left").select(F.col("id").alias("sample_id"))
        edges = edges.join(chosen, "sample_id", "left_semi")
    if column == "alt_freq_range":
        counted = edges.groupBy("freq_bin").agg(F.count("*").alias("n"))
        counted = counted.select(bin_text(F.col("freq_bin")).alias("alt_freq_range"), "n")
    else:
        observed = edges.select("change_id", "sample_id").distinct()
        counted = _sum_by_catalog_column(observed, tables, axis, column)
    return counted.orderBy(F.desc("n"), column)


def count_mutations_by_column(tables: Tables, column: str, axis: str = "aa", where: Filter = None) -> DataFrame:
    """Consensus (sample, change) observations per catalog column."""
    axis = change_axis(axis)
    edges = tables[axis.consensus]
    if as_filter(where) is not None:
        chosen = select_samples(tables, where).select(F.col("id").alias("sample_id"))
        edges = tables.edges_of_samples(axis.consensus).join(chosen, "sample_id", "left_semi")
    return _sum_by_catalog_column(edges, tables, axis, column).orderBy(F.desc("n"), column)


def _sum_by_catalog_column(edges: DataFrame, tables: Tables, axis, column: str) -> DataFrame:
    per_change = edges.groupBy("change_id").agg(F.count("*").alias("n"))
    catalog = axis.named(tables)
    if column == "change_id":
        return per_change
    return per_change.join(catalog.select("change_id", column), "change_id").groupBy(column).agg(
        F.sum("n").alias("n")
    )


# --- changes by collection date ------------------------------------------------------------------


def distinct_samples_per_change_and_bin(tables: Tables, axis, edges: DataFrame, binned: DataFrame,
                                        date_bin: DateBin, extra=()) -> DataFrame:
    """Distinct samples per (bin, change as it reads, extra columns of ``binned``).

    The edges meet the narrow change keys first and the samples second. After that join the rows lie
    by sample, which already suits the distinct step, so only the partial counts move again.
    """
    keyed = edges.select("change_id", "sample_id").join(change_keys(tables, axis), "change_id")
    placed = keyed.join(binned, "sample_id")
    counted = placed.groupBy(*date_bin.names, "key_id", *extra).agg(F.countDistinct("sample_id").alias("n"))
    return with_change_names(counted, tables, axis)


def _changes_by_date(tables, axis, edges, binned, date_bin) -> DataFrame:
    counted = distinct_samples_per_change_and_bin(tables, axis, edges, binned, date_bin)
    return date_bin.labelled(counted).orderBy(*date_bin.order, *axis.columns)


def count_variants_by_collection_date(tables: Tables, date_bin: DateBin = MONTH, axis: str = "aa",
                                      where: Filter = None,
                                      max_span_days: int = DEFAULT_MAX_SPAN_DAYS) -> DataFrame:
    """Distinct samples per (collection bin, intra-host change)."""
    axis = change_axis(axis)
    binned = binned_samples(tables, date_bin, where, max_span_days=max_span_days, lineages="left")
    return _changes_by_date(tables, axis, tables[axis.intrahost], binned, date_bin)


def count_mutations_by_collection_date(tables: Tables, date_bin: DateBin = MONTH, axis: str = "aa",
                                       where: Filter = None,
                                       max_span_days: int = DEFAULT_MAX_SPAN_DAYS) -> DataFrame:
    """Distinct samples per (collection bin, consensus change). Here the filter may also look at the
    columns of the change."""
    axis = change_axis(axis)
    edges = tables[axis.consensus]
    condition = as_filter(where)
    if condition is not None:
        calls = tables.samples_lineages.join(tables.named_lineages, "lineage_id")
        scope = tables.samples_geo.join(calls.withColumnRenamed("sample_id", "id"), "id", "left")
        catalog = axis.named(tables)
        if not resolves(scope, condition):
            if resolves(catalog, condition):
                # about the change alone: fewer changes meet the edges
                edges = edges.join(catalog.filter(condition).select("change_id"), "change_id", "left_semi")
            else:
                # mixes both: decide per (change, sample), with the tables that the filter mentions
                named = edges.join(catalog, "change_id")
                for fans_out, samples in ((False, tables.samples), (False, tables.samples_geo), (True, scope)):
                    rows = named.join(samples.withColumnRenamed("id", "sample_id"), "sample_id")
                    if fans_out or resolves(rows, condition):
                        break
                edges = rows.filter(condition).select("change_id", "sample_id")
                edges = edges.distinct() if fans_out else edges
            where = None
        elif resolves(tables.samples_geo, condition):
            edges = tables.edges_of_samples(axis.consensus)
    binned = binned_samples(tables, date_bin, where, max_span_days=max_span_days, lineages="left")
    return _changes_by_date(tables, axis, edges, binned, date_bin)


