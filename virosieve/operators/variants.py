"""Intra-host changes: rows, frequencies and counts by score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from virosieve.functions.changes import bin_lower, bin_midpoint, bin_text, bin_upper, split_change
from virosieve.functions.dates import DEFAULT_MAX_SPAN_DAYS, MONTH, DateBin
from virosieve.operators.common import (
    AA, Axis, Filter, as_filter, binned_samples, change_axis, change_keys, filtered, intrahost_window,
    select_samples, with_change_names,
)
from virosieve.plans.joins import own_shuffle
from virosieve.plans.quantiles import QUARTILES
from virosieve.tables import Tables


def _frequency_columns():
    index = F.col("freq_bin")
    return [
        bin_text(index).alias("alt_freq_range"),
        bin_lower(index).cast("double").alias("alt_freq_lower"),
        bin_upper(index).cast("double").alias("alt_freq_upper"),
    ]


def variants(tables: Tables, where: Filter, axis: str = "nt", min_freq: float | None = None,
             max_freq: float | None = None) -> DataFrame:
    """(sample, change, frequency bin) rows for a catalog filter and a frequency window."""
    axis = change_axis(axis)
    edges = intrahost_window(tables[axis.intrahost], min_freq, max_freq)
    rows = edges.join(filtered(axis.named(tables), where), "change_id")
    return _variant_rows(rows, axis)


def variants_by_sample(tables: Tables, where: Filter, axis: str = "nt", min_freq: float | None = None,
                       max_freq: float | None = None) -> DataFrame:
    """The same rows for the samples that pass a sample filter."""
    axis = change_axis(axis)
    chosen = select_samples(tables, where).select(F.col("id").alias("sample_id"))
    edges = intrahost_window(tables[axis.intrahost], min_freq, max_freq)
    rows = edges.join(chosen, "sample_id", "left_semi").join(axis.named(tables), "change_id")
    return _variant_rows(rows, axis)


def _variant_rows(rows: DataFrame, axis: Axis) -> DataFrame:
    ids = [F.col("change_id").alias("allele_id")] if axis.name == "nt" else []
    return rows.select("sample_id", *ids, *axis.columns, *axis.codons, *_frequency_columns())


def variant_frequency_by_collection_date(tables: Tables, date_bin: DateBin = MONTH, axis: str = "aa",
                                         where: Filter = None,
                                         max_span_days: int = DEFAULT_MAX_SPAN_DAYS) -> DataFrame:
    """Per (change, collection bin): distinct samples and quartiles of frequency. An observation
    stands for the midpoint of its frequency bin, so the quartiles have bin resolution."""
    axis = change_axis(axis)
    binned = binned_samples(tables, date_bin, where, max_span_days=max_span_days, lineages="left")
    edges = tables[axis.intrahost].select("change_id", "sample_id", "freq_bin")
    rows = edges.join(change_keys(tables, axis), "change_id").join(binned, "sample_id")
    keys = ["key_id", *date_bin.names]

    # one row per (change, bin, sample, frequency bin); the first of a sample counts the sample
    per_sample = rows.groupBy(*keys, "sample_id", "freq_bin").agg(F.count("*").alias("n_obs"))
    in_sample = Window.partitionBy(*keys, "sample_id").orderBy("freq_bin")
    marked = per_sample.withColumn("first", (F.row_number().over(in_sample) == 1).cast("int"))
    # at most 20 rows per (change, bin) from here on
    per_bin = marked.groupBy(*keys, "freq_bin").agg(F.sum("n_obs").alias("n_obs"), F.sum("first").alias("first"))
    out = per_bin.groupBy(*keys).agg(
        F.sum("first").alias("n"),
        F.percentile(bin_midpoint(F.col("freq_bin")), list(QUARTILES), F.col("n_obs")).alias("q"),
    )
    named = with_change_names(out, tables, axis).select(
        *axis.columns,
        *date_bin.names,
        "n",
        F.col("q")[0].alias("alt_freq_q1"),
        F.col("q")[1].alias("alt_freq_median"),
        F.col("q")[2].alias("alt_freq_q3"),
    )
    return date_bin.labelled(named).orderBy(*date_bin.order, *axis.columns)


def _one_change(tables: Tables, axis: Axis, change: str) -> DataFrame:
    feature, ref, position, alt = split_change(change)
    return axis.named(tables).filter(
        (F.col(axis.feature) == feature)
        & (F.col(axis.ref) == ref)
        & (F.col(axis.position) == position)
        & (F.col(axis.alt) == alt)
    )


def variant_sample_frequency(tables: Tables, change: str, axis: str = "aa") -> DataFrame:
    """The frequency bin of every sample that shows one change, by frequency and sample."""
    axis = change_axis(axis)
    edges = tables[axis.intrahost].join(_one_change(tables, axis, change).select("change_id"), "change_id", "left_semi")
    names = tables.samples.select(F.col("id").alias("sample_id"), "accession")
    rows = edges.select("sample_id", "freq_bin").join(names, "sample_id")
    return rows.select("sample_id", "accession", *_frequency_columns()).orderBy("alt_freq_lower", "sample_id")


def counts_by_score(tables: Tables, edges: DataFrame, region: str, metric: str, include_refs: bool,
                    where: Filter) -> DataFrame:
    """Distinct samples per (change, score) of one feature and metric, largest first."""
    metrics = tables.phenotype_metrics.filter(F.col("phenotype_metric_name") == metric).select(
        F.col("id").alias("phenotype_metric_id")
    )
    changes = AA.named(tables).filter(F.col("gff_feature") == region)
    if not include_refs:
        changes = changes.filter(F.col("ref_aa") != F.col("alt_aa"))
    scored = (
        tables.phenotype_metric_values.join(metrics, "phenotype_metric_id", "left_semi")
        .withColumnRenamed("amino_acid_id", "change_id")
        .join(changes, "change_id")
        .select("change_id", "ref_aa", "position_aa", "alt_aa", "value")
    )
    scored = own_shuffle(scored, "change_id")
    carriers = edges.select("change_id", "sample_id")
    if as_filter(where) is not None:
        chosen = select_samples(tables, where).select(F.col("id").alias("sample_id"))
        carriers = carriers.join(chosen, "sample_id", "left_semi")
    keys = ["ref_aa", "position_aa", "alt_aa", "value"]
    counted = carriers.join(scored, "change_id").groupBy(*keys).agg(F.countDistinct("sample_id").alias("count"))
    return counted.withColumnRenamed("value", "pheno_value").orderBy(
        F.desc("count"), "position_aa", "ref_aa", "alt_aa", "pheno_value"
    )


def variant_counts_by_score(tables: Tables, region: str, metric: str, include_refs: bool = False,
                            where: Filter = None) -> DataFrame:
    """Intra-host distinct samples per scored change of a feature."""
    return counts_by_score(tables, tables.ih_aa, region, metric, include_refs, where)
