"""Phenotype scores: ranges, quantiles, scored changes over time, and the score load of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from virosieve.functions.dates import DEFAULT_MAX_SPAN_DAYS, MONTH, DateBin
from virosieve.operators.common import Filter, binned_samples, intrahost_window
from virosieve.operators.upkeep import score_sums
from virosieve.plans.joins import join_null_safe
from virosieve.plans.quantiles import QUARTILES, exact_quantiles, few_valued_quantiles
from virosieve.tables import Tables


def phenotype_metrics(tables: Tables) -> DataFrame:
    return tables.phenotype_metrics.select(
        "id",
        F.col("phenotype_metric_name").alias("name"),
        F.col("phenotype_metric_assay_type").alias("assay_type"),
    )


def _scores(tables: Tables, metric: str) -> DataFrame:
    """``change_id, value`` of one metric; a change has at most one value."""
    wanted = tables.phenotype_metrics.filter(F.col("phenotype_metric_name") == metric).select(
        F.col("id").alias("phenotype_metric_id")
    )
    return tables.phenotype_metric_values.join(wanted, "phenotype_metric_id", "left_semi").select(
        F.col("amino_acid_id").alias("change_id"), "value"
    )


def metric_min_max(tables: Tables, metric: str) -> DataFrame:
    """One row with the smallest and largest value; nulls for an unknown metric."""
    return _scores(tables, metric).agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"))


def _metric_quantile(tables: Tables, edges: DataFrame, metric: str, q: float) -> DataFrame:
    if not 0 <= q <= 1:
        raise ValueError("a quantile lies in [0, 1]")
    carried = _scores(tables, metric).filter(F.col("value") != 0).join(edges.select("change_id"), "change_id", "left_semi")
    found = exact_quantiles(carried, [], "value", [q], ["phenotype_metric_value"], discrete=True)
    # one row also when there is nothing to rank
    return found.agg(F.max("phenotype_metric_value").alias("phenotype_metric_value")).select(
        F.lit(float(q)).alias("quantile"), "phenotype_metric_value"
    )


def metric_quantile_mutations(tables: Tables, metric: str, q: float) -> DataFrame:
    """Discrete quantile of the non-zero values of changes that have a consensus carrier."""
    return _metric_quantile(tables, tables.cns_aa, metric, q)


def metric_quantile_variants(tables: Tables, metric: str, q: float) -> DataFrame:
    """The same for changes that have an intra-host carrier."""
    return _metric_quantile(tables, tables.ih_aa, metric, q)


def _scored_by_date(tables, edges, metric, threshold, date_bin, where, max_span_days) -> DataFrame:
    """Scored changes present in a bin: a change counts once per bin however many samples carry it.

    Edges join the scores and the binned samples, then collapse to (bin, change) with map-side
    combine; bins are never paired with the whole catalog.
    """
    binned = binned_samples(tables, date_bin, where, max_span_days=max_span_days, lineages="inner")
    present = (
        edges.select("change_id", "sample_id")
        .join(_scores(tables, metric), "change_id")
        .join(binned, "sample_id")
        .groupBy(*date_bin.names, "change_id")
        .agg(F.max("value").alias("value"))
    )
    counted = present.groupBy(*date_bin.names).agg(
        F.count_if(F.col("value") >= threshold).alias("n_gte"), F.count("*").alias("n")
    )
    return date_bin.labelled(counted).orderBy(*date_bin.order)


def scored_mutations_by_date(tables: Tables, metric: str, threshold: float, date_bin: DateBin = MONTH,
                             where: Filter = None, max_span_days: int = DEFAULT_MAX_SPAN_DAYS) -> DataFrame:
    """Scored consensus changes per bin, and how many reach the threshold."""
    return _scored_by_date(tables, tables.cns_aa, metric, threshold, date_bin, where, max_span_days)


def scored_variants_by_date(tables: Tables, metric: str, threshold: float, date_bin: DateBin = MONTH,
                            where: Filter = None, min_freq: float | None = None, max_freq: float | None = None,
                            max_span_days: int = DEFAULT_MAX_SPAN_DAYS) -> DataFrame:
    """Scored intra-host changes per bin, within a frequency window."""
    edges = intrahost_window(tables.ih_aa, min_freq, max_freq)
    return _scored_by_date(tables, edges, metric, threshold, date_bin, where, max_span_days)


def metric_sum_cache(tables: Tables) -> DataFrame:
    """Per (sample, metric): the sum of the scores its consensus changes have, and their number.

    Meant to be written after each ingest (or kept up by it, see ``upkeep``) and read as
    ``metric_sum_cache``.
    """
    return score_sums(tables, tables.cns_aa, "n_scored_mutations")


def variant_sum_cache(tables: Tables) -> DataFrame:
    """The same of distinct intra-host changes, read as ``variant_sum_cache``."""
    return score_sums(tables, tables.edges_of_samples("ih_aa"), "n_scored_variants")


def write_metric_sum_cache(tables: Tables, path: str) -> None:
    metric_sum_cache(tables).write.mode("overwrite").partitionBy("phenotype_metric_id").parquet(path)


def _load_quartiles(per_sample: DataFrame, date_bin: DateBin) -> DataFrame:
    """Quartiles per bin of the score sum and of the number of scored changes of a sample."""
    keys = date_bin.names
    # equal samples are counted once; both quantiles start from this one shuffle
    counted = per_sample.groupBy(*keys, "load", "n_aa").agg(F.count("*").alias("n_samples"))
    sums = exact_quantiles(
        counted, keys, "load", QUARTILES,
        ["aggregate_value_q1", "aggregate_value_median", "aggregate_value_q3"], weight="n_samples",
    )
    # a count of changes: few values, however many samples
    numbers = few_valued_quantiles(
        counted, keys, "n_aa", QUARTILES, ["n_aa_q1", "n_aa_median", "n_aa_q3"], weight="n_samples"
    )
    return date_bin.labelled(join_null_safe(numbers, sums, keys)).orderBy(*date_bin.order)


def _cached_load(tables: Tables, cache: DataFrame, number: str, metric: str, date_bin: DateBin, binned: DataFrame) -> DataFrame:
    wanted = tables.phenotype_metrics.filter(F.col("phenotype_metric_name") == metric).select(
        F.col("id").alias("phenotype_metric_id")
    )
    per_sample = (
        cache.join(wanted, "phenotype_metric_id", "left_semi")
        .join(binned, "sample_id")
        .select(*date_bin.names, F.col("pmv_value_sum").alias("load"), F.col(number).alias("n_aa"))
    )
    return _load_quartiles(per_sample, date_bin)


def metric_load_mutations_by_date(tables: Tables, metric: str, date_bin: DateBin = MONTH, where: Filter = None,
                                  max_span_days: int = DEFAULT_MAX_SPAN_DAYS) -> DataFrame:
    """Score load of consensus changes per bin, from the cached sums when the tables hold them. A
    sample counts once, whatever the number of its lineages."""
    cache = tables.metric_sum_cache if "metric_sum_cache" in tables else metric_sum_cache(tables)
    binned = binned_samples(tables, date_bin, where, max_span_days=max_span_days, lineages="inner")
    return _cached_load(tables, cache, "n_scored_mutations", metric, date_bin, binned)


def metric_load_variants_by_date(tables: Tables, metric: str, date_bin: DateBin = MONTH, where: Filter = None,
                                 max_span_days: int = DEFAULT_MAX_SPAN_DAYS) -> DataFrame:
    """Score load of intra-host changes per bin, from the cached sums when the tables hold them. A
    change a sample shows in two frequency bins counts once."""
    binned = binned_samples(tables, date_bin, where, max_span_days=max_span_days, lineages="inner")
    if "variant_sum_cache" in tables:
        return _cached_load(tables, tables.variant_sum_cache, "n_scored_variants", metric, date_bin, binned)
    # scores and dates cut the edges before any of them is made distinct, and the bin comes along, so
    # making them distinct and summing them up both lie by sample, as the join left them
    per_sample = (
        tables.edges_of_samples("ih_aa")
        .select("change_id", "sample_id")
        .join(_scores(tables, metric), "change_id")
        .join(binned, "sample_id")
        .groupBy("sample_id", *date_bin.names, "change_id")
        .agg(F.max("value").alias("value"))
        .groupBy("sample_id", *date_bin.names)
        .agg(F.sum("value").alias("load"), F.count("*").alias("n_aa"))
    )
    return _load_quartiles(per_sample, date_bin)
