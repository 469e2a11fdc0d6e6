"""Registered queries: every operator over the whole test tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from virosieve.functions.dates import MONTH, WEEK, every
from virosieve.operators import (
    annotations, counts, lineages, mutations, phenotype, samples, variants, wastewater,
)
from virosieve.plans.durable import fresh_path
from virosieve.workload import binding

Query = Callable[[SparkSession, str], DataFrame]

ORIGIN = dt.date(1995, 1, 1)
TODAY = dt.date(2001, 6, 1)
DAYS = every(14, ORIGIN)


def portable(df: DataFrame) -> DataFrame:
    """Dates as text, decimals as doubles, doubles to six places: the same values in every engine."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            column = column.cast("string")
        elif isinstance(field.dataType, (T.DecimalType, T.DoubleType, T.FloatType)):
            column = F.round(column.cast("double"), 6)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            column = column.cast("bigint")
        out.append(column.alias(field.name))
    return df.select(*out)


def on_tables(operator: Callable[..., DataFrame], *args, **params) -> Query:
    def run(spark: SparkSession, sf_dir: str, tables=binding.tables) -> DataFrame:
        return portable(operator(tables(spark, sf_dir), *args, **params))

    return run


def _load_from_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score load from a cache that was written before, as after an ingest."""
    tables = binding.tables(spark, sf_dir)
    path = fresh_path(spark, "metric-sum-cache")
    phenotype.write_metric_sum_cache(tables, path)
    cached = tables.replace(metric_sum_cache=spark.read.parquet(path))
    return portable(phenotype.metric_load_mutations_by_date(cached, "price", MONTH))


SAMPLE_WHERE = "host = 'BUILDING' AND (country_name = 'ASIA' OR platform = '1-URGENT')"
LINEAGE_WHERE = "host = 'BUILDING' AND (lineage_name = 'N3' OR abundance > 0.4)"
CATALOG_WHERE_NT = "region = 'Brand-12' AND (position_nt > 25 OR ref_nt = 'A')"
CATALOG_WHERE_AA = "position_aa <= 10 AND (ref_aa = 'A' OR alt_aa = 'K')"
FEATURE = "ECONOMY"


def query_operators() -> dict[str, Query]:
    q: dict[str, Query] = {}
    t = on_tables

    # discovery and samples
    for field in ("host", "region", "admin1_name", "lineage_system_name"):
        q[f"distinct_values_{field}"] = t(samples.distinct_values, field)
    q["distinct_values"] = t(samples.distinct_values, "admin1_name", SAMPLE_WHERE)
    q["distinct_values_search"] = t(samples.distinct_values_search, "admin1_name", "nasion_2")
    q["gff_features"] = t(samples.gff_features)
    q["sample_by_id"] = t(samples.sample_by_id, 7)
    q["samples"] = t(samples.samples, SAMPLE_WHERE)
    q["samples_by_mutation_nt"] = t(samples.samples_by_mutation, CATALOG_WHERE_NT, "nt")
    q["samples_by_mutation_aa"] = t(samples.samples_by_mutation, CATALOG_WHERE_AA, "aa")
    q["samples_by_variant_nt"] = t(samples.samples_by_variant, CATALOG_WHERE_NT, "nt", 0.2, 0.55)
    q["samples_by_variant_aa"] = t(samples.samples_by_variant, CATALOG_WHERE_AA, "aa", 0.9, None)
    q["sample_counts"] = t(counts.sample_counts, "lineage,collection_date", MONTH, SAMPLE_WHERE)
    # the further routes of the dispatcher
    q["sample_counts_column"] = t(counts.sample_counts, "admin1_name", MONTH, "platform <> '5-LOW'")
    q["sample_counts_release_date"] = t(counts.sample_counts, "release_date", MONTH, "country_name = 'EUROPE'")
    q["sample_counts_collection_date"] = t(counts.sample_counts, "collection_date", MONTH, SAMPLE_WHERE)
    q["sample_counts_lineage"] = t(counts.sample_counts, "lineage", MONTH, SAMPLE_WHERE)
    q["sample_counts_lineage_release_date"] = t(counts.sample_counts, "lineage,release_date", MONTH, "host = 'BUILDING'")
    q["count_samples_by_column"] = t(counts.count_samples_by_column, "admin1_name", "platform <> '5-LOW'")
    q["count_samples_by_column_host"] = t(counts.count_samples_by_column, "host")
    for unit, date_bin in (("", MONTH), ("_week", WEEK), ("_days", DAYS)):
        q[f"count_samples_by_release_date{unit}"] = t(
            counts.count_samples_by_simple_date, "release_date", date_bin, "country_name = 'EUROPE'"
        )
        q[f"count_samples_by_creation_date{unit}"] = t(counts.count_samples_by_simple_date, "creation_date", date_bin)
        q[f"count_samples_by_collection_date{unit}"] = t(
            counts.count_samples_by_collection_date, date_bin, SAMPLE_WHERE
        )
        q[f"count_lineages_by_simple_date{unit}"] = t(
            counts.count_lineages_by_simple_date, "release_date", date_bin, "host = 'BUILDING'"
        )
        q[f"count_lineages_by_collection_date{unit}"] = t(
            counts.count_lineages_by_collection_date, date_bin, LINEAGE_WHERE
        )
        q[f"collection_release_lag{unit}"] = t(samples.collection_release_lag, date_bin)
    q["sample_counts_by_lineage"] = t(counts.sample_counts_by_lineage, SAMPLE_WHERE)
    q["sample_counts_by_lineage_all"] = t(counts.sample_counts_by_lineage)

    # intra-host and consensus changes
    for axis, where in (("nt", CATALOG_WHERE_NT), ("aa", CATALOG_WHERE_AA)):
        column = "region" if axis == "nt" else "position_aa"
        q[f"variants_{axis}"] = t(variants.variants, where, axis, 0.3, 0.6)
        q[f"variants_by_sample_{axis}"] = t(variants.variants_by_sample, SAMPLE_WHERE, axis, None, 0.5)
        q[f"count_variants_by_column_{axis}"] = t(counts.count_variants_by_column, column, axis)
        q[f"count_variants_by_column_{axis}_filtered"] = t(
            counts.count_variants_by_column, column, axis, LINEAGE_WHERE
        )
        q[f"mutations_{axis}"] = t(mutations.mutations, where, axis)
        q[f"mutations_by_sample_{axis}"] = t(mutations.mutations_by_sample, SAMPLE_WHERE, axis)
        q[f"count_mutations_by_column_{axis}"] = t(counts.count_mutations_by_column, column, axis)
        q[f"count_mutations_by_column_{axis}_filtered"] = t(
            counts.count_mutations_by_column, column, axis, SAMPLE_WHERE
        )
        q[f"count_variants_by_collection_date_{axis}"] = t(
            counts.count_variants_by_collection_date, MONTH, axis, LINEAGE_WHERE if axis == "aa" else None
        )
        q[f"count_mutations_by_collection_date_{axis}"] = t(
            counts.count_mutations_by_collection_date, MONTH, axis, "host = 'BUILDING'" if axis == "aa" else None
        )
        q[f"variant_frequency_by_collection_date_{axis}"] = t(
            variants.variant_frequency_by_collection_date, MONTH, axis
        )
        q[f"mutation_incidence_{axis}"] = t(lineages.mutation_incidence, "N17", "consensus", axis, 0.01)
    q["count_variants_by_freq_range_aa"] = t(counts.count_variants_by_column, "alt_freq_range", "aa")
    q["count_variants_by_collection_date_aa_week"] = t(counts.count_variants_by_collection_date, WEEK, "aa", SAMPLE_WHERE)
    q["count_mutations_by_collection_date_aa_days"] = t(
        counts.count_mutations_by_collection_date, DAYS, "aa", "position_aa < 20 AND country_name = 'ASIA'"
    )
    q["variant_frequency_by_collection_date_aa_week"] = t(
        variants.variant_frequency_by_collection_date, WEEK, "aa", SAMPLE_WHERE
    )
    q["variant_sample_frequency_nt"] = t(variants.variant_sample_frequency, "Brand-17:C28A", "nt")
    q["variant_sample_frequency_aa"] = t(variants.variant_sample_frequency, "STANDARD:A29D", "aa")
    q["mutation_sample_count_nt"] = t(mutations.mutation_sample_count, "Brand-17:C28A", "nt")
    q["mutation_sample_count_aa"] = t(mutations.mutation_sample_count, "STANDARD:A29D", "aa")
    q["variant_counts_by_score"] = t(variants.variant_counts_by_score, FEATURE, "signed_size", True)
    q["variant_counts_by_score_filtered"] = t(
        variants.variant_counts_by_score, FEATURE, "price", False, SAMPLE_WHERE
    )
    q["mutation_counts_by_score"] = t(mutations.mutation_counts_by_score, FEATURE, "signed_size")
    q["mutation_counts_by_score_filtered"] = t(
        mutations.mutation_counts_by_score, FEATURE, "signed_size", True, SAMPLE_WHERE
    )
    q["mutation_count_by_date_and_lineage_nt"] = t(
        mutations.mutation_count_by_date_and_lineage, "Brand-17", 28, "A", "nt"
    )
    q["mutation_count_by_date_and_lineage_aa"] = t(
        mutations.mutation_count_by_date_and_lineage, "STANDARD", 29, "D", "aa", MONTH, "lineage_name <> 'N3' AND host <> 'BUILDING'"
    )
    q["mutations_before_variants"] = t(mutations.mutations_before_variants, "N3", "consensus")
    q["variants_before_mutations"] = t(mutations.variants_before_mutations, "N3", "consensus")

    # lineages
    q["lineages_in_system"] = t(lineages.lineages_in_system, "demixed")
    q["abundances"] = t(lineages.abundances, SAMPLE_WHERE)
    q["abundance_summaries"] = t(lineages.abundance_summaries)
    q["abundance_summaries_filtered"] = t(lineages.abundance_summaries, LINEAGE_WHERE)
    q["abundance_summaries_by_collection_date"] = t(lineages.abundance_summaries_by_collection_date, MONTH)
    q["abundance_summaries_by_collection_date_week"] = t(
        lineages.abundance_summaries_by_collection_date, WEEK, SAMPLE_WHERE
    )
    q["lineage_counts_over_time"] = t(lineages.lineage_counts_over_time, MONTH)
    q["lineage_counts_over_time_recent"] = t(
        lineages.lineage_counts_over_time, WEEK, "host <> 'BUILDING'", "N3", 400, today=TODAY
    )
    q["lineage_counts_over_time_days"] = t(lineages.lineage_counts_over_time, DAYS)
    q["mutation_incidence_reference"] = t(
        lineages.mutation_incidence, "N17", "consensus", "aa", 0.01, True, "platform <> '5-LOW'"
    )
    q["mutation_profile"] = t(lineages.mutation_profile, "N3", "consensus")
    q["mutation_profile_filtered"] = t(lineages.mutation_profile, "N3", "consensus", "host = 'BUILDING'")
    q["lineage_descendants"] = t(lineages.lineage_descendants)

    # wastewater
    q["ww_abundances_by_sample"] = t(wastewater.ww_abundances_by_sample, "country_name = 'ASIA'")
    q["ww_average_abundance"] = t(wastewater.ww_average_abundance, "admin1_name")
    q["ww_average_abundance_census"] = t(wastewater.ww_average_abundance, "census_region", "N3")
    q["ww_average_abundance_wildcard"] = t(
        wastewater.ww_average_abundance, "admin1_name", "R2*", "host <> 'BUILDING'"
    )
    q["ww_lineage_counts"] = t(wastewater.ww_lineage_counts, "country_name = 'ASIA' OR host = 'BUILDING'")
    q["ww_sample_counts"] = t(wastewater.ww_sample_counts, "admin1_name")
    q["ww_sample_counts_site"] = t(wastewater.ww_sample_counts, "ww_site_id", SAMPLE_WHERE)
    q["ww_latest_samples"] = t(samples.ww_latest_samples, "country_name = 'ASIA' OR host = 'BUILDING'")

    # phenotype
    q["phenotype_metrics"] = t(phenotype.phenotype_metrics)
    q["metric_min_max"] = t(phenotype.metric_min_max, "price")
    q["metric_min_max_unknown"] = t(phenotype.metric_min_max, "no such metric")
    for unit, date_bin, where in (("", MONTH, None), ("_week", WEEK, SAMPLE_WHERE)):
        q[f"scored_mutations_by_date{unit}"] = t(
            phenotype.scored_mutations_by_date, "signed_size", 10.0, date_bin, where
        )
        q[f"scored_variants_by_date{unit}"] = t(
            phenotype.scored_variants_by_date, "signed_size", 10.0, date_bin, where, 0.25, 0.75
        )
        q[f"metric_load_mutations_by_date{unit}"] = t(
            phenotype.metric_load_mutations_by_date, "price", date_bin, where
        )
        q[f"metric_load_variants_by_date{unit}"] = t(phenotype.metric_load_variants_by_date, "price", date_bin, where)
        q[f"annotation_proportion_mutations_by_date{unit}"] = t(
            annotations.annotation_proportion_mutations_by_date, "Brand#12", date_bin, where
        )
        q[f"annotation_proportion_variants_by_date{unit}"] = t(
            annotations.annotation_proportion_variants_by_date, "Brand#12", date_bin, where
        )
    q["metric_load_mutations_by_date_cached"] = _load_from_cache
    q["metric_quantile_mutations"] = t(phenotype.metric_quantile_mutations, "signed_size", 0.9)
    q["metric_quantile_variants"] = t(phenotype.metric_quantile_variants, "price", 0.25)
    q["metric_sum_cache"] = t(phenotype.metric_sum_cache)

    # annotations
    q["annotation_effects"] = t(annotations.annotation_effects)
    q["annotated_positions_mutations"] = t(annotations.annotated_positions_mutations, "Brand#12")
    q["annotated_positions_variants"] = t(annotations.annotated_positions_variants, "Brand#12", SAMPLE_WHERE)
    q["annotation_id_sets"] = t(annotations.annotation_id_sets, "Brand#12")
    for name in binding.WHOLE_EDGES:
        q[name] = partial(q[name], tables=binding.whole_tables)
    return q
