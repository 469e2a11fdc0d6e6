"""Wastewater: abundances per sample and population-weighted prevalence per week and place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from virosieve.functions.dates import DEFAULT_MAX_SPAN_DAYS, max_span_filter, mid_collection_date
from virosieve.operators.common import Filter, as_filter, resolves, ww_flag
from virosieve.operators.lineages import call_rows
from virosieve.plans.closure import reachable
from virosieve.tables import GEO_COLUMNS, Tables


def ww_abundances_by_sample(tables: Tables, where: Filter = None) -> DataFrame:
    """(sample, lineage) rows of wastewater samples that have a place. Consensus calls stay, with a
    null abundance."""
    fields = ["accession", "geo_location_id", "ww_collected_by", "ww_site_id", "ww_viral_load",
              "ww_catchment_population", "collection_start_date"]
    calls = tables.samples_lineages.select("sample_id", "lineage_id", "abundance", "is_consensus_call")
    rows = call_rows(tables, where, calls, [F.col(c) for c in fields], [ww_flag()], ["lineage_name"])
    places = tables.geo_locations.select(F.col("id").alias("geo_location_id"), "admin1_name")
    return rows.join(places, "geo_location_id").select(
        "accession", "admin1_name", "ww_collected_by", "ww_site_id", "lineage_name", "abundance",
        "ww_viral_load", "ww_catchment_population", "collection_start_date",
    )


def _lineage_family(tables: Tables, parent: str) -> DataFrame:
    """Ids of the lineages named ``parent`` and of all their descendants."""
    roots = tables.lineages.filter(F.col("lineage_name") == parent).select(F.col("id").alias("lineage_id"))
    return reachable(tables.lineages_immediate_children, roots, "lineage_id")


def ww_average_abundance(tables: Tables, geo_bin: str, lineage: str | None = None, where: Filter = None,
                         max_span_days: int = DEFAULT_MAX_SPAN_DAYS) -> DataFrame:
    """Population-weighted prevalence of lineages per ISO week and place.

    ``geo_bin`` is ``admin1_name`` (with its census region) or ``census_region``. ``lineage`` picks
    one lineage; ``X*`` reports X and all its descendants as one series. Totals run over all
    assignments of the week and place. Groups whose place is not known drop out. ``sample_count``
    and the means are over assignment rows.
    """
    if geo_bin not in ("admin1_name", "census_region"):
        raise ValueError(f"illegal geo_bin: {geo_bin}")
    condition = as_filter(where)
    if geo_bin == "census_region" and condition is not None:
        without_admin1 = tables.samples_geo.drop("admin1_name")
        calls = tables.samples_lineages.join(tables.named_lineages, "lineage_id")
        if not resolves(without_admin1.join(calls.withColumnRenamed("sample_id", "id"), "id"), condition):
            raise ValueError("admin1_name cannot be in the filter when places are census regions")

    week = F.date_trunc("week", mid_collection_date()).cast("date").alias("week_start")
    fields = ["geo_location_id", "census_region", "ww_viral_load", "ww_catchment_population"]
    calls = tables.samples_lineages.select("sample_id", "lineage_id", "abundance", "is_consensus_call")
    rows = call_rows(
        tables, where, calls, [week, *[F.col(c) for c in fields]], [max_span_filter(max_span_days), ww_flag()]
    )

    # One pass over the assignments; everything after it works on sums per (week, place, lineage).
    load, size = F.col("ww_viral_load"), F.col("ww_catchment_population")
    by_place_id = geo_bin == "admin1_name"
    place_keys = ["geo_location_id", "census_region"] if by_place_id else ["census_region"]
    sums = rows.groupBy("week_start", *place_keys, "lineage_id").agg(
        F.sum(F.col("abundance") * size).alias("weighted"),
        F.count("*").alias("n"),
        F.sum(load).alias("load_sum"),
        F.count(load).alias("load_n"),
        F.sum(size.cast("double")).alias("size_sum"),
        F.count(size).alias("size_n"),
    )
    geo = ["census_region"]
    if by_place_id:
        places = tables.geo_locations.select(F.col("id").alias("geo_location_id"), "admin1_name")
        sums = sums.join(places, "geo_location_id").drop("geo_location_id")
        geo = ["admin1_name", "census_region"]
    for name in geo:
        sums = sums.filter(F.col(name).isNotNull())

    keys = ["week_start", *geo]
    group = Window.partitionBy(*keys)
    with_totals = sums.select(
        *keys,
        "lineage_id",
        "weighted",
        "n",
        F.sum("weighted").over(group).alias("total"),
        (F.sum("load_sum").over(group) / F.nullif(F.sum("load_n").over(group), F.lit(0))).alias("mean_viral_load"),
        (F.sum("size_sum").over(group) / F.nullif(F.sum("size_n").over(group), F.lit(0))).alias("mean_catchment_size"),
    )
    if lineage is not None and lineage.endswith("*"):
        family = _lineage_family(tables, lineage.rstrip("*"))
        picked = with_totals.join(family, "lineage_id", "left_semi").withColumn(
            "lineage_name", F.lit(lineage.rstrip("*") + "*")
        )
    else:
        names = tables.lineages.select(F.col("id").alias("lineage_id"), "lineage_name")
        if lineage is not None:
            names = names.filter(F.col("lineage_name") == lineage)
        picked = with_totals.join(names, "lineage_id")
    series = picked.groupBy(*keys, "lineage_name").agg(
        F.sum("n").alias("sample_count"),
        F.first("mean_viral_load").alias("mean_viral_load"),
        F.first("mean_catchment_size").alias("mean_catchment_size"),
        F.try_divide(F.sum("weighted"), F.first("total")).alias("mean_lineage_prevalence"),
    )
    year, chunk = F.year("week_start"), F.weekofyear("week_start")
    return series.select(
        year.alias("year"),
        chunk.alias("chunk"),
        (year * 100 + chunk).alias("epiweek"),
        "week_start",
        F.date_add("week_start", 6).alias("week_end"),
        "lineage_name",
        "census_region",
        (F.col("admin1_name") if by_place_id else F.lit(None).cast("string")).alias("geo_admin1_name"),
        "sample_count",
        "mean_viral_load",
        "mean_catchment_size",
        "mean_lineage_prevalence",
    )


def _with_abundance(tables: Tables, where: Filter, sample_columns) -> DataFrame:
    """Assignments with an abundance, of wastewater samples."""
    calls = tables.samples_lineages.filter(F.col("abundance").isNotNull())
    return call_rows(tables, where, calls, sample_columns, [ww_flag()])


def ww_lineage_counts(tables: Tables, where: Filter = None) -> DataFrame:
    """Abundance rows per lineage name, largest first."""
    counted = _with_abundance(tables, where, []).groupBy("lineage_id").agg(F.count("*").alias("n"))
    names = tables.lineages.select(F.col("id").alias("lineage_id"), "lineage_name")
    named = counted.join(names, "lineage_id", "left").groupBy("lineage_name").agg(F.sum("n").alias("n"))
    return named.orderBy(F.desc("n"), "lineage_name")


def ww_sample_counts(tables: Tables, column: str, where: Filter = None) -> DataFrame:
    """Abundance rows per sample or place column, largest first."""
    if column in GEO_COLUMNS:
        per_place = (
            _with_abundance(tables, where, [F.col("geo_location_id")])
            .groupBy("geo_location_id")
            .agg(F.count("*").alias("n"))
        )
        places = tables.geo_locations.select(F.col("id").alias("geo_location_id"), column)
        counted = per_place.join(places, "geo_location_id", "left").groupBy(column).agg(F.sum("n").alias("n"))
    else:
        counted = _with_abundance(tables, where, [F.col(column)]).groupBy(column).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), column)
