"""Sample look-up, discovery of values, and the collection-to-release lag."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from virosieve.functions.dates import DEFAULT_MAX_SPAN_DAYS, MONTH, DateBin, max_span_filter, mid_collection_date
from virosieve.functions.fuzzy import MIN_SCORE, match_ratio, ratio_bound
from virosieve.operators.common import (
    Filter, change_axis, filtered, intrahost_window, ww_flag,
)
from virosieve.plans.quantiles import QUARTILES, few_valued_quantiles
from virosieve.tables import GEO_COLUMNS, Tables

# The columns whose values may be listed, by the table they live in.
SAMPLE_FIELDS = (
    "host", "organism", "serotype", "platform", "instrument", "assay_type", "library_selection",
    "library_source", "library_layout", "isolation_source", "center_name", "bio_project",
)
OTHER_FIELDS = {
    "region": "alleles",
    "gff_feature": "amino_acids",
    "lineage_system_name": "lineage_systems",
}


def with_place(samples: DataFrame, tables: Tables) -> DataFrame:
    """Sample rows with their place as ``geo_*`` columns."""
    geo = tables.geo_locations.select(
        F.col("id").alias("geo_location_id"), *[F.col(c).alias(f"geo_{c}") for c in GEO_COLUMNS]
    )
    return samples.join(geo, "geo_location_id", "left")


def distinct_values(tables: Tables, field: str, where: Filter = None) -> DataFrame:
    """Sorted distinct non-null values of a listed field, as ``value``. A filter needs a sample or
    place field."""
    if field in OTHER_FIELDS:
        if where is not None:
            raise ValueError(f"{field} is not a sample or place field, so it cannot be filtered")
        source = tables[OTHER_FIELDS[field]]
    elif field not in SAMPLE_FIELDS and field not in GEO_COLUMNS:
        raise ValueError(f"values of {field} are not listed")
    elif where is not None:
        source = filtered(tables.samples_geo, where)
    else:
        # the place table itself is far smaller than the samples
        source = tables.samples if field in SAMPLE_FIELDS else tables.geo_locations
    values = source.select(F.col(field).alias("value")).filter("value IS NOT NULL")
    return values.distinct().orderBy("value")


def distinct_values_search(tables: Tables, field: str, search: str | None, where: Filter = None) -> DataFrame:
    """The listed values that resemble ``search``, best first. A substring hit scores 1; other values
    score by similarity of the lower-case texts and are dropped below the threshold."""
    values = distinct_values(tables, field, where)
    needle = (search or "").strip().lower()
    if not needle:
        return values
    text = F.lower("value")
    at = F.instr(text, F.lit(needle)) - 1
    # two branches, so the similarity UDF runs for values without a substring hit only
    hits = values.filter(at >= 0).select("value", F.lit(1.0).alias("score"))
    # and only for those whose letters can reach the threshold (less a little for the rounding of the bound)
    able = values.filter((at < 0) & (ratio_bound(needle, text) >= MIN_SCORE - 1e-9))
    rest = able.select("value", match_ratio(needle, text).alias("score"))
    scored = hits.unionByName(rest.filter(F.col("score") >= MIN_SCORE))
    return scored.orderBy(F.desc("score"), at, F.length("value"), "value")


def gff_features(tables: Tables) -> DataFrame:
    return tables.amino_acids.select("gff_feature").distinct()


def sample_by_id(tables: Tables, sample_id: int) -> DataFrame:
    return with_place(tables.samples.filter(F.col("id") == sample_id), tables)


def samples(tables: Tables, where: Filter) -> DataFrame:
    chosen = filtered(tables.samples_geo, where)
    for name in GEO_COLUMNS:
        chosen = chosen.withColumnRenamed(name, f"geo_{name}")
    return chosen


def samples_by_mutation(tables: Tables, where: Filter, axis: str = "aa") -> DataFrame:
    """Samples that carry any consensus change passing a catalog filter."""
    axis = change_axis(axis)
    changes = filtered(axis.named(tables), where).select("change_id")
    carriers = tables[axis.consensus].join(changes, "change_id", "left_semi")
    return _carrying(tables, carriers)


def samples_by_variant(tables: Tables, where: Filter, axis: str = "aa",
                       min_freq: float | None = None, max_freq: float | None = None) -> DataFrame:
    """The same over intra-host changes, within a frequency window."""
    axis = change_axis(axis)
    changes = filtered(axis.named(tables), where).select("change_id")
    edges = intrahost_window(tables[axis.intrahost], min_freq, max_freq)
    return _carrying(tables, edges.join(changes, "change_id", "left_semi"))


def _carrying(tables: Tables, carriers: DataFrame) -> DataFrame:
    ids = carriers.select(F.col("sample_id").alias("id")).distinct()
    return with_place(tables.samples.join(ids, "id", "left_semi"), tables)


def collection_release_lag(tables: Tables, date_bin: DateBin = MONTH,
                           max_span_days: int = DEFAULT_MAX_SPAN_DAYS) -> DataFrame:
    """Quartiles, per bin, of the days from mid collection to release."""
    mid = mid_collection_date()
    lags = tables.samples.filter(max_span_filter(max_span_days)).select(
        *date_bin.columns(mid), F.datediff(F.col("release_date").cast("date"), mid).alias("lag")
    )
    # days: the domain is the calendar, so equal lags are counted first
    quartiles = few_valued_quantiles(lags, date_bin.names, "lag", QUARTILES, ["lag_q1", "lag_median", "lag_q3"])
    return date_bin.labelled(quartiles).orderBy(*date_bin.order)


def ww_latest_samples(tables: Tables, where: Filter = None) -> DataFrame:
    """All wastewater samples that share the latest collection start within the filter."""
    chosen = samples(tables, where).filter(ww_flag())
    latest = filtered(tables.samples_geo, where).filter(ww_flag()).select(F.max("collection_start_date"))
    return chosen.filter(F.col("collection_start_date") == latest.scalar())
