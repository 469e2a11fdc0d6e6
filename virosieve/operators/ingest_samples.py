"""Ingest of samples: cleaning, places, upsert and look-up by accession."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from virosieve.functions.dates import collection_window
from virosieve.functions.values import all_present, blank_to_null, bool_from_text
from virosieve.plans import buckets
from virosieve.plans.durable import cut
from virosieve.plans.ids import assign_ids, highest
from virosieve.plans.joins import join_null_safe
from virosieve.tables import GEO_COLUMNS, Tables

# Accessions that must not be loaded.
EXCLUDED_ACCESSIONS = (
    "SRR28752471", "SRR28752477", "SRR28752528", "SRR28752549", "SRR29182424", "SRR29182425",
    "SRR29182426", "SRR29182427", "SRR29182428", "SRR29182429", "SRR29182430", "SRR29182431",
    "SRR29182432", "SRR29182433", "SRR29182434", "SRR29182435", "SRR29182436", "SRR29182437",
    "SRR29182438", "SRR29182439", "SRR29182440", "SRR29182441", "SRR29182442", "SRR29182443",
    "SRR29182444", "SRR29182445", "SRR29182446", "SRR29182447", "SRR29182448", "SRR29182449",
    "SRR29182450", "SRR29182451", "SRR29182452", "SRR29182453", "SRR29182454", "SRR29182455",
    "SRR29182456", "SRR29182457", "SRR29182458", "SRR29182459", "SRR29182460", "SRR29182461",
    "SRR29182462", "SRR29182463", "SRR29182464", "SRR29182465", "SRR29182466", "SRR29182467",
    "SRR29182468", "SRR29182469", "SRR29182470", "SRR29182471", "SRR29182472", "SRR29182473",
    "SRR29182474", "SRR29182475", "SRR29182476", "SRR29182477", "SRR29182478", "SRR29182479",
    "SRR29182480", "SRR29182481", "SRR29182482", "SRR29182483", "SRR29182484", "SRR29182485",
)

_TEXT_FIELDS = (
    "assay_type", "bio_project", "bio_sample", "bio_sample_model", "bio_sample_accession", "center_name",
    "experiment", "host", "instrument", "isolate", "library_name", "library_layout", "library_selection",
    "library_source", "organism", "platform", "version", "sample_name", "sra_study", "serotype",
    "isolation_source",
)
_REQUIRED = ("accession", "bio_sample_model", "organism", "is_retracted")


def exclude_accessions(rows: DataFrame, excluded: Sequence[str] = EXCLUDED_ACCESSIONS) -> DataFrame:
    """Drop a fixed list of accessions; a short literal list, so no join."""
    return rows.filter(~F.coalesce(F.col("accession").isin(*excluded), F.lit(False)))


def split_geo(rows: DataFrame, text: str = "geo_location", delimiter: str = "/", exact: bool = False) -> DataFrame:
    """Place text to the four place columns, plus ``bad_geo``.

    ``exact`` demands all four parts and keeps them as they are. Otherwise the first four parts are
    trimmed, and missing ones are null.
    """
    parts = F.split(F.col(text), f"\\Q{delimiter}\\E", -1)
    n = F.size(parts)
    bad = F.col(text).isNotNull() & (n != len(GEO_COLUMNS)) if exact else F.lit(False)
    columns = []
    for i, name in enumerate(GEO_COLUMNS):
        part = F.get(parts, i)
        columns.append(F.when(~bad, part if exact else F.trim(part)).alias(name))
    return rows.select("*", *columns, bad.alias("bad_geo"))


def with_collection_window(rows: DataFrame, text: str = "collection_date") -> DataFrame:
    """Collection start and end from text, plus ``bad_collection_date`` for text that means no date."""
    window = collection_window(F.col(text))
    dated = rows.withColumn("__window", window)
    return dated.select(
        *rows.columns,
        F.col("__window.start").alias("collection_start_date"),
        F.col("__window.end").alias("collection_end_date"),
        (F.col(text).isNotNull() & F.col("__window").isNull()).alias("bad_collection_date"),
    )


def clean_sample_runs(raw: DataFrame) -> DataFrame:
    """Sample run records (model column names, all text) to typed sample rows with place names.

    ``malformed`` marks records that lack a required value or hold an unreadable number, date-time
    or place; they are not to be loaded. ``bad_collection_date`` marks records that load without
    collection dates.
    """
    order = [c for c in ("input_order",) if c in raw.columns]
    blanked = raw.select(*[blank_to_null(F.col(c)).alias(c) for c in raw.columns if c not in order], *order)
    rows = split_geo(exclude_accessions(blanked), "geo_loc_name", exact=True)
    rows = with_collection_window(rows, "collection_date")
    numbers = {
        "avg_spot_length": F.col("avg_spot_length").try_cast("double"),
        "bases": F.when(F.col("bases").rlike(r"^\s*[+-]?[0-9]+\s*\z"), F.col("bases").try_cast("bigint")),
        "release_date": F.col("release_date").try_cast("timestamp"),
        "creation_date": F.col("creation_date").try_cast("timestamp"),
        "retraction_detected_date": F.concat("retraction_detected_date", F.lit("Z")).try_cast("timestamp"),
    }
    malformed = F.col("bad_geo") | ~all_present(*_REQUIRED)
    for name, value in numbers.items():
        malformed = malformed | (F.col(name).isNotNull() & value.isNull())
    return rows.select(
        "accession",
        *_TEXT_FIELDS,
        *[value.alias(name) for name, value in numbers.items()],
        bool_from_text(F.col("is_retracted")).alias("is_retracted"),
        "collection_start_date",
        "collection_end_date",
        *GEO_COLUMNS,
        "bad_collection_date",
        malformed.alias("malformed"),
        *order,
    )


def clean_bulk_samples(raw: DataFrame, delimiter: str = "/", organism: str | None = None) -> DataFrame:
    """Bulk sample records (model column names, all text): records without a collection date drop out,
    and none is retracted."""
    blanked = raw.select(*[blank_to_null(F.col(c)).alias(c) for c in raw.columns])
    rows = split_geo(blanked.na.drop(subset=["collection_date"]), "geo_location", delimiter)
    rows = with_collection_window(rows).drop("geo_location", "collection_date")
    typed = {"bases": "bigint", "ww_viral_load": "double", "ww_catchment_population": "bigint"}
    for name, kind in typed.items():
        if name in rows.columns:
            rows = rows.withColumn(name, F.col(name).try_cast(kind))
    if organism is not None:
        rows = rows.withColumn("organism", F.lit(organism))
    return rows.withColumn("is_retracted", F.lit(False))


def geo_dimension_upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The place table with the new place tuples of ``incoming`` added under new ids."""
    names = incoming.select(*GEO_COLUMNS).filter(F.col("country_name").isNotNull()).distinct()
    new = join_null_safe(names, existing.select(*GEO_COLUMNS), GEO_COLUMNS, "left_anti")
    return existing.select("id", *GEO_COLUMNS).unionByName(assign_ids(new, GEO_COLUMNS, highest(existing)))


def attach_geo_ids(rows: DataFrame, geo: DataFrame) -> DataFrame:
    """Replace the place names of sample rows by the id of the place."""
    places = geo.select(F.col("id").alias("geo_location_id"), *GEO_COLUMNS).filter(F.col("country_name").isNotNull())
    return join_null_safe(rows, places, GEO_COLUMNS, "left").drop(*GEO_COLUMNS)


def last_per_accession(rows: DataFrame, order: str) -> DataFrame:
    """The last record of each accession in input order."""
    fields = [c for c in rows.columns if c not in ("accession", order)]
    last = rows.groupBy("accession").agg(F.max_by(F.struct(*fields), order).alias("__last"))
    return last.select("accession", "__last.*")


def sample_upsert(existing: DataFrame, incoming: DataFrame, update_columns: Sequence[str] | None = None,
                  after: Column | None = None) -> DataFrame:
    """The sample table after loading ``incoming`` (unique accessions).

    Known accessions keep their id and take the update columns of the new record, nulls included;
    by default every column the record brings. New accessions are appended under new ids, which follow
    ``after`` (the largest id of ``existing``, unless that is only a part of the table).
    """
    columns = [c for c in existing.columns if c not in ("id", "accession")]
    if update_columns is None:
        update_columns = [c for c in columns if c in incoming.columns]
    given = [c for c in incoming.columns if c in columns]
    renamed = incoming.select(
        "accession", F.lit(True).alias("__new"), *[F.col(c).alias(f"__new_{c}") for c in update_columns]
    )
    merged = existing.join(renamed, "accession", "left")
    updated = merged.select(
        "id",
        "accession",
        *[
            F.when(F.col("__new"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in update_columns else F.col(c)
            for c in columns
        ],
    )
    unseen = incoming.select("accession", *given).join(existing.select("accession"), "accession", "left_anti")
    added = assign_ids(unseen, ["accession"], highest(existing) if after is None else after)
    return updated.unionByName(added, allowMissingColumns=True)


def upsert_stored_samples(spark: SparkSession, path: str, incoming: DataFrame,
                          update_columns: Sequence[str] | None = None) -> list[int]:
    """``sample_upsert`` into a table stored in buckets of the accession; returns the touched buckets.

    Only these are read and replaced; of the others no more than the ids are read, for the largest.
    """
    last = spark.read.parquet(path).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]

    def upsert(stored: DataFrame, rows: DataFrame) -> DataFrame:
        return sample_upsert(stored, rows, update_columns, F.lit(last))

    return buckets.merge(spark, path, incoming, "accession", upsert)


# What a bulk load changes in a known sample. The first columns always, the others when
# the load brings them; further columns are only set for new samples.
BULK_UPDATE_ALWAYS = (
    "organism", "is_retracted", "collection_start_date", "collection_end_date", "host", "geo_location_id",
)
BULK_UPDATE_WHEN_PRESENT = (
    "bio_sample_accession", "retraction_detected_date", "serotype", "avg_spot_length", "bio_project",
    "bio_sample_model", "center_name", "experiment", "instrument", "platform", "isolate", "library_name",
    "library_layout", "library_selection", "library_source", "isolation_source", "release_date",
    "creation_date", "version", "sample_name", "sra_study", "assay_type", "bases",
)


def bulk_update_columns(rows: DataFrame) -> list[str]:
    return [*BULK_UPDATE_ALWAYS, *[c for c in BULK_UPDATE_WHEN_PRESENT if c in rows.columns]]


def load_samples(tables: Tables, rows: DataFrame, bulk: bool = False) -> Tables:
    """Load cleaned sample rows: new places first, then the samples. Rows marked malformed are left out.

    Of several records of an accession the last in ``input_order`` counts. Rows without that column,
    as of bulk files, must be unique by accession; the load fails otherwise.
    """
    if "malformed" in rows.columns:
        rows = rows.filter(~F.col("malformed"))
    rows = rows.drop("malformed", "bad_geo", "bad_collection_date")
    if "input_order" in rows.columns:
        # written, as it is read for the places, the known and the new samples
        rows = cut(last_per_accession(rows, "input_order"), "last-records")
    else:
        repeated = rows.groupBy("accession").count().filter("count > 1").select("accession").take(5)
        if repeated:
            raise ValueError(f"repeated accessions, such as {[r['accession'] for r in repeated]}")
    # written before samples refer to its ids
    geo = cut(geo_dimension_upsert(tables.geo_locations, rows), "places")
    placed = attach_geo_ids(rows, geo)
    samples = sample_upsert(tables.samples, placed, bulk_update_columns(placed) if bulk else None)
    return tables.replace(geo_locations=geo, samples=samples)


def sample_id_lookup(samples: DataFrame, accessions: DataFrame) -> DataFrame:
    """``accession, sample_id`` for the accessions that are known."""
    ids = samples.select("accession", F.col("id").alias("sample_id"))
    return ids.join(accessions.select("accession"), "accession", "left_semi")


def drop_unknown_accessions(records: DataFrame, samples: DataFrame) -> DataFrame:
    """Only the records of known samples."""
    return records.join(samples.select("accession"), "accession", "left_semi")


def drop_null_ref(mutations: DataFrame, observation: Observation | None = None) -> DataFrame:
    """Drop mutations without a reference nucleotide; ``observation`` receives their number as
    ``null_ref`` while the result is computed."""
    if observation is not None:
        mutations = mutations.observe(observation, F.count_if(F.col("ref_nt").isNull()).alias("null_ref"))
    return mutations.filter(F.col("ref_nt").isNotNull())
