"""Readers of sample files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from virosieve.operators.ingest_samples import clean_bulk_samples, clean_sample_runs
from virosieve.sources.delimited import read_delimited, renamed

# Model column -> header of the sample run table.
RUN_COLUMNS = {
    "accession": "Run",
    "assay_type": "Assay Type",
    "avg_spot_length": "AvgSpotLen",
    "bases": "Bases",
    "bio_project": "BioProject",
    "bio_sample": "BioSample",
    "bio_sample_model": "BioSampleModel",
    "bio_sample_accession": "BioSample Accession",
    "center_name": "Center Name",
    "collection_date": "Collection_Date",
    "experiment": "Experiment",
    "geo_loc_name": "geo_loc_name",
    "host": "Host",
    "instrument": "Instrument",
    "isolate": "isolate",
    "library_name": "Library Name",
    "library_layout": "LibraryLayout",
    "library_selection": "LibrarySelection",
    "library_source": "LibrarySource",
    "organism": "Organism",
    "platform": "Platform",
    "release_date": "ReleaseDate",
    "creation_date": "create_date",
    "version": "version",
    "sample_name": "Sample Name",
    "sra_study": "SRA Study",
    "serotype": "serotype",
    "isolation_source": "isolation_source",
    "is_retracted": "is_retracted",
    "retraction_detected_date": "retraction_detection_date_utc",
}

# Model column -> header of the small bulk table.
SD_COLUMNS = {
    "accession": "ID",
    "host": "host",
    "collection_date": "collection_date",
    "geo_location": "location",
}

# Model column -> header of the wide bulk tables.
BULK_COLUMNS = {
    "accession": "Accession",
    "bio_project": "Bioprojects",
    "bio_sample": "Biosample",
    "host": "Host_OrganismName",
    "isolate": "Isolate_Name",
    "organism": "Virus_OrganismName",
    "isolation_source": "Isolate_Source",
    "collection_date": "Collection_Date",
    "geo_location": "Geographic_Location",
    "census_region": "census_region",
    "bases": "Length",
    "ww_viral_load": "viral_load",
    "ww_catchment_population": "population",
    "ww_site_id": "site_id",
    "ww_collected_by": "collected_by",
}

# Organism of bulk tables that do not have one of their own.
NO_ORGANISM = "NA"


def read_sample_runs(spark: SparkSession, paths, sep: str = ",") -> DataFrame:
    """Sample run table, comma or tab separated; further columns are ignored. ``input_order`` stays, since the
    last record of an accession counts when it is loaded."""
    raw = read_delimited(spark, paths, sep, RUN_COLUMNS.values())
    return clean_sample_runs(renamed(raw, RUN_COLUMNS))


def _bulk(spark, paths, columns, delimiter, organism) -> DataFrame:
    raw = renamed(read_delimited(spark, paths, "\t", columns.values()), columns)
    return clean_bulk_samples(raw.drop("input_order"), delimiter, organism)


def read_bulk_sd(spark: SparkSession, paths) -> DataFrame:
    return _bulk(spark, paths, SD_COLUMNS, "/", NO_ORGANISM)


def read_bulk_wastewater(spark: SparkSession, paths) -> DataFrame:
    return _bulk(spark, paths, BULK_COLUMNS, "/", None)


def read_bulk_ncbi(spark: SparkSession, paths) -> DataFrame:
    return _bulk(spark, paths, BULK_COLUMNS, ":", NO_ORGANISM)
