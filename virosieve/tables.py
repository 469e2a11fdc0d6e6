"""The named DataFrames that query operators work on.

Carrier sets are *edge tables*, one row per (change, sample):

* ``cns_nt`` / ``cns_aa``  consensus:   ``change_id, sample_id``
* ``ih_nt``  / ``ih_aa``   intra-host:  ``change_id, sample_id, freq_bin``

``cns_nt_by_sample``, ``cns_aa_by_sample`` and the same of ``ih_nt`` and ``ih_aa``, if given, hold the
edges clustered by sample; operators that start from samples read them.

Derived tables that loads keep up (``operators.upkeep``) are read where they are given:
``metric_sum_cache`` and ``variant_sum_cache`` (score sums per sample and metric), ``first_seen`` (first
dates per lineage and change), ``lineage_closure`` (all pairs of the hierarchy).

Set algebra on carrier sets is then ordinary relational work (semi-joins, distinct, counts) that
Spark can partition on either key; no row ever holds the carriers of a whole change.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cached_property, partial

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = (
    "samples",
    "geo_locations",
    "alleles",
    "amino_acids",
    "cns_nt",
    "cns_aa",
    "ih_nt",
    "ih_aa",
    "cns_nt_by_sample",
    "cns_aa_by_sample",
    "ih_nt_by_sample",
    "ih_aa_by_sample",
    "lineage_systems",
    "lineages",
    "lineages_immediate_children",
    "lineage_closure",
    "samples_lineages",
    "phenotype_metrics",
    "phenotype_metric_values",
    "effects",
    "papers",
    "annotations",
    "annotations_amino_acids",
    "annotations_papers",
    "metric_sum_cache",
    "variant_sum_cache",
    "first_seen",
)

GEO_COLUMNS = ("country_name", "admin1_name", "admin2_name", "admin3_name")


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


class Tables:
    """Attribute access to the named tables, with the two derived frames most filters need.

    A table may be given as a function, which is called when the table is first used.
    """

    def __init__(self, frames: Mapping[str, DataFrame | Callable[[], DataFrame]]):
        unknown = set(frames) - set(TABLE_NAMES)
        if unknown:
            raise ValueError(f"unknown tables: {sorted(unknown)}")
        self._frames = dict(frames)

    @classmethod
    def load(cls, spark: SparkSession, root: str, names=None, fmt: str = "parquet") -> "Tables":
        """Tables written below ``root``, one directory per name: the given ones, or all that exist."""
        if names is None:
            names = [name for name in TABLE_NAMES if path_exists(spark, f"{root}/{name}")]

        def stored(name: str) -> DataFrame:
            # tables in buckets have two columns that tell their place
            return spark.read.format(fmt).load(f"{root}/{name}").drop("of", "bucket")

        return cls({name: partial(stored, name) for name in names})

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self[name]
        except KeyError:
            raise AttributeError(name) from None

    def __getitem__(self, name: str) -> DataFrame:
        frames = self.__dict__["_frames"]
        if not isinstance(frames[name], DataFrame):
            frames[name] = frames[name]()
        return frames[name]

    def __contains__(self, name: str) -> bool:
        return name in self._frames

    def replace(self, **frames: DataFrame) -> "Tables":
        """A copy with some tables exchanged, e.g. after an ingest step."""
        return Tables({**self._frames, **frames})

    def edges_of_samples(self, name: str) -> DataFrame:
        """Edges for an operator that starts from samples: the layout clustered by sample, where there is one."""
        clustered = f"{name}_by_sample"
        return self[clustered].select(*self[name].columns) if clustered in self else self[name]

    @cached_property
    def samples_geo(self) -> DataFrame:
        """samples left-joined to their place; the place columns keep their own names."""
        geo = self.geo_locations.select(self.geo_locations["id"].alias("geo_location_id"), *GEO_COLUMNS)
        return self.samples.join(geo, "geo_location_id", "left")

    @cached_property
    def named_lineages(self) -> DataFrame:
        """lineages with the name of their system."""
        systems = self.lineage_systems.withColumnRenamed("id", "lineage_system_id")
        return (
            self.lineages.withColumnRenamed("id", "lineage_id")
            .join(systems, "lineage_system_id")
            .select("lineage_id", "lineage_name", "lineage_system_id", "lineage_system_name")
        )
