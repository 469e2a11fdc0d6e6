"""Building blocks shared by the query operators: the nucleotide/amino-acid axis, sample subsets
under a user filter, and binned samples."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.logger import PySparkLogger
from pyspark.sql import Column, DataFrame, functions as F

from virosieve.functions.changes import freq_overlap
from virosieve.functions.dates import DEFAULT_MAX_SPAN_DAYS, DateBin, max_span_filter, mid_collection_date
from virosieve.functions.values import null_count
from virosieve.plans.joins import own_shuffle
from virosieve.tables import Tables

Filter = str | Column | None

WASTEWATER_COLUMNS = ("ww_site_id", "ww_catchment_population", "ww_collected_by", "ww_viral_load")


@dataclass(frozen=True)
class Axis:
    """Which catalog, carriers and columns describe a change."""

    name: str
    catalog: str
    consensus: str
    intrahost: str
    feature: str
    ref: str
    position: str
    alt: str
    codons: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return [self.feature, self.ref, self.position, self.alt]

    def named(self, tables: Tables) -> DataFrame:
        """The catalog with its id as ``change_id``."""
        return tables[self.catalog].withColumnRenamed("id", "change_id")


NT = Axis("nt", "alleles", "cns_nt", "ih_nt", "region", "ref_nt", "position_nt", "alt_nt")
AA = Axis(
    "aa", "amino_acids", "cns_aa", "ih_aa", "gff_feature", "ref_aa", "position_aa", "alt_aa",
    codons=("ref_codon", "alt_codon"),
)
AXES = {"nt": NT, "aa": AA}


def change_axis(axis: str | Axis) -> Axis:
    return axis if isinstance(axis, Axis) else AXES[axis]


def as_filter(where: Filter) -> Column | None:
    """A filter given as SQL text or Column. It is always applied as a unit of its own, so an OR in
    it cannot reach past the conditions of the operator."""
    if where is None or isinstance(where, Column):
        return where
    return F.expr(where) if where.strip() else None


def resolves(df: DataFrame, condition: Column) -> bool:
    """Whether a filter only mentions columns of ``df``. Asking is no error, so nothing is logged."""
    logs = [PySparkLogger.getLogger(name) for name in ("SQLQueryContextLogger", "DataFrameQueryContextLogger")]
    before = [log.disabled for log in logs]
    for log in logs:
        log.disabled = True
    try:
        df.filter(condition)
    except AnalysisException:
        return False
    finally:
        for log, disabled in zip(logs, before):
            log.disabled = disabled
    return True


def filtered(df: DataFrame, where: Filter) -> DataFrame:
    condition = as_filter(where)
    return df if condition is None else df.filter(condition)


def ww_flag() -> Column:
    """A wastewater sample has at least one of the four wastewater fields."""
    return null_count(*WASTEWATER_COLUMNS) < len(WASTEWATER_COLUMNS)


def select_samples(
    tables: Tables,
    where: Filter = None,
    *,
    lineages: str = "none",
    geo: bool = True,
    also: Sequence[Column] = (),
) -> DataFrame:
    """The samples that pass ``where``, one row per sample, with the columns of ``samples``.

    ``lineages`` says how lineage columns come into scope: ``none``, ``left`` (samples without a
    lineage stay) or ``inner`` (they drop out). Only the tables a filter really mentions are joined,
    and a lineage filter is a semi-join, so a sample with many assignments never fans out.
    ``also`` are conditions of the operator itself, on sample columns.
    """
    condition = as_filter(where)
    samples = tables.samples
    for extra in also:
        samples = samples.filter(extra)
    narrowed = tables.replace(samples=samples)

    by_lineage = False
    if condition is None:
        out = samples
    elif resolves(samples, condition):
        out = samples.filter(condition)
    elif geo and resolves(narrowed.samples_geo, condition):
        out = narrowed.samples_geo.filter(condition).select(*samples.columns)
    elif lineages == "none":
        # not in scope: let Spark name the offending column
        return (narrowed.samples_geo if geo else samples).filter(condition)
    else:
        by_lineage = True
        scope = narrowed.samples_geo if geo else samples
        calls = tables.samples_lineages.join(tables.named_lineages, "lineage_id")
        joined = scope.join(
            calls.withColumnRenamed("sample_id", "id"), "id", "left" if lineages == "left" else "inner"
        )
        out = samples.join(joined.filter(condition).select("id").distinct(), "id", "left_semi")
    if lineages == "inner" and not by_lineage:
        # distinct first: it combines the many assignments of a sample before they are shuffled
        assigned = tables.samples_lineages.select(F.col("sample_id").alias("id")).distinct()
        out = out.join(assigned, "id", "left_semi")
        by_lineage = True
    return own_shuffle(out, "id") if by_lineage else out


def lineage_samples(tables: Tables, lineage: str, system: str, where: Filter = None,
                    also: Sequence[Column] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Distinct samples of one lineage, as ``sample_id`` and the sample columns in ``keep``. The
    filter sees samples and lineage columns but no place."""
    named = tables.named_lineages.filter(
        (F.col("lineage_name") == lineage) & (F.col("lineage_system_name") == system)
    )
    calls = tables.samples_lineages.join(named, "lineage_id").withColumnRenamed("sample_id", "id")
    samples = tables.samples
    for extra in also:
        samples = samples.filter(extra)
    condition = as_filter(where)
    if condition is not None and not resolves(samples, condition):
        calls = samples.join(calls, "id").filter(condition)
    elif condition is not None:
        samples = samples.filter(condition)
    members = own_shuffle(samples.join(calls.select("id").distinct(), "id", "left_semi"), "id")
    return members.select(F.col("id").alias("sample_id"), *keep)


def binned_samples(
    tables: Tables,
    date_bin: DateBin,
    where: Filter = None,
    *,
    max_span_days: int = DEFAULT_MAX_SPAN_DAYS,
    lineages: str = "none",
    geo: bool = True,
) -> DataFrame:
    """``sample_id`` with the bin of its mid collection date, for samples with a narrow enough
    collection window."""
    chosen = select_samples(tables, where, lineages=lineages, geo=geo, also=[max_span_filter(max_span_days)])
    return chosen.select(F.col("id").alias("sample_id"), *date_bin.columns(mid_collection_date()))


def change_keys(tables: Tables, axis: Axis) -> DataFrame:
    """``change_id, key_id`` where changes that read the same (several codons of one amino-acid
    change) share the smallest id as key. Counting works on this number; the names are joined to the
    counted result. Catalogs that loads keep up hold it as ``canonical_id``; it is worked out for others."""
    if "canonical_id" in tables[axis.catalog].columns:
        return axis.named(tables).select("change_id", F.col("canonical_id").alias("key_id"))
    catalog = axis.named(tables).select("change_id", *axis.columns)
    keys = catalog.groupBy(*axis.columns).agg(F.min("change_id").alias("key_id"))
    return catalog.join(keys, axis.columns).select("change_id", "key_id")


def with_change_names(counted: DataFrame, tables: Tables, axis: Axis, key: str = "key_id") -> DataFrame:
    names = axis.named(tables).select(F.col("change_id").alias(key), *axis.columns)
    return counted.join(names, key).drop(key)


def intrahost_window(edges: DataFrame, low: float | None, high: float | None) -> DataFrame:
    condition = freq_overlap(low, high)
    return edges if condition is None else edges.filter(condition)
