"""Readers of phenotype score tables: wide files, one column per metric, to long rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from virosieve.functions.values import blank_to_null, whole_from_decimal_text
from virosieve.sources.delimited import HeaderError, scan


@dataclass(frozen=True)
class ScoreLayout:
    """Headers of one kind of score file. ``metrics`` maps metric name -> header; of these at least
    one must be present, or all of them when ``all_metrics``."""

    assay_type: str
    sep: str
    position: str
    ref: str
    alt: str
    metrics: dict[str, str] = field(default_factory=dict)
    feature: str | None = None
    feature_column: str | None = None
    all_metrics: bool = False
    decimal_position: bool = False


# Features of the two proteins with scores, and the metrics of each layout.
HA = "XAJ25415.1"
PB2 = "XAJ25426.1"
_HA_METRICS = {
    "species_sera_escape": "species sera escape",
    "entry_in_293t_cells": "entry in 293T cells",
    "stability": "stability",
    "sa26_usage_increase": "SA26 usage increase",
    "mature_h5_site": "mature_H5_site",
    "ferret_sera_escape": "ferret sera escape",
    "mouse_sera_escape": "mouse sera escape",
}
_HA_NEW_METRICS = {
    "sa26_usage_increase_new": "SA26 usage increase",
    "entry_in_sa26_and_sa23_293t_cells": "entry in SA26 and SA23 293T cells",
}
_HA_NEU_METRICS = {
    "entry_in_neuac": "entry in 293 cells",
    "entry_in_neugc": "entry in CMAH cells",
    "neugc_usage_increase": "NeuGc usage increase",
}
_HA_SITE = {"position": "sequential_site", "ref": "wildtype", "alt": "mutant", "feature": HA}

LAYOUTS = {
    "ha_tsv": ScoreLayout("DMS", "\t", metrics=_HA_METRICS, **_HA_SITE),
    "ha_csv": ScoreLayout("DMS", ",", metrics=_HA_METRICS, **_HA_SITE),
    "ha_csv_new": ScoreLayout("DMS", ",", metrics=_HA_NEW_METRICS, **_HA_SITE),
    "ha_csv_neuac_neugc": ScoreLayout("DMS", ",", metrics=_HA_NEU_METRICS, **_HA_SITE),
    "pb2_csv": ScoreLayout(
        "DMS", ",", "site", "wildtype", "mutation", {"mutdiffsel": "mutdiffsel"}, feature=PB2
    ),
    "sc2_tsv": ScoreLayout(
        "DMS", "\t", "position", "wildtype", "mutant", {"delta_bind": "delta_bind", "delta_expr": "delta_expr"},
        feature_column="GFF_FEATURE",
    ),
    "evescape_csv": ScoreLayout(
        "EVEscape", ",", "i", "wildtype", "mutant",
        {"evescape": "evescape", "evescape_sigmoid": "evescape_sigmoid"},
        feature=HA, all_metrics=True, decimal_position=True,
    ),
    "sc2_evescape_csv": ScoreLayout(
        "EVEscape", ",", "i", "wt", "mut", {"evescape": "evescape"},
        feature_column="GFF_FEATURE", all_metrics=True, decimal_position=True,
    ),
}


def _whole(value: Column) -> Column:
    return F.when(value.rlike(r"^\s*[+-]?[0-9]+\s*\z"), value.try_cast("bigint"))


CHANGE = ["gff_feature", "position_aa", "ref_aa", "alt_aa"]
NO_CHANGE = "no readable change"
NO_NUMBER = "not a number"


def score_outcomes(spark: SparkSession, paths, layout: str | ScoreLayout) -> DataFrame:
    """What becomes of every record and cell, from one scan: the columns of ``read_scores``, and for rejects
    a ``problem`` with the text in ``cell``.

    A record without a readable change is one row, whose ``cell`` holds its change fields; a cell that
    is no number is one row. Blank cells are missing, not rejected. Files may hold different metrics;
    each gives those it has, and one without any is an error.
    """
    layout = LAYOUTS[layout] if isinstance(layout, str) else layout
    site = [layout.position, layout.ref, layout.alt, *([layout.feature_column] if layout.feature_column else [])]
    metrics = list(layout.metrics.values())
    files = scan(spark, paths, layout.sep)
    files.check([*site, *(metrics if layout.all_metrics else [])])
    for header in files.headers:
        if not set(metrics) & set(header.names):
            raise HeaderError(f"{header.example}: no metric column among {sorted(metrics)}")
    raw = files.rows(site, metrics)

    position = blank_to_null(F.col(layout.position))
    feature = F.lit(layout.feature) if layout.feature_column is None else blank_to_null(F.col(layout.feature_column))
    cells = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(f"`{header}`").alias("cell")) for name, header in layout.metrics.items()])
    records = raw.select(
        feature.alias("gff_feature"),
        (whole_from_decimal_text(position) if layout.decimal_position else _whole(position)).alias("position_aa"),
        blank_to_null(F.col(layout.ref)).alias("ref_aa"),
        blank_to_null(F.col(layout.alt)).alias("alt_aa"),
        "input_order",
        F.filter(cells, lambda c: c["cell"].rlike(r"\S")).alias("cells"),
        F.concat_ws(layout.sep, *[F.coalesce(F.col(f"`{name}`"), F.lit("")) for name in site]).alias("site"),
    )
    readable = F.lit(True)
    for name in CHANGE:
        readable = readable & F.col(name).isNotNull()
    unreadable = F.array(F.struct(F.lit(None).cast("string").alias("metric"), F.col("site").alias("cell")))
    rows = records.select(*CHANGE, "input_order", readable.alias("readable"), F.explode(F.when(readable, F.col("cells")).otherwise(unreadable)).alias("c"))
    value = F.when(F.col("readable"), F.col("c.cell").try_cast("double"))
    return rows.select(
        *CHANGE,
        "input_order",
        F.col("c.metric").alias("phenotype_metric_name"),
        value.alias("value"),
        F.lit(layout.assay_type).alias("phenotype_metric_assay_type"),
        F.when(~F.col("readable"), NO_CHANGE).when(value.isNull(), NO_NUMBER).alias("problem"),
        F.when(value.isNull(), F.col("c.cell")).alias("cell"),
    )


def _good(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(F.col("problem").isNull()).drop("problem", "cell")


def _rejects(outcomes: DataFrame) -> DataFrame:
    """Rejected records and cells with the file they lie in and their place there."""
    return outcomes.filter(F.col("problem").isNotNull()).select("problem", "phenotype_metric_name", "cell", "input_order.*")


def read_scores(spark: SparkSession, paths, layout: str | ScoreLayout) -> DataFrame:
    """Long scores: change columns, ``phenotype_metric_name``, ``phenotype_metric_assay_type``,
    ``value``, ``input_order``.

    Records without a readable change and cells without a readable number are left out;
    ``read_score_rejects`` tells them, and ``stage_scores`` does both in one pass.
    """
    return _good(score_outcomes(spark, paths, layout))


def read_score_rejects(spark: SparkSession, paths, layout: str | ScoreLayout) -> DataFrame:
    """``problem, phenotype_metric_name, cell, file, block, record`` of all that ``read_scores`` leaves out."""
    return _rejects(score_outcomes(spark, paths, layout))


@dataclass(frozen=True)
class StagedScores:
    scores: DataFrame
    rejects: DataFrame
    n_scores: int
    n_records_rejected: int
    n_cells_rejected: int


def stage_scores(spark: SparkSession, paths, layout: str | ScoreLayout, path: str) -> StagedScores:
    """Write good and bad records apart below ``path``, in one pass over the files that also counts them."""
    seen = Observation()
    outcomes = score_outcomes(spark, paths, layout).withColumn("rejected", F.col("problem").isNotNull())
    counted = outcomes.observe(
        seen,
        F.count_if(F.col("problem").isNull()).alias("n_scores"),
        F.count_if(F.col("problem") == NO_CHANGE).alias("n_records_rejected"),
        F.count_if(F.col("problem") == NO_NUMBER).alias("n_cells_rejected"),
    )
    counted.write.partitionBy("rejected").parquet(path)
    stored = spark.read.schema(outcomes.schema).parquet(path)
    good, bad = stored.filter("not rejected").drop("rejected"), stored.filter("rejected").drop("rejected")
    return StagedScores(_good(good), _rejects(bad), **seen.get)
