"""Literature annotations: which effects the changes of a time or a subset are known for."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from virosieve.functions.dates import DEFAULT_MAX_SPAN_DAYS, MONTH, DateBin
from virosieve.operators.common import AA, Filter, binned_samples, select_samples
from virosieve.plans.joins import own_shuffle
from virosieve.tables import Tables


def annotation_effects(tables: Tables) -> DataFrame:
    return tables.effects.select("detail").distinct()


def annotation_id_sets(tables: Tables, effect: str) -> DataFrame:
    """The change-id set of every annotation of an effect, one row per member."""
    wanted = tables.annotations.filter(F.col("effect_detail") == effect).select("annotation_id")
    members = tables.annotations_amino_acids.join(wanted, "annotation_id", "left_semi")
    return members.select("annotation_id", "amino_acid_id").distinct()


def _annotated(tables: Tables) -> DataFrame:
    """(change, effect) pairs from annotations that cite at least one paper."""
    cited = tables.annotations.join(tables.annotations_papers.select("annotation_id"), "annotation_id", "left_semi")
    return tables.annotations_amino_acids.join(cited, "annotation_id").select(
        F.col("amino_acid_id").alias("change_id"), "effect_detail"
    )


def _proportion(tables, edges, effect, date_bin, where, max_span_days) -> DataFrame:
    binned = binned_samples(tables, date_bin, where, max_span_days=max_span_days, lineages="inner")
    annotated = (
        _annotated(tables)
        .groupBy("change_id")
        .agg(F.bool_or(F.col("effect_detail") == effect).alias("has_effect"))
    )
    annotated = own_shuffle(annotated, "change_id")
    present = (
        edges.select("change_id", "sample_id")
        .join(annotated, "change_id")
        .join(binned, "sample_id")
        .groupBy(*date_bin.names, "change_id")
        .agg(F.bool_or("has_effect").alias("has_effect"))
    )
    counted = present.groupBy(*date_bin.names).agg(
        F.count_if("has_effect").alias("n"), F.count("*").alias("n_total")
    )
    return date_bin.labelled(counted.withColumn("proportion", F.col("n") / F.col("n_total"))).orderBy(*date_bin.order)


def annotation_proportion_mutations_by_date(tables: Tables, effect: str, date_bin: DateBin = MONTH,
                                            where: Filter = None,
                                            max_span_days: int = DEFAULT_MAX_SPAN_DAYS) -> DataFrame:
    """Per bin: annotated consensus changes present, those known for the effect, and their share."""
    return _proportion(tables, tables.cns_aa, effect, date_bin, where, max_span_days)


def annotation_proportion_variants_by_date(tables: Tables, effect: str, date_bin: DateBin = MONTH,
                                           where: Filter = None,
                                           max_span_days: int = DEFAULT_MAX_SPAN_DAYS) -> DataFrame:
    """The same for intra-host changes, whatever their frequency."""
    return _proportion(tables, tables.ih_aa, effect, date_bin, where, max_span_days)


def _positions(tables, edges, effect, where) -> DataFrame:
    chosen = select_samples(tables, where, lineages="inner").select(F.col("id").alias("sample_id"))
    annotated = _annotated(tables).filter(F.col("effect_detail") == effect).select("change_id")
    per_change = (
        edges.join(annotated, "change_id", "left_semi")
        .join(chosen, "sample_id", "left_semi")
        .groupBy("change_id")
        .agg(F.countDistinct("sample_id").alias("n"))
    )
    names = AA.named(tables).select("change_id", *AA.columns)
    return per_change.join(names, "change_id").groupBy(*AA.columns).agg(F.sum("n").alias("count"))


def annotated_positions_mutations(tables: Tables, effect: str, where: Filter = None) -> DataFrame:
    """Consensus carriers per position known for an effect; a sample counts once per change id."""
    return _positions(tables, tables.cns_aa, effect, where)


def annotated_positions_variants(tables: Tables, effect: str, where: Filter = None) -> DataFrame:
    """Intra-host carriers per position known for an effect."""
    return _positions(tables, tables.ih_aa, effect, where)
