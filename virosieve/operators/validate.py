"""Batch validation: each check returns the violating rows, so an empty result means valid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from virosieve.plans.closure import transitive_closure
from virosieve.tables import Tables


def violations(df: DataFrame, rule: Column) -> DataFrame:
    """Rows for which a rule is false. As in SQL, a rule that is unknown does not fail."""
    return df.filter(~rule)


def check_bin_overlap(ranges: DataFrame) -> DataFrame:
    """Ranges (``change_id, lo, hi, hi_closed``) that overlap a different range of their change.

    Sorted by lower bound, a range overlaps an earlier one when it starts before the furthest end so
    far, and a later one when the next starts before its own end; no pairs are formed. Ranges are made
    distinct first: with bounds in thousandths a change has a limited number of them, however many
    samples it has.
    """
    distinct = ranges.select("change_id", "lo", "hi", "hi_closed").distinct()
    order = Window.partitionBy("change_id").orderBy("lo", "hi", "hi_closed")
    furthest = F.max(F.struct("hi", "hi_closed")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = distinct.select("*", furthest.alias("__prev"), F.lead("lo").over(order).alias("__next"))
    earlier = (F.col("__prev.hi") > F.col("lo")) | ((F.col("__prev.hi") == F.col("lo")) & F.col("__prev.hi_closed"))
    later = (F.col("__next") < F.col("hi")) | ((F.col("__next") == F.col("hi")) & F.col("hi_closed"))
    found = F.coalesce(earlier, F.lit(False)) | F.coalesce(later, F.lit(False))
    return marked.filter(found).drop("__prev", "__next")


def check_sample_once_per_change(edges: DataFrame) -> DataFrame:
    """(change, sample) pairs filed under more than one frequency bin."""
    return (
        edges.groupBy("change_id", "sample_id")
        .agg(F.min("freq_bin").alias("first_bin"), F.max("freq_bin").alias("last_bin"))
        .filter(F.col("first_bin") != F.col("last_bin"))
    )


def check_lineage_cycle(edges: DataFrame) -> DataFrame:
    """Hierarchy edges whose child already reaches their parent."""
    backwards = transitive_closure(edges).select(
        F.col("parent_id").alias("child_id"), F.col("child_id").alias("parent_id")
    )
    return edges.select("parent_id", "child_id").distinct().join(backwards, ["parent_id", "child_id"], "left_semi")


def check_cross_system_edge(edges: DataFrame, lineages: DataFrame) -> DataFrame:
    """Hierarchy edges between lineages of different systems."""
    systems = lineages.select("id", "lineage_system_id")
    parents = systems.select(F.col("id").alias("parent_id"), F.col("lineage_system_id").alias("parent_system"))
    children = systems.select(F.col("id").alias("child_id"), F.col("lineage_system_id").alias("child_system"))
    rows = edges.join(parents, "parent_id").join(children, "child_id")
    return rows.filter(F.col("parent_system") != F.col("child_system")).select(
        "parent_id", "child_id", "parent_system", "child_system"
    )


def check_sample_rows(samples: DataFrame) -> DataFrame:
    """Samples with one collection date only, with dates in the wrong order, or whose retraction flag
    and date disagree. ``rule`` names each broken rule of a sample."""
    start, end = F.col("collection_start_date"), F.col("collection_end_date")
    retracted_on = F.col("retraction_detected_date")
    rules = {
        "both collection dates or none": start.isNull() == end.isNull(),
        "collection start not after end": start <= end,
        "retraction flag and date agree": F.col("is_retracted") == retracted_on.isNotNull(),
    }
    broken = F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]))
    return samples.select("id", F.explode(broken).alias("rule"))


def check_abundance_xor_consensus(samples_lineages: DataFrame) -> DataFrame:
    """Assignments that have an abundance and are consensus calls, or neither."""
    return violations(samples_lineages, F.col("abundance").isNull() == F.col("is_consensus_call"))


def check_non_empty(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with an empty text in any of the columns."""
    rule = F.lit(True)
    for name in columns:
        rule = rule & (F.col(name) != "")
    return violations(df, rule)


# The texts that must not be empty, per table.
NON_EMPTY = {
    "alleles": ("ref_nt", "alt_nt"),
    "amino_acids": ("gff_feature", "ref_aa", "alt_aa", "ref_codon", "alt_codon"),
    "phenotype_metrics": ("phenotype_metric_name", "phenotype_metric_assay_type"),
}


def check_no_self_parent(edges: DataFrame) -> DataFrame:
    return violations(edges, F.col("parent_id") != F.col("child_id"))


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values held by more than one row, with their number. Null equals null."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


# Natural keys per table.
NATURAL_KEYS = {
    "samples": ("accession",),
    "alleles": ("region", "position_nt", "alt_nt"),
    "amino_acids": ("gff_feature", "position_aa", "alt_aa", "alt_codon"),
    "geo_locations": ("country_name", "admin1_name", "admin2_name", "admin3_name"),
    "samples_lineages": ("sample_id", "lineage_id", "is_consensus_call"),
    "phenotype_metrics": ("phenotype_metric_name",),
    "phenotype_metric_values": ("phenotype_metric_id", "amino_acid_id"),
    "lineage_systems": ("lineage_system_name",),
    "lineages": ("lineage_system_id", "lineage_name"),
    "lineages_immediate_children": ("parent_id", "child_id"),
    "papers": ("authors", "publication_year", "title"),
    "effects": ("detail",),
    "annotations_amino_acids": ("amino_acid_id", "annotation_id"),
    "annotations_papers": ("paper_id", "annotation_id"),
    "cns_nt": ("change_id", "sample_id"),
    "cns_aa": ("change_id", "sample_id"),
    "ih_nt": ("change_id", "sample_id", "freq_bin"),
    "ih_aa": ("change_id", "sample_id", "freq_bin"),
}


def check_all_unique(tables: Tables) -> DataFrame:
    """Per table: how many values of its natural key are held by several rows."""
    parts = []
    for name, keys in NATURAL_KEYS.items():
        if name in tables:
            doubled = check_unique(tables[name], keys)
            parts.append(doubled.agg(F.count("*").alias("n_violations")).select(F.lit(name).alias("table_name"), "n_violations"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def check_references(child: DataFrame, column: str, parent: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``child`` that refer to no row of ``parent``; a null reference is allowed."""
    known = parent.select(F.col(key).alias(column))
    return child.filter(F.col(column).isNotNull()).join(known, column, "left_anti")


# Foreign keys: (table, column, referenced table, referenced column).
REFERENCES = (
    ("samples", "geo_location_id", "geo_locations", "id"),
    ("cns_nt", "change_id", "alleles", "id"),
    ("cns_nt", "sample_id", "samples", "id"),
    ("cns_aa", "change_id", "amino_acids", "id"),
    ("cns_aa", "sample_id", "samples", "id"),
    ("ih_nt", "change_id", "alleles", "id"),
    ("ih_nt", "sample_id", "samples", "id"),
    ("ih_aa", "change_id", "amino_acids", "id"),
    ("ih_aa", "sample_id", "samples", "id"),
    ("lineages", "lineage_system_id", "lineage_systems", "id"),
    ("lineages_immediate_children", "parent_id", "lineages", "id"),
    ("lineages_immediate_children", "child_id", "lineages", "id"),
    ("samples_lineages", "sample_id", "samples", "id"),
    ("samples_lineages", "lineage_id", "lineages", "id"),
    ("phenotype_metric_values", "phenotype_metric_id", "phenotype_metrics", "id"),
    ("phenotype_metric_values", "amino_acid_id", "amino_acids", "id"),
    ("annotations", "effect_detail", "effects", "detail"),
    ("annotations_amino_acids", "annotation_id", "annotations", "annotation_id"),
    ("annotations_amino_acids", "amino_acid_id", "amino_acids", "id"),
    ("annotations_papers", "annotation_id", "annotations", "annotation_id"),
    ("annotations_papers", "paper_id", "papers", "id"),
)


def check_all_references(tables: Tables) -> DataFrame:
    """Per foreign key: how many rows refer to nothing."""
    parts = []
    for table, column, parent, key in REFERENCES:
        if table in tables and parent in tables:
            dangling = check_references(tables[table], column, tables[parent], key)
            counted = dangling.agg(F.count("*").alias("n_violations"))
            parts.append(counted.select(F.lit(f"{table}.{column}").alias("reference"), "n_violations"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
