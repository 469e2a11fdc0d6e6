"""Ingest of lineage calls, abundances and the lineage hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from virosieve.plans.closure import maintain_closure
from virosieve.plans.durable import cut
from virosieve.plans.ids import assign_ids, highest
from virosieve.tables import Tables

_CALL_KEY = ["sample_id", "lineage_id", "is_consensus_call"]


def lineage_system_upsert(systems: DataFrame, system: str) -> DataFrame:
    """The system table, with this name added when it is new."""
    new = systems.sparkSession.range(1).select(F.lit(system).alias("lineage_system_name"))
    new = new.join(systems.select("lineage_system_name"), "lineage_system_name", "left_anti")
    return systems.unionByName(assign_ids(new, ["lineage_system_name"], highest(systems)))


def lineage_dimension_upsert(tables: Tables, system: str, names: DataFrame) -> Tables:
    """Systems and lineages with the missing ones added. ``names`` holds ``lineage_name``.

    Both are written before rows refer to their ids.
    """
    systems = cut(lineage_system_upsert(tables.lineage_systems, system), "lineage-systems")
    own = systems.filter(F.col("lineage_system_name") == system).select(F.col("id").alias("lineage_system_id"))
    known = tables.lineages.join(own, "lineage_system_id", "left_semi").select("lineage_name")
    new = names.select("lineage_name").distinct().join(known, "lineage_name", "left_anti")
    added = assign_ids(new, ["lineage_name"], highest(tables.lineages)).withColumn("lineage_system_id", own.scalar())
    lineages = cut(tables.lineages.unionByName(added), "lineages")
    return tables.replace(lineage_systems=systems, lineages=lineages)


def _lineage_ids(tables: Tables, system: str) -> DataFrame:
    """``lineage_name, lineage_id`` of one system."""
    return tables.named_lineages.filter(F.col("lineage_system_name") == system).select("lineage_name", "lineage_id")


def first_assigned_calls(calls: DataFrame, samples: DataFrame) -> DataFrame:
    """``sample_id, lineage_name``: the first call per known sample in input order. Incomplete calls
    and those that say "not assigned" do not count."""
    usable = calls.filter(
        F.col("accession").isNotNull()
        & F.col("lineage_name").isNotNull()
        & ~F.col("lineage_name").rlike(r"(?i)\Anot assigned")
    )
    first = usable.groupBy("accession").agg(F.min_by("lineage_name", "input_order").alias("lineage_name"))
    ids = samples.select("accession", F.col("id").alias("sample_id"))
    return first.join(ids, "accession").select("sample_id", "lineage_name")


def ingest_consensus_lineages(tables: Tables, calls: DataFrame, system: str) -> Tables:
    """Load consensus calls (accession, lineage_name, input_order). A call the sample already has is
    not added again."""
    first = first_assigned_calls(calls, tables.samples)
    named = lineage_dimension_upsert(tables, system, first)
    new = first.join(_lineage_ids(named, system), "lineage_name").select(
        "sample_id",
        "lineage_id",
        F.lit(None).cast("double").alias("abundance"),
        F.lit(True).alias("is_consensus_call"),
    )
    unseen = new.join(tables.samples_lineages.select(*_CALL_KEY), _CALL_KEY, "left_anti")
    return named.replace(samples_lineages=tables.samples_lineages.unionByName(unseen.select(*tables.samples_lineages.columns)))


def ingest_demixed_abundance(tables: Tables, abundances: DataFrame, system: str) -> Tables:
    """Load abundances (accession, lineage_name, abundance, input_order): insert, or overwrite the
    abundance of the same (sample, lineage). Within a sample the last value of a lineage wins."""
    ids = tables.samples.select("accession", F.col("id").alias("sample_id"))
    last = (
        abundances.join(ids, "accession")
        .groupBy("sample_id", "lineage_name")
        .agg(F.max_by("abundance", "input_order").alias("__new"))
    )
    named = lineage_dimension_upsert(tables, system, last)
    incoming = last.join(_lineage_ids(named, system), "lineage_name").select(
        "sample_id", "lineage_id", F.lit(False).alias("is_consensus_call"), "__new"
    )
    merged = tables.samples_lineages.join(incoming, _CALL_KEY, "full").select(
        "sample_id", "lineage_id", F.coalesce("__new", "abundance").alias("abundance"), "is_consensus_call"
    )
    return named.replace(samples_lineages=merged)


def hierarchy_changes(tables: Tables, edges: DataFrame, system: str) -> tuple[Tables, DataFrame]:
    """Compare the full new hierarchy of a system (``parent_name, child_name``) with the stored one.

    Trailing stars are ignored and missing lineages added. Returns the tables with the added
    lineages, and every edge of the system with its ``action``: kept, added or dropped.
    """
    clean = edges.select(
        F.rtrim("parent_name", F.lit("*")).alias("parent_name"), F.rtrim("child_name", F.lit("*")).alias("child_name")
    ).distinct()
    names = clean.select(F.col("parent_name").alias("lineage_name")).union(clean.select("child_name"))
    named = lineage_dimension_upsert(tables, system, names)
    ids = _lineage_ids(named, system)
    parents = ids.select(F.col("lineage_name").alias("parent_name"), F.col("lineage_id").alias("parent_id"))
    children = ids.select(F.col("lineage_name").alias("child_name"), F.col("lineage_id").alias("child_id"))
    wanted = (
        clean.join(parents, "parent_name").join(children, "child_name").select("parent_id", "child_id")
    )
    own = ids.select(F.col("lineage_id").alias("parent_id"))
    stored = tables.lineages_immediate_children.join(own, "parent_id", "left_semi").select("parent_id", "child_id")
    both = stored.withColumn("__old", F.lit(True)).join(
        wanted.withColumn("__new", F.lit(True)), ["parent_id", "child_id"], "full"
    )
    action = (
        F.when(F.col("__old") & F.col("__new"), "kept").when(F.col("__new"), "added").otherwise("dropped")
    )
    return named, both.select("parent_id", "child_id", action.alias("action"))


def sync_lineage_hierarchy(tables: Tables, edges: DataFrame, system: str) -> Tables:
    """Make the stored hierarchy of a system equal to ``edges``; other systems keep theirs. A stored
    closure follows the added and dropped edges."""
    named, changes = hierarchy_changes(tables, edges, system)
    own = _lineage_ids(named, system).select(F.col("lineage_id").alias("parent_id"))
    others = tables.lineages_immediate_children.join(own, "parent_id", "left_anti")
    mine = changes.filter(F.col("action") != "dropped").select("parent_id", "child_id")
    after = others.select("parent_id", "child_id").unionByName(mine)
    if "lineage_closure" not in tables:
        return named.replace(lineages_immediate_children=after)
    # both are read several times below
    after, changes = cut(after, "hierarchy"), cut(changes.filter(F.col("action") != "kept"), "hierarchy-changes")
    added, dropped = changes.filter(F.col("action") == "added"), changes.filter(F.col("action") == "dropped")
    closure = cut(maintain_closure(tables.lineage_closure, after, added, dropped), "lineage-closure")
    return named.replace(lineages_immediate_children=after, lineage_closure=closure)
