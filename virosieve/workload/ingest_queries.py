"""Registered queries of the ingest, validation and building-block operators."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from virosieve.functions import changes, values
from virosieve.functions.dates import MONTH, WEEK, max_span_filter, mid_collection_date
from virosieve.operators import (
    common, ingest_annotations, ingest_changes, ingest_lineages, ingest_samples, ingest_scores, validate,
)
from virosieve.workload import binding
from virosieve.workload.queries import DAYS, SAMPLE_WHERE, Query, portable
from virosieve.workload.raw import raw_frame


def on_raw(operator: Callable[..., DataFrame], *names: str, **params) -> Query:
    """An operator over raw frames, in the order of its parameters."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return portable(operator(*[raw_frame(spark, sf_dir, n) for n in names], **params))

    return run


def on_both(operator: Callable[..., DataFrame], *names: str) -> Query:
    """An operator over the domain tables and raw frames."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = binding.tables(spark, sf_dir)
        return portable(operator(tables, *[raw_frame(spark, sf_dir, n) for n in names]))

    return run


def known_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``known_annotation_members``, without its DISTINCT over all pairs, which shuffles them for each use.

    Of distinct readings of annotations and ids, pairs repeat only for annotations of several readings; those alone
    are made distinct.
    """
    reading = ["gff_feature", "position_aa", "ref_aa", "alt_aa"]
    ids = binding.frame(spark, sf_dir, binding.DOMAIN["amino_acids"]).select(F.col("id").alias("amino_acid_id"), *reading).distinct()
    known = raw_frame(spark, sf_dir, "known_annotations").select("annotation_id")
    read = known.join(ids, F.col("annotation_id") == F.col("amino_acid_id")).select("annotation_id", *reading)
    read = read.na.drop(subset=reading).distinct()
    several = read.groupBy("annotation_id").agg(F.count("*").alias("n")).filter("n > 1").select("annotation_id")

    def pairs(how: str) -> DataFrame:
        return read.join(several, "annotation_id", how).join(ids, reading).select("annotation_id", "amino_acid_id")

    return pairs("left_anti").unionByName(pairs("left_semi").distinct())


def on_markers(operator: Callable[..., DataFrame]) -> Query:
    """An operator over the domain tables, marker rows and stored annotations with their members."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        inputs = [raw_frame(spark, sf_dir, n) for n in ("raw_markers", "known_annotations")]
        return portable(operator(binding.tables(spark, sf_dir), *inputs, known_members(spark, sf_dir)))

    return run


def cleaning() -> dict[str, Query]:
    q: dict[str, Query] = {}

    q["collection_window"] = on_raw(
        lambda df: ingest_samples.with_collection_window(df).drop("kind", "d"), "date_texts"
    )
    q["clean_values"] = on_raw(
        lambda df: df.select(
            "l_orderkey",
            "l_linenumber",
            values.blank_to_null(F.col("number_text")).alias("number_text"),
            values.whole_from_decimal_text(F.col("number_text")).alias("whole"),
            values.bool_from_text(F.col("flag_text")).alias("flag"),
        ),
        "raw_cells",
    )
    q["clean_feature_name"] = on_raw(
        lambda df: df.select("p_partkey", changes.clean_feature_name(F.col("feature")).alias("feature")), "raw_features"
    )
    q["parse_change"] = on_raw(
        lambda df: df.select("id", changes.parse_change(F.col("name")).alias("c")).select("id", "c.*"), "raw_change_names"
    )
    q["mature_to_sequential"] = on_raw(
        lambda df: df.select("id", changes.mature_to_sequential(F.col("id") % 700 - 30).alias("site")), "raw_accessions"
    )
    q["exclude_accessions"] = on_raw(ingest_samples.exclude_accessions, "raw_accessions")
    q["split_geo"] = on_raw(lambda df: ingest_samples.split_geo(df, exact=True), "raw_places")
    q["split_geo_trimmed"] = on_raw(ingest_samples.split_geo, "raw_places")
    q["geo_dimension_upsert"] = on_raw(ingest_samples.geo_dimension_upsert, "known_places", "place_tuples")
    q["geo_dimension_upsert_ids"] = on_raw(
        lambda known, rows: ingest_samples.attach_geo_ids(rows, ingest_samples.geo_dimension_upsert(known, rows)),
        "known_places", "place_tuples",
    )
    q["sample_upsert"] = on_raw(ingest_samples.sample_upsert, "stored_samples", "incoming_samples")
    q["sample_id_lookup"] = on_raw(ingest_samples.sample_id_lookup, "samples", "raw_mutations")
    q["drop_unknown_accessions"] = on_raw(ingest_samples.drop_unknown_accessions, "raw_mutations", "samples")
    q["drop_null_ref"] = on_raw(ingest_samples.drop_null_ref, "raw_mutations")
    q["filter_intrahost_nt"] = on_raw(ingest_changes.filter_intrahost_nt, "raw_ih_nt")
    q["filter_intrahost_codons"] = on_raw(ingest_changes.filter_intrahost_codons, "raw_ih_codons")
    q["translate_codon"] = on_raw(
        lambda df: df.select("accession", "ref_codon", changes.translate_codon(F.col("ref_codon")).alias("ref_aa")),
        "raw_ih_codons",
    )
    return q


def change_loading() -> dict[str, Query]:
    q: dict[str, Query] = {}
    nt_inputs = ("ok_mutations", "ok_ih_nt", "known_alleles")
    aa_inputs = ("ok_ih_codons", "ok_mutations", "known_amino_acids")
    q["build_allele_catalog"] = on_raw(ingest_changes.build_allele_catalog, *nt_inputs)
    q["allele_ref_conflicts"] = on_raw(ingest_changes.allele_ref_conflicts, *nt_inputs)
    q["build_amino_acid_catalog"] = on_raw(ingest_changes.build_amino_acid_catalog, *aa_inputs)
    q["amino_acid_ref_conflicts"] = on_raw(ingest_changes.amino_acid_ref_conflicts, *aa_inputs)
    q["assign_freq_bin"] = on_raw(lambda df: ingest_changes.assign_freq_bin(df, "gapped_freq"), "raw_ih_nt")
    q["carriers_cns_allele"] = on_raw(ingest_changes.carriers_cns_allele, "ok_mutations", "full_alleles", "samples")
    q["carriers_cns_amino_acid"] = on_raw(
        ingest_changes.carriers_cns_amino_acid, "ok_mutations", "full_amino_acids", "samples"
    )
    q["carriers_ih_allele"] = on_raw(ingest_changes.carriers_ih_allele, "ok_ih_nt", "full_alleles", "samples")
    q["carriers_ih_amino_acid"] = on_raw(
        ingest_changes.carriers_ih_amino_acid, "ok_ih_codons", "full_amino_acids", "samples"
    )
    q["carrier_union_merge"] = on_raw(ingest_changes.carrier_union_merge, "stored_edges", "incoming_edges")
    q["transpose_carriers"] = on_raw(ingest_changes.transpose_carriers, "cns_edges")
    q["carrier_bitmaps"] = on_raw(
        lambda df: ingest_changes.carrier_bitmaps(df).select(
            "change_id", "bucket", F.bitmap_count("members").alias("n")
        ),
        "cns_edges",
    )
    return q


def dimension_loading() -> dict[str, Query]:
    q: dict[str, Query] = {}
    q["lookup_equivalent_changes"] = on_both(
        lambda t, rows: ingest_scores.lookup_equivalent_changes(rows, t.amino_acids), "raw_scores"
    )
    q["lookup_equivalent_changes_missing"] = on_both(
        lambda t, rows: ingest_scores.unknown_changes(rows, t.amino_acids), "raw_scores"
    )
    q["metric_dimension_upsert"] = on_both(
        lambda t, rows: ingest_scores.metric_dimension_upsert(t.phenotype_metrics, rows), "raw_scores"
    )
    q["metric_value_upsert"] = on_both(lambda t, rows: ingest_scores.load_scores(t, rows).phenotype_metric_values, "raw_scores")
    q["lineage_dimension_upsert"] = on_both(
        lambda t, calls: ingest_lineages.lineage_dimension_upsert(t, "consensus", calls).lineages, "raw_calls"
    )
    q["ingest_consensus_lineages"] = on_both(
        lambda t, calls: ingest_lineages.ingest_consensus_lineages(t, calls, "consensus").samples_lineages, "raw_calls"
    )
    q["ingest_demixed_abundance"] = on_both(
        lambda t, rows: ingest_lineages.ingest_demixed_abundance(t, rows, "demixed").samples_lineages, "raw_abundances"
    )
    q["sync_lineage_hierarchy"] = on_both(
        lambda t, edges: ingest_lineages.hierarchy_changes(t, edges, "demixed")[1], "raw_hierarchy"
    )
    q["sync_lineage_hierarchy_edges"] = on_both(
        lambda t, edges: ingest_lineages.sync_lineage_hierarchy(t, edges, "demixed").lineages_immediate_children,
        "raw_hierarchy",
    )

    def annotate(t, rows, known, members):
        stored = t.replace(
            annotations=known,
            annotations_amino_acids=members,
            annotations_papers=known.select("annotation_id", F.lit(0).alias("paper_id")),
            effects=known.select(F.col("effect_detail").alias("detail")).distinct(),
        )
        features = {name: name for name in ("ECONOMY", "SMALL", "MEDIUM", "PROMO", "STANDARD", "LARGE")}
        return ingest_annotations.ingest_annotations(stored, rows, features)

    def members(*inputs):
        loaded = annotate(*inputs)
        # members are not sorted for the join: their sort would spill
        return loaded.annotations_amino_acids.join(loaded.annotations.hint("shuffle_hash"), "annotation_id")

    q["ingest_annotations"] = on_markers(members)
    q["ingest_annotations_papers"] = on_markers(lambda *a: annotate(*a).papers.drop("id"))
    q["ingest_annotations_effects"] = on_markers(lambda *a: annotate(*a).effects)
    q["ingest_annotations_citations"] = on_markers(
        lambda *a: annotate(*a).annotations_papers.groupBy("annotation_id").agg(F.count("*").alias("n"))
    )
    return q


def validation() -> dict[str, Query]:
    q: dict[str, Query] = {}
    q["check_bin_overlap"] = on_raw(validate.check_bin_overlap, "odd_ranges")
    q["check_sample_once_per_change"] = on_raw(validate.check_sample_once_per_change, "ih_edges")
    q["check_lineage_cycle"] = on_raw(validate.check_lineage_cycle, "odd_edges")
    q["check_cross_system_edge"] = on_raw(validate.check_cross_system_edge, "odd_edges", "lineages")
    q["check_sample_rows"] = on_raw(validate.check_sample_rows, "odd_samples")
    q["check_abundance_xor_consensus"] = on_raw(validate.check_abundance_xor_consensus, "odd_calls")
    q["check_non_empty"] = on_raw(
        lambda df: validate.check_non_empty(df, validate.NON_EMPTY["amino_acids"]), "odd_amino_acids"
    )
    q["check_no_self_parent"] = on_raw(validate.check_no_self_parent, "odd_edges")
    q["check_unique"] = on_raw(lambda df: validate.check_unique(df, validate.NATURAL_KEYS["alleles"]), "alleles")
    q["check_unique_all"] = on_both(validate.check_all_unique)
    q["check_references"] = on_raw(
        lambda child, parent: validate.check_references(child, "amino_acid_id", parent), "odd_values", "amino_acids"
    )
    q["check_references_all"] = on_both(validate.check_all_references)
    return q


def building_blocks() -> dict[str, Query]:
    q: dict[str, Query] = {}
    q["sample_filter"] = on_both(lambda t: common.select_samples(t, SAMPLE_WHERE).select("id"))
    q["sample_filter_lineages"] = on_both(
        lambda t: common.select_samples(t, "abundance > 0.4 OR lineage_name = 'N3'", lineages="inner").select("id")
    )
    q["mid_collection_date"] = on_both(lambda t: t.samples.select("id", mid_collection_date().alias("mid_collection_date")))
    q["max_span_filter"] = on_both(lambda t: t.samples.filter(max_span_filter(100)).select("id"))
    for name, date_bin in (("month", MONTH), ("week", WEEK), ("days", DAYS)):
        q[f"date_bin_{name}"] = on_both(
            lambda t, b=date_bin: b.labelled(t.samples.select("id", *b.columns(mid_collection_date())))
        )
    q["date_bin_iso_week"] = on_both(
        lambda t: t.samples.select("id", *dataclasses.replace(WEEK, unit="iso_week").columns("collection_start_date"))
    )
    q["bin_group_order"] = on_both(
        lambda t: t.samples.select("host", "platform", *MONTH.columns("collection_start_date"))
        .groupBy(*MONTH.group_columns(extra=["platform"], prefix=["host"]))
        .agg(F.count("*").alias("n"))
        .orderBy(*MONTH.order)
    )
    q["change_axis"] = on_both(
        lambda t: common.with_change_names(common.change_keys(t, common.AA), t, common.change_axis("aa"))
    )
    q["freq_overlap_filter"] = on_both(
        lambda t: common.intrahost_window(t.ih_nt, 0.25, 0.5).select(
            "change_id", "sample_id", changes.bin_text(F.col("freq_bin")).alias("alt_freq_range")
        )
    )
    q["ww_flag"] = on_both(lambda t: t.samples.select("id", common.ww_flag().alias("is_wastewater")))
    return q


def ingest_queries() -> dict[str, Query]:
    return {**cleaning(), **change_loading(), **dimension_loading(), **validation(), **building_blocks()}
