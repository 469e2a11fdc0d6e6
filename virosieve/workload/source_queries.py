"""Registered queries of the readers and writers: Spark writes files derived from the test tables in
the layout of a source, and the reader under test reads them back."""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from virosieve.operators import ingest_changes, ingest_samples
from virosieve.plans.durable import fresh_path
from virosieve.sources import annotations, changes, lineages, samples, scores, sinks
from virosieve.workload import binding
from virosieve.workload.queries import Query, portable
from virosieve.workload.raw import raw_frame


def write_file(df: DataFrame, columns: Mapping[str, str], sep: str, reverse: bool = False, path: str | None = None) -> str:
    """``df`` as delimited files with the headers of a source format; returns the folder."""
    items = list(columns.items())
    if reverse:
        items.reverse()
    path = path or fresh_path(df.sparkSession, "source")
    shown = df.select(*[F.col(name).cast("string").alias(header) for name, header in items])
    shown.write.csv(path, sep=sep, header=True, quote='"', escape='"', emptyValue="")
    return path


def write_texts(files: DataFrame, path: str) -> str:
    """One text file per row of ``files(name, text)`` in a folder that all tasks can reach, written by the tasks.

    A file appears whole under its name, so a task that runs again does no harm.
    """
    folder = path.removeprefix("file://").removeprefix("file:")

    def write(batches):
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = f"{folder}/.{name}-{uuid.uuid4().hex}"
                with open(part, "w", encoding="utf-8") as out:
                    out.write(text)
                os.replace(part, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    files.select("name", "text").mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return path


def source_queries() -> dict[str, Query]:
    q: dict[str, Query] = {}

    def source(name: str):
        def register(run):
            q[name] = lambda spark, sf_dir: portable(run(spark, sf_dir))
            return run

        return register

    @source("src_samples_delimited")
    def _(spark, sf_dir):
        path = write_file(raw_frame(spark, sf_dir, "file_runs"), samples.RUN_COLUMNS, ",")
        return samples.read_sample_runs(spark, path, ",").drop("input_order")

    @source("src_samples_delimited_tsv")
    def _(spark, sf_dir):
        path = write_file(raw_frame(spark, sf_dir, "file_runs"), samples.RUN_COLUMNS, "\t", reverse=True)
        return samples.read_sample_runs(spark, path, "\t").select("accession", "bases", "malformed", "center_name")

    @source("src_samples_bulk_sd")
    def _(spark, sf_dir):
        return samples.read_bulk_sd(spark, write_file(raw_frame(spark, sf_dir, "file_sd"), samples.SD_COLUMNS, "\t"))

    @source("src_samples_bulk_wastewater")
    def _(spark, sf_dir):
        path = write_file(raw_frame(spark, sf_dir, "file_bulk"), samples.BULK_COLUMNS, "\t")
        return samples.read_bulk_wastewater(spark, path)

    @source("src_samples_bulk_ncbi")
    def _(spark, sf_dir):
        path = write_file(raw_frame(spark, sf_dir, "file_bulk"), samples.BULK_COLUMNS, "\t")
        return samples.read_bulk_ncbi(spark, path)

    def change_file(spark, sf_dir, record_type: str, reverse: bool = False) -> str:
        raw = {"mutations": "raw_mutations", "intrahost_nt": "file_ih_nt", "intrahost_codons": "file_ih_codons"}
        columns = changes.RECORD_TYPES[record_type][0]
        return write_file(raw_frame(spark, sf_dir, raw[record_type]), columns, "\t", reverse)

    @source("src_consensus_mutations")
    def _(spark, sf_dir):
        return changes.read_consensus_mutations(spark, change_file(spark, sf_dir, "mutations"))

    @source("src_intrahost_nt")
    def _(spark, sf_dir):
        return changes.read_intrahost_nt(spark, change_file(spark, sf_dir, "intrahost_nt"))

    @source("src_intrahost_codons")
    def _(spark, sf_dir):
        return changes.read_intrahost_codons(spark, change_file(spark, sf_dir, "intrahost_codons"))

    @source("src_classify_by_header")
    def _(spark, sf_dir):
        paths = [change_file(spark, sf_dir, t, reverse) for t in changes.RECORD_TYPES for reverse in (False, True)]
        found = changes.read_classified(spark, paths)
        out = None
        for record_type, rows in found.items():
            part = rows.groupBy("accession").agg(F.count("*").alias("n")).withColumn("record_type", F.lit(record_type))
            out = part if out is None else out.unionByName(part)
        return out

    def demixed_dir(spark, sf_dir, spoilt: bool = False) -> str:
        """A folder with one small ``.demixed`` file per accession, which lists the lineages of one sample.

        One file in 500 lies there by itself, the others packed: millions of files would fill a disk by their blocks.

        Of the spoilt files, by the number in the accession, one in five each has another accession inside,
        no lineages, no abundances, a text among the numbers, or a number too few.
        """
        rows = raw_frame(spark, sf_dir, "file_demixed")
        calls = rows.groupBy("accession").agg(F.sort_array(F.collect_list(F.struct("input_order", "lineage_name", "abundance"))).alias("calls"))
        kind = F.substring("accession", 2, 20).cast("bigint") % 5 if spoilt else F.lit(-1)
        numbers = F.col("calls.abundance").cast("array<string>")
        numbers = F.when(kind == 3, F.concat(F.array(F.lit("some")), F.slice(numbers, F.lit(2), F.size(numbers) - 1))).otherwise(numbers)
        numbers = F.when(kind == 4, F.slice(numbers, F.lit(1), F.size(numbers) - 1)).otherwise(numbers)
        files = calls.select(
            F.concat("accession", F.lit(".demixed")).alias("name"),
            F.concat_ws(
                "\n",
                F.concat(F.lit("\t"), F.when(kind == 0, F.lit("other")).otherwise(F.col("accession")), F.lit("_variants.tsv")),
                F.when(kind != 1, F.concat(F.lit("lineages\t"), F.array_join(F.col("calls.lineage_name"), " "))),
                F.when(kind != 2, F.concat(F.lit("abundances\t"), F.array_join(numbers, " "))),
            ).alias("text"),
        )
        path, alone = fresh_path(spark, "demixed"), F.pmod(F.xxhash64("name"), F.lit(500)) == 0
        files.filter(~alone).write.parquet(path)
        return write_texts(files.filter(alone), path)

    @source("src_demixed_dir")
    def _(spark, sf_dir):
        return lineages.read_demixed_dir(spark, demixed_dir(spark, sf_dir))

    @source("src_demixed_dir_malformed")
    def _(spark, sf_dir):
        return lineages.read_demixed_dir(spark, demixed_dir(spark, sf_dir, spoilt=True), malformed=True)

    @source("src_consensus_lineages")
    def _(spark, sf_dir):
        columns, sep = lineages.CALL_LAYOUTS["genotype_tsv"]
        path = write_file(raw_frame(spark, sf_dir, "raw_calls"), columns, sep)
        return lineages.read_consensus_lineages(spark, path, "genotype_tsv").drop("input_order")

    @source("src_consensus_lineages_csv")
    def _(spark, sf_dir):
        columns, sep = lineages.CALL_LAYOUTS["taxon_csv"]
        path = write_file(raw_frame(spark, sf_dir, "raw_calls"), columns, sep)
        return lineages.read_consensus_lineages(spark, path, "taxon_csv").drop("input_order")

    @source("src_lineage_edges")
    def _(spark, sf_dir):
        edges = raw_frame(spark, sf_dir, "raw_hierarchy")
        records = edges.select(F.col("child_name").alias("name"), F.col("parent_name").alias("parent")).unionByName(
            edges.select(F.col("parent_name").alias("name"), F.lit(None).cast("string").alias("parent"))
        )
        path = fresh_path(spark, "source")
        records.write.json(path)
        return lineages.read_lineage_edges(spark, path)

    def score_file(spark, sf_dir, layout: str, headers: Mapping[str, str]) -> str:
        return write_file(raw_frame(spark, sf_dir, "file_scores"), headers, scores.LAYOUTS[layout].sep)

    @source("src_scores_wide")
    def _(spark, sf_dir):
        site = {"position_aa": "sequential_site", "ref_aa": "wildtype", "alt_aa": "mutant"}
        path = score_file(spark, sf_dir, "ha_csv", {**site, "stability": "stability", "escape": "mouse sera escape"})
        return scores.read_scores(spark, path, "ha_csv").drop("input_order")

    @source("src_scores_wide_sc2")
    def _(spark, sf_dir):
        site = {"position_aa": "position", "ref_aa": "wildtype", "alt_aa": "mutant", "gff_feature": "GFF_FEATURE"}
        path = score_file(spark, sf_dir, "sc2_tsv", {**site, "stability": "delta_bind"})
        return scores.read_scores(spark, path, "sc2_tsv").drop("input_order")

    @source("src_scores_evescape")
    def _(spark, sf_dir):
        site = {"position_aa": "i", "ref_aa": "wildtype", "alt_aa": "mutant"}
        path = score_file(spark, sf_dir, "evescape_csv", {**site, "stability": "evescape", "escape": "evescape_sigmoid"})
        return scores.read_scores(spark, path, "evescape_csv").drop("input_order")

    # file_scores under each further layout: model column -> header
    layouts = {
        "ha_tsv": {"stability": "stability", "escape": "ferret sera escape"},
        "ha_csv_new": {"stability": "SA26 usage increase", "escape": "entry in SA26 and SA23 293T cells"},
        "ha_csv_neuac_neugc": {"stability": "entry in 293 cells", "escape": "NeuGc usage increase"},
        "pb2_csv": {"stability": "mutdiffsel"},
        "sc2_evescape_csv": {"stability": "evescape", "gff_feature": "GFF_FEATURE"},
    }

    def layout_query(layout: str, metrics: Mapping[str, str]):
        kind = scores.LAYOUTS[layout]
        site = {"position_aa": kind.position, "ref_aa": kind.ref, "alt_aa": kind.alt}

        @source(f"src_scores_{layout}")
        def _(spark, sf_dir):
            path = score_file(spark, sf_dir, layout, {**site, **metrics})
            return scores.read_scores(spark, path, layout).drop("input_order")

    for layout, metrics in layouts.items():
        layout_query(layout, metrics)

    def odd_score_file(spark, sf_dir) -> str:
        site = {"position_aa": "sequential_site", "ref_aa": "wildtype", "alt_aa": "mutant"}
        return score_file(spark, sf_dir, "ha_csv", {**site, "stability": "stability", "escape": "mouse sera escape"})

    @source("src_scores_rejects")
    def _(spark, sf_dir):
        rejects = scores.read_score_rejects(spark, odd_score_file(spark, sf_dir), "ha_csv")
        place = F.col("file").endswith(".csv") & (F.col("block") >= 0) & (F.col("record") >= 0)
        return rejects.select("problem", "phenotype_metric_name", "cell", place.alias("has_place"))

    @source("src_scores_staged")
    def _(spark, sf_dir):
        # good and bad records apart, and their numbers, from one pass over the files
        staged = scores.stage_scores(spark, odd_score_file(spark, sf_dir), "ha_csv", fresh_path(spark, "scores"))
        told = {"n_scores": staged.n_scores, "n_records_rejected": staged.n_records_rejected, "n_cells_rejected": staged.n_cells_rejected}
        stored = staged.scores.groupBy().agg(F.count("*").alias("scores_stored"), F.sum("value").alias("value_sum"))
        stored = stored.withColumn("rejects_stored", staged.rejects.select(F.count("*")).scalar())
        return stored.select("*", *[F.lit(n).cast("bigint").alias(name) for name, n in told.items()])

    @source("src_scores_differing_metrics")
    def _(spark, sf_dir):
        site = {"position_aa": "sequential_site", "ref_aa": "wildtype", "alt_aa": "mutant"}
        paths = [
            score_file(spark, sf_dir, "ha_csv", {**site, "stability": "stability", "escape": "mouse sera escape"}),
            score_file(spark, sf_dir, "ha_csv", {**site, "stability": "stability"}),
        ]
        return scores.read_scores(spark, paths, "ha_csv").drop("input_order")

    @source("load_samples")
    def _(spark, sf_dir):
        # the run table twice, in two folders that are read in the order of their names, first with another
        # center: the last record of an accession counts
        runs, path = raw_frame(spark, sf_dir, "file_runs"), fresh_path(spark, "source")
        write_file(runs.withColumn("center_name", F.lit("first")), samples.RUN_COLUMNS, ",", path=f"{path}/0")
        write_file(runs, samples.RUN_COLUMNS, ",", path=f"{path}/1")
        base = binding.tables(spark, sf_dir)
        known = base.samples.filter("id % 3 = 0").select("id", "accession", F.lit("old").alias("center_name"), "geo_location_id")
        loaded = ingest_samples.load_samples(base.replace(samples=known), samples.read_sample_runs(spark, path, ","))
        return loaded.samples.select("accession", "center_name")

    @source("load_samples_bulk")
    def _(spark, sf_dir):
        path = write_file(raw_frame(spark, sf_dir, "file_bulk"), samples.BULK_COLUMNS, "\t")
        base = binding.tables(spark, sf_dir)
        columns = "id, accession, host, 'old' AS isolate, 'site' AS ww_site_id, organism, is_retracted, collection_start_date, collection_end_date, geo_location_id"
        known = base.samples.filter("id % 3 = 0").selectExpr(*columns.split(", "))
        loaded = ingest_samples.load_samples(base.replace(samples=known), samples.read_bulk_wastewater(spark, path), bulk=True)
        return loaded.samples.select("accession", "isolate", "ww_site_id")

    @source("src_annotations")
    def _(spark, sf_dir):
        return annotations.read_annotations(
            spark, write_file(raw_frame(spark, sf_dir, "raw_markers"), annotations.MARKER_COLUMNS, "\t")
        )

    @source("sink_tables")
    def _(spark, sf_dir):
        root = fresh_path(spark, "sink")
        for name in ("stored_edges", "incoming_edges"):
            sinks.append_table(raw_frame(spark, sf_dir, name), root, "cns_nt")
        return spark.read.parquet(f"{root}/cns_nt")

    @source("sink_conflict_report")
    def _(spark, sf_dir):
        inputs = [raw_frame(spark, sf_dir, n) for n in ("ok_mutations", "ok_ih_nt", "known_alleles")]
        conflicts = ingest_changes.allele_ref_conflicts(*inputs)
        path = fresh_path(spark, "sink")
        sinks.write_conflict_report(conflicts, path)
        return spark.read.csv(path, header=True, schema=conflicts.schema)

    return q
