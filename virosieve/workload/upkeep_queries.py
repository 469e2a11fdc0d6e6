"""Registered queries of loads in several steps and of the tables that loads keep up.

Each table is made from a part of the input, as by a first load, and brought up to the rest as by a
second one. The result must be that of one load of everything, so the SQL counterparts look at no steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from virosieve.functions.dates import MONTH
from virosieve.operators import ingest_changes, ingest_lineages, ingest_samples, lineages, mutations, phenotype, upkeep
from virosieve.plans import buckets
from virosieve.plans.durable import cut, fresh_path
from virosieve.tables import Tables
from virosieve.workload import binding
from virosieve.workload.ingest_oracles import highest, ingest_oracles, numbered, sql, translate
from virosieve.workload.oracles import query_oracles
from virosieve.workload.queries import Query, portable
from virosieve.workload.raw import raw_frame

FIRST, SECOND = "sample_id % 3 <> 0", "sample_id % 3 = 0"


def _merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "edges")
    buckets.create(raw_frame(spark, sf_dir, "stored_edges"), path, "change_id", 32)
    buckets.merge(spark, path, raw_frame(spark, sf_dir, "incoming_edges"), "change_id", ingest_changes.carrier_union_merge)
    return buckets.read(spark, path)


def _first_seen(spark: SparkSession, sf_dir: str) -> Tables:
    """The tables with ``first_seen`` from two loads, and without the edges it was made of."""
    tables = binding.tables(spark, sf_dir)
    path = fresh_path(spark, "first-seen")
    rows = [upkeep.first_seen_rows(tables, tables.cns_aa.filter(part), tables.ih_aa.filter(part)) for part in (FIRST, SECOND)]
    buckets.create(rows[0], path, "lineage_id", 32)
    buckets.merge(spark, path, rows[1], "lineage_id", upkeep.merge_first_seen)
    needed = ("lineage_systems", "lineages", "amino_acids")
    return Tables({**{name: tables[name] for name in needed}, "first_seen": buckets.read(spark, path)})


def _refreshed(spark: SparkSession, sf_dir: str, edges: str, number: str) -> tuple[Tables, DataFrame]:
    """Score sums of the first edges under older scores, refreshed for the second edges and the new scores."""
    tables = binding.tables(spark, sf_dir)
    path = fresh_path(spark, "sums")
    changed = F.col("amino_acid_id") % 50 == 0
    old_scores = tables.phenotype_metric_values.withColumn("value", F.when(changed, F.col("value") + 7).otherwise(F.col("value")))
    before = tables.replace(phenotype_metric_values=old_scores)
    buckets.create(upkeep.score_sums(before, tables[edges].filter(FIRST), number), path, "sample_id", 32)
    new_edges = tables[edges].filter(SECOND)
    samples = upkeep.touched_samples(new_edges, tables[edges], old_scores.filter(changed))
    fresh = upkeep.score_sums(tables, tables[edges], number, samples)
    buckets.merge(spark, path, fresh, "sample_id", lambda old, new: upkeep.replace_samples(old, new, new))
    return tables, buckets.read(spark, path)


def _loaded(spark: SparkSession, sf_dir: str) -> Tables:
    """All raw change records in two loads that overlap, the second into the stored tables of the first."""
    catalogs = {"alleles": "known_alleles", "amino_acids": "known_amino_acids"}
    tables = Tables({"samples": raw_frame(spark, sf_dir, "samples"), **{k: raw_frame(spark, sf_dir, v) for k, v in catalogs.items()}})
    root = fresh_path(spark, "store")
    number = F.substring("accession", 2, 20).cast("bigint")
    for part in (number % 3 != 0, (number % 3 == 0) | (number % 5 == 0)):
        raw = [raw_frame(spark, sf_dir, name).filter(part) for name in ("raw_mutations", "raw_ih_nt", "raw_ih_codons")]
        tables = ingest_changes.load_changes(tables, *raw, root, 16)
    return tables


def _named_edges(tables: Tables) -> DataFrame:
    """The edges of all four tables by what their changes read."""
    none = F.lit(None).cast("string")
    out = []
    for name in ingest_changes.EDGES:
        if name.endswith("nt"):
            key = [F.col("region").alias("feature"), F.col("position_nt").alias("position"), F.col("alt_nt").alias("alt"), none.alias("alt_codon")]
            catalog = tables.alleles.select(F.col("id").alias("change_id"), *key)
        else:
            key = [F.col("gff_feature").alias("feature"), F.col("position_aa").alias("position"), F.col("alt_aa").alias("alt"), "alt_codon"]
            catalog = tables.amino_acids.select(F.col("id").alias("change_id"), *key)
        edges = tables[name]
        bin_ = F.col("freq_bin") if "freq_bin" in edges.columns else F.lit(None).cast("int")
        edges = edges.select("change_id", "sample_id", bin_.cast("bigint").alias("freq_bin"))
        out.append(edges.join(catalog, "change_id").drop("change_id").withColumn("edges", F.lit(name)))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def _with_diamonds(edges: DataFrame, tables: Tables) -> DataFrame:
    """A hierarchy's edges, and edges that skip a level for some suppliers, so that paths meet again."""
    parts = F.split("child_name", r"\.")
    skip = edges.filter((F.size(parts) == 3) & (parts[2].cast("bigint") % 4 == 1))
    return edges.unionByName(skip.select(parts[0].alias("parent_name"), "child_name"))


def _kept_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closure of the stored hierarchy (with edges that skip a level), after the hierarchy was synced."""
    tables = binding.tables(spark, sf_dir)
    skipped = tables.lineages_immediate_children.filter("child_id % 2 = 0 AND child_id > 10000")
    upper = tables.lineages_immediate_children.select(F.col("parent_id").alias("grand"), F.col("child_id").alias("parent_id"))
    skipped = skipped.join(upper, "parent_id").select(F.col("grand").alias("parent_id"), "child_id")
    before = tables.replace(lineages_immediate_children=tables.lineages_immediate_children.unionByName(skipped))
    before = before.replace(lineage_closure=cut(lineages.lineage_descendants(before), "closure-before"))
    after = ingest_lineages.sync_lineage_hierarchy(before, _with_diamonds(raw_frame(spark, sf_dir, "raw_hierarchy"), tables), "demixed")
    return lineages.lineage_descendants(after)


def _upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "samples")
    buckets.create(raw_frame(spark, sf_dir, "stored_samples"), path, "accession", 64)
    ingest_samples.upsert_stored_samples(spark, path, raw_frame(spark, sf_dir, "incoming_samples"))
    return buckets.read(spark, path)


def upkeep_queries() -> dict[str, Query]:
    q: dict[str, Query] = {}

    def register(name: str):
        def add(run):
            q[name] = lambda spark, sf_dir: portable(run(spark, sf_dir))
            return run

        return add

    register("carrier_union_merge_buckets")(_merged_edges)
    register("first_seen_table")(lambda spark, sf_dir: _first_seen(spark, sf_dir).first_seen)

    @register("mutations_before_variants_table")
    def _(spark, sf_dir):
        return mutations.mutations_before_variants(_first_seen(spark, sf_dir), "N3", "consensus")

    @register("variants_before_mutations_table")
    def _(spark, sf_dir):
        return mutations.variants_before_mutations(_first_seen(spark, sf_dir), "N3", "consensus")

    @register("metric_sum_cache_refreshed")
    def _(spark, sf_dir):
        return _refreshed(spark, sf_dir, "cns_aa", "n_scored_mutations")[1]

    @register("variant_sum_cache_refreshed")
    def _(spark, sf_dir):
        return _refreshed(spark, sf_dir, "ih_aa", "n_scored_variants")[1]

    @register("metric_load_variants_by_date_cached")
    def _(spark, sf_dir):
        tables, sums = _refreshed(spark, sf_dir, "ih_aa", "n_scored_variants")
        return phenotype.metric_load_variants_by_date(tables.replace(variant_sum_cache=sums), "price", MONTH)

    register("lineage_descendants_kept")(_kept_closure)
    register("sample_upsert_buckets")(_upserted)
    register("load_changes")(lambda spark, sf_dir: _named_edges(_loaded(spark, sf_dir)))

    @register("load_changes_by_sample")
    def _(spark, sf_dir):
        tables = _loaded(spark, sf_dir)
        return _named_edges(tables.replace(**{name: tables.edges_of_samples(name) for name in ingest_changes.EDGES}))

    return q


def upkeep_oracles() -> dict[str, str]:
    live = query_oracles()
    o = {
        "carrier_union_merge_buckets": sql("SELECT change_id, sample_id FROM cns_edges"),
        "mutations_before_variants_table": live["mutations_before_variants"],
        "variants_before_mutations_table": live["variants_before_mutations"],
        "metric_sum_cache_refreshed": live["metric_sum_cache"],
        "metric_load_variants_by_date_cached": live["metric_load_variants_by_date"],
        "variant_sum_cache_refreshed": sql(
            "SELECT sample_id, phenotype_metric_id, round(sum(value), 6) AS pmv_value_sum, count(*) AS n_scored_variants "
            "FROM phenotype_metric_values v JOIN (SELECT DISTINCT change_id, sample_id FROM ih_edges) e ON e.change_id = v.amino_acid_id "
            "JOIN samples s ON s.id = e.sample_id "
            "WHERE collection_start_date IS NOT NULL AND collection_end_date IS NOT NULL GROUP BY sample_id, phenotype_metric_id"
        ),
        "first_seen_table": sql(
            "SELECT lineage_id, change_id, side, cast(min(collection_start_date) AS varchar) AS first_date FROM "
            "(SELECT change_id, sample_id, 'consensus' AS side FROM cns_edges UNION ALL SELECT change_id, sample_id, 'intrahost' FROM ih_edges) e "
            "JOIN samples s ON s.id = e.sample_id JOIN samples_lineages l USING (sample_id) "
            "WHERE collection_end_date - collection_start_date <= 30 GROUP BY lineage_id, change_id, side"
        ),
    }
    bins = {"bins": "SELECT k, cast(k AS decimal(6,2)) / 20 AS lo FROM range(20) AS r(k)"}

    def inside(freq: str) -> str:
        return f"{freq} >= k / 20 AND ({freq} < (k + 1) / 20 OR (k = 19 AND {freq} <= 1))"

    catalog = (
        f"SELECT gff_feature, position_aa, {translate('alt_codon')} AS alt_aa, alt_codon FROM ok_ih_codons "
        f"WHERE {translate('ref_codon')} IS NOT NULL AND {translate('alt_codon')} IS NOT NULL "
        "UNION SELECT gff_feature, position_aa, alt_aa, alt_codon FROM ok_mutations WHERE gff_feature IS NOT NULL AND ref_aa IS NOT NULL "
        "AND ref_codon IS NOT NULL AND alt_aa IS NOT NULL AND alt_codon IS NOT NULL AND position_aa IS NOT NULL "
        "UNION SELECT gff_feature, position_aa, alt_aa, alt_codon FROM known_amino_acids"
    )
    edges = sql(
        "SELECT DISTINCT e.*, s.id AS sample_id FROM (SELECT 'cns_nt' AS edges, region AS feature, position_nt AS position, alt_nt AS alt, "
        "cast(NULL AS varchar) AS alt_codon, cast(NULL AS bigint) AS freq_bin, accession FROM ok_mutations "
        "UNION ALL SELECT 'ih_nt', region, position_nt, alt_nt, NULL, k, accession FROM ok_ih_nt "
        f"JOIN bins ON {inside('gapped_freq')} "
        "UNION ALL SELECT 'cns_aa', gff_feature, position_aa, alt_aa, alt_codon, NULL, accession FROM ok_mutations "
        "JOIN catalog USING (gff_feature, position_aa, alt_aa, alt_codon) WHERE ref_aa IS NOT NULL "
        "UNION ALL SELECT 'ih_aa', gff_feature, position_aa, c.alt_aa, alt_codon, k, accession FROM ok_ih_codons "
        f"JOIN catalog c USING (gff_feature, position_aa, alt_codon) JOIN bins ON {inside('alt_freq')}) e "
        "JOIN samples s USING (accession)",
        {**bins, "catalog": catalog},
    ).replace("SELECT DISTINCT e.*,", "SELECT DISTINCT e.* EXCLUDE (accession),")
    o["sample_upsert_buckets"] = ingest_oracles()["sample_upsert"]
    # names first, as a synced hierarchy may add lineages: ids of those follow from the names' order
    o["lineage_descendants_kept"] = sql(
        "SELECT DISTINCT parent_id, child_id FROM deep",
        {
            "clean": "SELECT rtrim(parent_name, '*') AS parent_name, rtrim(child_name, '*') AS child_name FROM raw_hierarchy "
            "UNION SELECT split_part(child_name, '.', 1), child_name FROM raw_hierarchy "
            "WHERE len(string_split(child_name, '.')) = 3 AND cast(split_part(child_name, '.', 3) AS bigint) % 4 = 1",
            "demixed": "SELECT id, lineage_name FROM lineages WHERE lineage_system_id = 2",
            "unseen": "SELECT DISTINCT lineage_name FROM (SELECT parent_name AS lineage_name FROM clean UNION SELECT child_name FROM clean) "
            "WHERE lineage_name NOT IN (SELECT lineage_name FROM demixed)",
            "every": "SELECT * FROM demixed UNION ALL SELECT " + numbered("lineage_name", highest("lineages")) + ", lineage_name FROM unseen",
            "synced": "SELECT DISTINCT p.id AS parent_id, c.id AS child_id FROM clean JOIN every p ON p.lineage_name = parent_name "
            "JOIN every c ON c.lineage_name = child_name",
            "deep": "SELECT parent_id, child_id FROM synced UNION SELECT d.parent_id, s.child_id FROM deep d JOIN synced s ON d.child_id = s.parent_id",
        },
        recursive=True,
    )
    o["load_changes"] = o["load_changes_by_sample"] = edges
    return o
