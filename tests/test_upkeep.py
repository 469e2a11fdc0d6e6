"""Tables that loads keep up: buckets, first dates, score sums, samples and closures."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from virosieve.functions.dates import MONTH
from virosieve.operators import ingest_changes, ingest_samples, mutations, phenotype, samples, upkeep
from virosieve.operators.common import AA, change_keys
from virosieve.plans import buckets
from virosieve.plans.closure import maintain_closure, transitive_closure
from virosieve.plans.durable import cut
from virosieve.tables import Tables

EDGE = "change_id long, sample_id long"


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def files(path):
    """Every data file with its bytes' place on disk and time: a rewritten one differs."""
    return {f: (os.stat(f).st_ino, os.stat(f).st_mtime_ns) for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def bucket_in(path):
    return int(path.split("bucket=")[1].split("/")[0])


def test_only_touched_buckets_are_read_and_replaced(spark, tmp_path):
    path = str(tmp_path / "edges")
    stored = spark.range(400).select(F.col("id").alias("change_id"), (F.col("id") * 3).alias("sample_id"))
    buckets.create(stored, path, "change_id", 16)
    before = files(path)
    assert {bucket_in(f) for f in before} == set(range(16))
    incoming = spark.createDataFrame([(7, 1), (7, 21), (7, 1), (1007, 5)], EDGE)
    placed = incoming.select(buckets.bucket_of("change_id", 16).alias("b")).distinct()
    touched = {r.b for r in placed.collect()}
    # an untouched bucket that can't be read does no harm, and stays as it is
    other = next(f for f in before if bucket_in(f) not in touched)
    content = open(other, "rb").read()
    with open(other, "wb") as out:
        out.write(b"not a table")
    spoilt = files(path)
    assert set(buckets.merge(spark, path, incoming, "change_id", ingest_changes.carrier_union_merge)) == touched
    after = files(path)
    assert {f: s for f, s in after.items() if bucket_in(f) not in touched} == {f: s for f, s in spoilt.items() if bucket_in(f) not in touched}
    assert not {f for f in after if bucket_in(f) in touched} & set(before)
    with open(other, "wb") as out:
        out.write(content)
    assert rows(buckets.read(spark, path)) == rows(stored.union(spark.createDataFrame([(7, 1), (1007, 5)], EDGE)))
    # the same load again changes no row
    buckets.merge(spark, path, incoming, "change_id", ingest_changes.carrier_union_merge)
    assert buckets.read(spark, path).count() == 402
    assert buckets.merge(spark, path, incoming.limit(0), "change_id", ingest_changes.carrier_union_merge) == []


def test_a_hot_key_spreads_over_several_files(spark, tmp_path):
    path = str(tmp_path / "edges")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        hot = spark.range(200_000).select(F.lit(1).cast("long").alias("change_id"), F.xxhash64("id").alias("sample_id"))
        buckets.create(hot, path, "change_id", 4)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(files(path)) > 3
    assert buckets.read(spark, path).distinct().count() == 200_000


def test_upsert_replaces_only_the_samples_buckets(spark, tmp_path):
    path = str(tmp_path / "samples")
    stored = spark.range(1, 501).select("id", F.concat(F.lit("S"), "id").alias("accession"), F.lit("cow").alias("host"), F.lit("x").alias("platform"))
    buckets.create(stored, path, "accession", 64)
    before = files(path)
    incoming = spark.createDataFrame([("S7", "pig"), ("S999", "hen"), ("S998", None)], "accession string, host string")
    touched = set(ingest_samples.upsert_stored_samples(spark, path, incoming))
    after = files(path)
    assert len(touched) <= 3 and {f for f in before if f not in after} == {f for f in before if bucket_in(f) in touched}
    got = {r.accession: r for r in buckets.read(spark, path).collect()}
    assert len(got) == 502 and (got["S7"].id, got["S7"].host, got["S7"].platform) == (7, "pig", "x")
    assert {got["S998"].id, got["S999"].id} == {501, 502} and got["S999"].platform is None
    # the same rows as from the whole table
    assert rows(ingest_samples.sample_upsert(stored, incoming)) == rows(buckets.read(spark, path).select(*stored.columns))


def _small(spark):
    return Tables(
        {
            "samples": spark.createDataFrame(
                [(i, f"S{i}", f"2024-01-{i:02d}", f"2024-01-{i + (40 if i == 9 else 0) % 20:02d}") for i in range(1, 10)],
                "id long, accession string, s string, e string",
            ).select("id", "accession", F.to_date("s").alias("collection_start_date"), F.to_date("e").alias("collection_end_date")),
            "samples_lineages": spark.createDataFrame([(i, 1 + i % 2, None, True) for i in range(1, 10)], "sample_id long, lineage_id long, abundance double, is_consensus_call boolean"),
            "lineage_systems": spark.createDataFrame([(1, "P")], "id long, lineage_system_name string"),
            "lineages": spark.createDataFrame([(1, 1, "A"), (2, 1, "B")], "id long, lineage_system_id long, lineage_name string"),
            "amino_acids": spark.createDataFrame(
                [(1, "f", "A", 3, "K"), (2, "f", "A", 3, "K"), (3, "f", "D", 4, "E")],
                "id long, gff_feature string, ref_aa string, position_aa long, alt_aa string",
            ),
            "cns_aa": spark.createDataFrame([(1, 2), (2, 4), (3, 6), (1, 3)], EDGE),
            "ih_aa": spark.createDataFrame([(2, 8, 1), (2, 8, 2), (3, 2, 1), (1, 5, 1)], EDGE + ", freq_bin int"),
        }
    )


def test_first_seen_table_gives_the_live_rows_without_edges(spark, tmp_path):
    tables = _small(spark)
    live = [mutations.mutations_before_variants(tables, "A", "P"), mutations.variants_before_mutations(tables, "A", "P")]
    path = str(tmp_path / "first")
    buckets.create(upkeep.first_seen_rows(tables, tables.cns_aa.filter("sample_id > 3"), tables.ih_aa), path, "lineage_id", 4)
    late = upkeep.first_seen_rows(tables, tables.cns_aa.filter("sample_id <= 3"), tables.ih_aa.limit(0))
    buckets.merge(spark, path, late, "lineage_id", upkeep.merge_first_seen)
    stored = Tables({n: tables[n] for n in ("lineages", "lineage_systems", "amino_acids")} | {"first_seen": buckets.read(spark, path)})
    kept = [mutations.mutations_before_variants(stored, "A", "P"), mutations.variants_before_mutations(stored, "A", "P")]
    assert [rows(k) for k in kept] == [rows(k) for k in live]
    assert [(r.pos, r.lag) for r in live[0].collect()] == [(3, 6)] and [(r.pos, r.lag) for r in live[1].collect()] == [(4, 4)]


def test_refreshed_sums_are_those_made_anew(spark, tables):
    touched_changes = F.col("amino_acid_id") % 9 == 0
    old = tables.replace(phenotype_metric_values=tables.phenotype_metric_values.withColumn("value", F.when(touched_changes, 1.0).otherwise(F.col("value"))))
    for edges, number in (("cns_aa", "n_scored_mutations"), ("ih_aa", "n_scored_variants")):
        early, late = tables[edges].filter("sample_id % 4 <> 1"), tables[edges].filter("sample_id % 4 = 1")
        stored = upkeep.score_sums(old, early, number)
        chosen = upkeep.touched_samples(late, tables[edges], old.phenotype_metric_values.filter(touched_changes))
        got = upkeep.refresh_sums(tables, stored, tables[edges], number, chosen)
        want = upkeep.score_sums(tables, tables[edges], number)
        shown = ["sample_id", "phenotype_metric_id", F.round("pmv_value_sum", 4).alias("v"), number]
        assert rows(got, *shown) == rows(want, *shown)


def test_score_load_from_sums_reads_no_edges(spark, tables):
    sums = phenotype.variant_sum_cache(tables)
    cached = Tables({n: tables[n] for n in ("samples", "samples_lineages", "phenotype_metrics", "geo_locations")} | {"variant_sum_cache": sums})
    got = phenotype.metric_load_variants_by_date(cached, "price", MONTH)
    want = phenotype.metric_load_variants_by_date(tables, "price", MONTH)
    rounded = [F.round(c, 6).alias(c) if t == "double" else c for c, t in want.dtypes]
    assert rows(got, *rounded) == rows(want, *rounded)


def test_derived_tables_follow_a_load(spark, tables, tmp_path):
    """A load keeps the derived tables up, as made anew from all edges."""
    root = str(tmp_path / "store")
    base = tables.replace(**{})
    edges = {n: tables[n] for n in ingest_changes.EDGES}
    for name, df in edges.items():
        key = df.filter("sample_id % 3 <> 0")
        buckets.create(key, f"{root}/{name}", "change_id", 8)
        buckets.create(key, f"{root}/{name}_by_sample", "sample_id", 8)
    stored = base.replace(**{n: buckets.read(spark, f"{root}/{n}") for n in edges}, **{f"{n}_by_sample": buckets.read(spark, f"{root}/{n}_by_sample") for n in edges})
    ingest_changes.store_derived(stored, root, 8)
    incoming = {n: df.filter("sample_id % 3 = 0") for n, df in edges.items()}
    for name, df in incoming.items():
        buckets.merge(spark, f"{root}/{name}", df, "change_id", ingest_changes.carrier_union_merge)
        buckets.merge(spark, f"{root}/{name}_by_sample", df, "sample_id", ingest_changes.carrier_union_merge)
    kept = ingest_changes._keep_up(base, incoming, root)
    assert rows(kept.first_seen) == rows(upkeep.first_seen_rows(tables, tables.cns_aa, tables.ih_aa))
    for name, source, number in (("metric_sum_cache", "cns_aa", "n_scored_mutations"), ("variant_sum_cache", "ih_aa", "n_scored_variants")):
        shown = ["sample_id", "phenotype_metric_id", F.round("pmv_value_sum", 4).alias("v"), number]
        assert rows(kept[name], *shown) == rows(upkeep.score_sums(tables, tables[source], number), *shown)


@pytest.mark.parametrize("seed", range(4))
def test_kept_closure_is_the_one_made_anew(spark, seed):
    rng = random.Random(seed)
    # diamonds always; cycles in half of the cases
    pairs = {(a, b) for a in range(12) for b in range(12) if (a < b or seed % 2) and a != b and rng.random() < 0.12}
    before = {p for p in pairs if rng.random() < 0.8} | {(0, 1), (0, 2), (1, 3), (2, 3)}
    after = (before - {p for p in before if rng.random() < 0.25} - {(1, 3)}) | {p for p in pairs if rng.random() < 0.2}

    def frame(found):
        return spark.createDataFrame(sorted(found), "parent_id long, child_id long")

    got = maintain_closure(transitive_closure(frame(before)), frame(after), frame(after - before), frame(before - after))
    assert rows(got) == rows(transitive_closure(frame(after)))


def test_canonical_ids_grow_with_the_catalog(spark):
    schema = "id long, gff_feature string, ref_aa string, position_aa long, alt_aa string, alt_codon string"
    first = spark.createDataFrame([(1, "f", "A", 3, "K", "x"), (2, "f", "A", 3, "K", "y"), (3, "g", "A", 3, "K", "x")], schema)
    stored = ingest_changes.with_canonical_ids(first, first.limit(0), AA.columns)
    assert rows(stored, "id", "canonical_id") == [(1, 1), (2, 1), (3, 3)]
    new = spark.createDataFrame([(4, "f", "A", 3, "K", "z"), (5, "h", None, 1, "K", "x"), (6, "h", None, 1, "K", "y")], schema)
    more = ingest_changes.with_canonical_ids(new, stored, AA.columns)
    assert rows(more, "id", "canonical_id") == [(4, 1), (5, 5), (6, 5)]
    catalog = cut(stored.unionByName(more.select(*stored.columns)))
    given = change_keys(Tables({"amino_acids": catalog}), AA)
    assert "Join" not in given._jdf.queryExecution().optimizedPlan().toString()


def test_letter_bound_never_drops_a_hit(spark, tables):
    from virosieve.functions.fuzzy import match_ratio, ratio_bound

    rng = random.Random(2)
    texts = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(0, 14))) for _ in range(400)] + ["", "abc", "cba"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for needle in ("abc", "a", "éé ab", "cabbage"):
        got = df.select(ratio_bound(needle, F.col("t")).alias("b"), match_ratio(needle, F.col("t")).alias("r")).collect()
        assert all(r.b >= r.r - 1e-9 for r in got) and any(r.b < 0.7 for r in got)
    found = samples.distinct_values_search(tables, "admin1_name", "nasion_2")
    assert found.count() > 0


def test_tables_without_rows_keep_their_columns(spark, tmp_path):
    path = str(tmp_path / "none")
    rows_in = spark.createDataFrame([(3, 4), (5, 6)], EDGE)
    assert rows(buckets.create(rows_in.limit(0), path, "change_id", 8)) == []
    assert buckets.read(spark, path).dtypes == rows_in.dtypes and buckets.count_of(spark, path) == 8
    assert len(buckets.merge(spark, path, rows_in, "change_id", ingest_changes.carrier_union_merge)) in (1, 2)
    assert rows(buckets.read(spark, path)) == rows(rows_in)
    with pytest.raises(ValueError, match="no table in buckets"):
        buckets.count_of(spark, str(tmp_path))


def test_a_load_without_intrahost_records(spark, tables, tmp_path):
    """Edge tables that a first load leaves empty take a later load's edges."""
    samples = spark.createDataFrame([(1, "S1")], "id long, accession string")
    empty = {
        "alleles": spark.createDataFrame([], "id long, region string, position_nt long, ref_nt string, alt_nt string"),
        "amino_acids": spark.createDataFrame([], "id long, gff_feature string, position_aa long, alt_aa string, alt_codon string, ref_aa string, ref_codon string"),
    }
    consensus = "accession string, region string, position_nt long, ref_nt string, alt_nt string, gff_feature string, position_aa long, alt_aa string, alt_codon string, ref_aa string, ref_codon string"
    nts = spark.createDataFrame([("S1", "HA", 5, "A", "C", 0.5, 100)], "accession string, region string, position_nt long, ref_nt string, alt_nt string, gapped_freq double, gapped_dp int")
    codons = spark.createDataFrame([], "accession string, gff_feature string, position_aa long, alt_codon string, ref_codon string, alt_freq double, alt_dp int")
    mutation = spark.createDataFrame([("S1", "HA", 5, "A", "C", "f", 2, "K", "AAA", "D", "GAT")], consensus)
    root = str(tmp_path / "store")
    first = ingest_changes.load_changes(Tables({"samples": samples, **empty}), mutation, nts.limit(0), codons, root, 4)
    assert [first[n].count() for n in ingest_changes.EDGES] == [1, 1, 0, 0]
    second = ingest_changes.load_changes(first, mutation, nts, codons, root, 4)
    assert [second[n].count() for n in ingest_changes.EDGES] == [1, 1, 1, 0]
    assert second.edges_of_samples("ih_nt").count() == 1 and second.alleles.count() == 1
