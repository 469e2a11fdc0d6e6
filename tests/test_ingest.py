from decimal import Decimal

import pytest
from pyspark.sql import Observation, functions as F

from virosieve.operators import ingest_annotations as ia, ingest_changes as ic, ingest_lineages as il
from virosieve.operators import ingest_samples as isa, ingest_scores as isc, validate
from virosieve.sources.sinks import write_tables
from virosieve.tables import GEO_COLUMNS, Tables
from virosieve.workload import binding, ingest_queries
from virosieve.workload.raw import raw_frame


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


SAMPLES = "id long, accession string, host string"
MUTATIONS = (
    "accession string, region string, position_nt long, ref_nt string, alt_nt string, gff_feature string, "
    "ref_codon string, alt_codon string, ref_aa string, alt_aa string, position_aa long"
)
IH_NT = "accession string, region string, position_nt long, ref_nt string, alt_nt string, gapped_freq decimal(20,10), gapped_dp int"
IH_CODONS = "accession string, gff_feature string, position_aa long, ref_codon string, alt_codon string, alt_dp int, alt_freq double"


@pytest.fixture(scope="module")
def raw(spark):
    mutations = frame(
        spark, MUTATIONS,
        ("S1", "HA", 10, "A", "C", "f", "AAA", "AAC", "K", "N", 4),
        ("S2", "HA", 10, "G", "C", "f", "AAG", "AAC", "K", "N", 4),
        ("S2", "HA", 11, None, "C", None, None, None, None, None, None),
        ("S2", "HA", 12, "T", "G", "f", None, "GGG", None, "G", 5),
        ("unknown", "HA", 13, "T", "G", "f", "TTT", "GGG", "F", "G", 6),
    )
    ih_nts = frame(
        spark, IH_NT,
        ("S1", "HA", 10, "A", "C", Decimal("0.05"), 50),
        ("S1", "HA", 20, "A", "T", Decimal("1"), 50),
        ("S1", "HA", 21, "A", "A", Decimal("0.5"), 50),
        ("S1", "HA", 22, "A", "T", Decimal("0.0199"), 50),
        ("S1", "HA", 23, "A", "T", Decimal("0.5"), 9),
        ("S2", "HA", 24, "A", "T", Decimal("0.02"), None),
    )
    ih_codons = frame(
        spark, IH_CODONS,
        ("S1", "f", 4, "AAA", "AAC", 20, 0.3),
        ("S1", "f", 9, "ANA", "CCC", 20, 0.3),
        ("S1", "f", 9, "AAA", "C-C", 20, 0.3),
        ("S2", "f", 4, "AAA", "AAC", 5, 0.3),
    )
    return mutations, ih_nts, ih_codons


@pytest.fixture(scope="module")
def base(spark):
    return Tables(
        {
            "samples": frame(spark, SAMPLES, (1, "S1", "cow"), (2, "S2", "cow")),
            "alleles": frame(spark, "id long, region string, position_nt long, ref_nt string, alt_nt string", (7, "HA", 20, "G", "T")),
            "amino_acids": frame(
                spark,
                "id long, gff_feature string, position_aa long, alt_aa string, alt_codon string, ref_aa string, ref_codon string",
            ),
        }
    )


def test_load_changes(spark, raw, base, tmp_path):
    loaded = ic.load_changes(base, *raw, str(tmp_path / "one"))
    alleles = {(r.region, r.position_nt, r.alt_nt): r for r in loaded.alleles.collect()}
    # the stored allele keeps id and ref, of the two refs at 10 the smaller is kept
    assert alleles["HA", 20, "T"].id == 7 and alleles["HA", 20, "T"].ref_nt == "G"
    assert alleles["HA", 10, "C"].ref_nt == "A"
    assert set(alleles) == {("HA", 10, "C"), ("HA", 12, "G"), ("HA", 20, "T"), ("HA", 24, "T")}
    assert sorted(r.id for r in alleles.values()) == [7, 8, 9, 10]
    ids = {k: r.id for k, r in alleles.items()}
    assert rows(loaded.cns_nt) == sorted([(ids["HA", 10, "C"], 1), (ids["HA", 10, "C"], 2), (ids["HA", 12, "G"], 2)], key=str)
    assert rows(loaded.ih_nt) == sorted(
        [(ids["HA", 10, "C"], 1, 1), (7, 1, 19), (ids["HA", 24, "T"], 2, 0)], key=str
    )
    aas = {(r.position_aa, r.alt_codon): r for r in loaded.amino_acids.collect()}
    assert set(aas) == {(4, "AAC"), (9, "CCC")}
    assert aas[9, "CCC"].ref_aa == "X" and aas[9, "CCC"].alt_aa == "P"
    assert rows(loaded.ih_aa) == sorted([(aas[4, "AAC"].id, 1, 6), (aas[9, "CCC"].id, 1, 6)], key=str)

    # a second load of the same files changes nothing
    again = ic.load_changes(loaded, *raw, str(tmp_path / "two"))
    for name in ("alleles", "amino_acids", "cns_nt", "cns_aa", "ih_nt", "ih_aa"):
        assert rows(again[name]) == rows(loaded[name])
    by_sample = spark.read.parquet(str(tmp_path / "one" / "cns_nt_by_sample"))
    assert rows(by_sample.select("change_id", "sample_id")) == rows(loaded.cns_nt)


def test_a_load_looks_samples_up_once(spark, raw, base, tmp_path, monkeypatch):
    """Samples are worked out once a load, however many records and edges look them up, and edges are written once for both layouts."""
    read, labels, written = spark.sparkContext.accumulator(0), [], ic.buckets.cut
    seen = F.udf(lambda x: (read.add(1), x)[1], "string").asNondeterministic()
    samples = base.samples.withColumn("accession", seen("accession"))
    monkeypatch.setattr(ic.buckets, "cut", lambda df, label: labels.append(label) or written(df, label))
    root = str(tmp_path / "counted")
    ic.load_changes(base.replace(samples=samples), *raw, root, 4)
    assert read.value == 2 and not labels
    again = ic.load_changes(base.replace(samples=samples), *raw, root, 4)
    assert read.value == 4 and set(labels) == {"merged"}
    assert [again[name].count() for name in ic.EDGES] == [3, 2, 3, 2]


def test_written_tables_are_found(spark, tables, tmp_path):
    names = ["samples", "geo_locations", "alleles", "ih_nt"]
    write_tables(tables, str(tmp_path / "t"), names)
    loaded = Tables.load(spark, str(tmp_path / "t"))
    assert [n for n in ("samples", "alleles", "ih_nt", "cns_aa", "metric_sum_cache") if n in loaded] == ["samples", "alleles", "ih_nt"]
    assert rows(loaded.ih_nt) == rows(tables.ih_nt)


def test_ref_conflicts(spark, raw, base):
    mutations, ih_nts, ih_codons = raw
    found = ic.allele_ref_conflicts(isa.drop_null_ref(mutations), ic.filter_intrahost_nt(ih_nts), base.alleles)
    assert rows(found, "position_nt", "ref") == [(10, "A"), (10, "G")]
    found = ic.amino_acid_ref_conflicts(ic.filter_intrahost_codons(ih_codons), mutations, base.amino_acids)
    assert rows(found, "field", "ref") == [("ref_codon", "AAA"), ("ref_codon", "AAG")]


def test_null_refs_are_counted(raw):
    seen = Observation()
    assert isa.drop_null_ref(raw[0], seen).count() == 4
    assert seen.get["null_ref"] == 1


def test_codon_filter_uses_the_frequency(raw):
    kept = ic.filter_intrahost_codons(raw[2])
    assert kept.count() == 3
    assert ic.filter_intrahost_codons(raw[2], min_freq=0.31).count() == 0


def test_union_merge_is_idempotent_and_transpose_reverses(tables):
    edges = tables.cns_aa
    assert rows(ic.carrier_union_merge(edges, edges)) == rows(edges)
    turned = ic.transpose_carriers(edges)
    back = ic.transpose_carriers(turned.toDF("change_id", "sample_id")).toDF("change_id", "sample_id")
    assert rows(back) == rows(edges.select("change_id", "sample_id"))


def test_bitmaps_hold_every_carrier(tables):
    bitmaps = ic.carrier_bitmaps(tables.cns_aa)
    counted = bitmaps.groupBy("change_id").agg(F.sum(F.bitmap_count("members")).alias("n"))
    assert rows(counted) == rows(tables.cns_aa.groupBy("change_id").agg(F.count("*").alias("n")))


def test_moved_sample_is_reported(spark):
    stored = frame(spark, "change_id long, sample_id long, freq_bin int", (1, 1, 3), (1, 2, 3))
    moved = frame(spark, "change_id long, sample_id long, freq_bin int", (1, 1, 4), (1, 2, 3))
    merged = ic.carrier_union_merge(stored, moved)
    assert rows(validate.check_sample_once_per_change(merged)) == [(1, 1, 3, 4)]


def test_places(spark):
    schema = "id long, " + ", ".join(f"{c} string" for c in GEO_COLUMNS)
    known = frame(spark, schema, (4, "USA", "Iowa", None, None))
    incoming = frame(
        spark, schema,
        (1, "USA", "Iowa", None, None), (2, "USA", None, None, None), (3, "USA", None, None, None), (5, None, None, None, None),
    )
    geo = isa.geo_dimension_upsert(known, incoming)
    assert rows(geo, "id", "country_name", "admin1_name") == [(4, "USA", "Iowa"), (5, "USA", None)]
    assert rows(isa.attach_geo_ids(incoming, geo), "id", "geo_location_id") == [(1, 4), (2, 5), (3, 5), (5, None)]


def test_sample_upsert(spark):
    known = frame(spark, SAMPLES, (1, "S1", "cow"), (2, "S2", "cow"))
    new = frame(spark, "accession string, host string, input_order int", ("S2", "pig", 1), ("S2", None, 2), ("S3", "hen", 3))
    last = isa.last_per_accession(new, "input_order")
    assert rows(isa.sample_upsert(known, last), "id", "accession", "host") == [(1, "S1", "cow"), (2, "S2", None), (3, "S3", "hen")]
    assert rows(isa.sample_upsert(known, last, []), "id", "host") == [(1, "cow"), (2, "cow"), (3, "hen")]


def test_load_samples(spark):
    schema = "id long, accession string, host string, organism string, bio_sample string, is_retracted boolean, " \
        "collection_start_date date, collection_end_date date, geo_location_id long"
    geo = "id long, " + ", ".join(f"{c} string" for c in GEO_COLUMNS)
    base = Tables(
        {
            "samples": frame(spark, schema, (1, "S1", "cow", "x", "old", False, None, None, 4)),
            "geo_locations": frame(spark, geo, (4, "USA", "Iowa", None, None)),
        }
    )
    raw = frame(
        spark, "accession string, host string, organism string, bio_sample string, collection_date string, geo_location string",
        ("S1", "pig", "y", "new", "2024-03", "USA/Ohio"), ("S2", "hen", "y", "new", "2024", "USA / Iowa / Ames / a / b"),
        ("S3", "hen", "y", "new", "", "USA"),
    )
    loaded = isa.load_samples(base, isa.clean_bulk_samples(raw), bulk=True)
    got = {r.accession: r for r in loaded.samples.collect()}
    assert set(got) == {"S1", "S2"}
    # a bulk load does not touch the biosample of a known sample
    assert (got["S1"].id, got["S1"].host, got["S1"].bio_sample) == (1, "pig", "old")
    assert got["S2"].bio_sample == "new" and got["S2"].id == 2
    places = {r.id: (r.admin1_name, r.admin3_name) for r in loaded.geo_locations.collect()}
    assert places[got["S1"].geo_location_id] == ("Ohio", None)
    assert places[got["S2"].geo_location_id] == ("Iowa", "a")
    assert str(got["S1"].collection_end_date) == "2024-03-31"


def test_repeated_accessions(spark):
    schema = "id long, accession string, host string, geo_location_id long"
    geo = "id long, " + ", ".join(f"{c} string" for c in GEO_COLUMNS)
    base = Tables({"samples": frame(spark, schema, (5, "S1", "cow", None)), "geo_locations": frame(spark, geo)})
    names = ", ".join(f"{c} string" for c in GEO_COLUMNS)
    runs = frame(
        spark, f"accession string, host string, {names}, input_order int, malformed boolean",
        ("S1", "pig", *[None] * len(GEO_COLUMNS), 1, False), ("S1", "hen", *[None] * len(GEO_COLUMNS), 3, False),
        ("S2", "pig", *[None] * len(GEO_COLUMNS), 2, False), ("S2", "elk", *[None] * len(GEO_COLUMNS), 9, False),
        ("S2", "bad", *[None] * len(GEO_COLUMNS), 10, True),
    )
    loaded = isa.load_samples(base, runs).samples
    assert rows(loaded, "id", "accession", "host") == [(5, "S1", "hen"), (6, "S2", "elk")]
    with pytest.raises(ValueError, match="S1"):
        isa.load_samples(base, runs.drop("input_order"), bulk=True)


def test_scores_last_value_wins(spark):
    stored = frame(spark, "phenotype_metric_id long, amino_acid_id long, value double", (1, 1, 5.0), (1, 2, 6.0), (1, 3, 7.0))
    new = frame(
        spark, "phenotype_metric_id long, amino_acid_id long, value double, input_order int",
        (1, 1, 8.0, 2), (1, 1, 9.0, 1), (1, 2, 6.0, 3), (1, 4, 1.0, 4),
    )
    assert rows(isc.metric_value_upsert(stored, new)) == [
        (1, 1, 8.0, True), (1, 2, 6.0, False), (1, 3, 7.0, False), (1, 4, 1.0, False),
    ]


@pytest.fixture
def lineage_tables(spark):
    return Tables(
        {
            "samples": frame(spark, SAMPLES, (1, "S1", "cow"), (2, "S2", "cow")),
            "lineage_systems": frame(spark, "id long, lineage_system_name string", (1, "pango")),
            "lineages": frame(
                spark, "id long, lineage_system_id long, lineage_name string",
                (1, 1, "A"), (2, 1, "B"), (3, 1, "C"), (9, 5, "other"), (10, 5, "other.1"),
            ),
            "lineages_immediate_children": frame(spark, "parent_id long, child_id long", (1, 2), (1, 3), (9, 10)),
            "samples_lineages": frame(
                spark, "sample_id long, lineage_id long, abundance double, is_consensus_call boolean",
                (1, 1, None, True), (2, 2, 0.5, False),
            ),
        }
    )


def test_consensus_calls(spark, lineage_tables):
    calls = frame(
        spark, "accession string, lineage_name string, input_order int",
        ("S1", "Not Assigned: low", 1), ("S1", "A", 2), ("S1", "B", 3), ("S2", "new", 4), ("S2", "A", 5), ("S9", "A", 6), (None, "A", 0),
    )
    loaded = il.ingest_consensus_lineages(lineage_tables, calls, "pango")
    new_id = loaded.lineages.filter("lineage_name = 'new'").first().id
    assert rows(loaded.samples_lineages.filter("is_consensus_call"), "sample_id", "lineage_id") == [(1, 1), (2, new_id)]


def test_abundances_overwrite(spark, lineage_tables):
    new = frame(
        spark, "accession string, lineage_name string, abundance double, input_order int",
        ("S2", "B", 0.7, 0), ("S2", "B", 0.8, 1), ("S1", "A", 0.1, 0), ("S9", "A", 0.1, 0),
    )
    loaded = il.ingest_demixed_abundance(lineage_tables, new, "pango")
    assert rows(loaded.samples_lineages, "sample_id", "lineage_id", "abundance", "is_consensus_call") == [
        (1, 1, 0.1, False), (1, 1, None, True), (2, 2, 0.8, False),
    ]
    assert rows(validate.check_abundance_xor_consensus(loaded.samples_lineages)) == []


def test_hierarchy_follows_the_file(spark, lineage_tables):
    edges = frame(spark, "parent_name string, child_name string", ("A*", "B"), ("B", "D*"), ("A", "B"))
    loaded = il.sync_lineage_hierarchy(lineage_tables, edges, "pango")
    d = loaded.lineages.filter("lineage_name = 'D'").first().id
    assert rows(loaded.lineages_immediate_children) == sorted([(1, 2), (2, d), (9, 10)], key=str)
    _, changes = il.hierarchy_changes(lineage_tables, edges, "pango")
    assert {r.action for r in changes.collect()} == {"kept", "added", "dropped"}


def test_new_system_is_created(spark, lineage_tables):
    edges = frame(spark, "parent_name string, child_name string", ("x", "y"))
    loaded = il.sync_lineage_hierarchy(lineage_tables, edges, "fresh")
    assert rows(loaded.lineage_systems) == [(1, "pango"), (2, "fresh")]
    ids = {r.lineage_name: r.id for r in loaded.lineages.filter("lineage_system_id = 2").collect()}
    assert sorted(ids.values()) == [11, 12]
    assert rows(loaded.lineages_immediate_children) == sorted([(1, 2), (1, 3), (9, 10), (ids["x"], ids["y"])], key=str)


def test_annotations(spark):
    aa = "id long, gff_feature string, position_aa long, ref_aa string, alt_aa string"
    base = Tables(
        {
            "amino_acids": frame(
                spark, aa,
                (1, "XAJ25416.1", 5, "A", "K"), (2, "XAJ25416.1", 5, "A", "K"), (3, "XAJ25415.1", 21, "A", "D"), (4, "XAJ25422.1", 3, "S", "D"),
            ),
            "effects": frame(spark, "detail string", ("old",)),
            "papers": frame(spark, "id long, authors string, publication_year long, title string", (6, "a", 2000, "t")),
            "annotations": frame(spark, "annotation_id long, effect_detail string", (5, "old")),
            "annotations_amino_acids": frame(spark, "annotation_id long, amino_acid_id long", (5, 1), (5, 2)),
            "annotations_papers": frame(spark, "annotation_id long, paper_id long", (5, 6)),
        }
    )
    markers = frame(
        spark, "aa_change string, effect_detail string, title string, authors string, publication_year long, marker_id string",
        ("M1:A5K", "old", "t", "a", 2000, "m1"),            # the set {1, 2} is known for this effect
        ("M1:A5K", "new", "t", "a", 2000, "m1"),
        ("HA1-5:A5D", "new", "t2", "a", 2001, "m2"),        # mature site 5 is sequential site 21
        ("PA:S3D", "new", "t2", "a", 2001, "m2"),
        ("M1:A5K", "new", "t3", None, 2001, "m3"),          # repeats the set of m1
        ("M1:A5K", "lost", "t4", "a", 2001, "m4"),
        ("NS-2:A1K", "lost", "t4", "a", 2001, "m4"),        # not in the catalog: the whole group goes
        ("HA1-5:A600D", "worse", "t4", "a", 2001, "m5"),
        ("gibberish", "worse", "t4", "a", 2001, "m6"),
    )
    loaded = ia.ingest_annotations(base, markers)
    members = loaded.annotations_amino_acids.join(loaded.annotations, "annotation_id")
    sets = {}
    for r in members.collect():
        sets.setdefault((r.annotation_id, r.effect_detail), set()).add(r.amino_acid_id)
    assert sorted((e, sorted(s)) for (_, e), s in sets.items()) == [("new", [1, 2]), ("new", [3, 4]), ("old", [1, 2])]
    assert rows(loaded.effects) == [("new",), ("old",)]
    assert rows(loaded.papers, "title") == [("t",), ("t2",), ("t3",)]
    assert loaded.annotations_papers.count() == 3


def test_marker_sets_are_compared_without_their_ids(spark, monkeypatch):
    """Groups are held by parts of the catalog: many ids that read the same don't multiply them."""
    aa = "id long, gff_feature string, position_aa long, ref_aa string, alt_aa string"
    ids = [(n, "XAJ25416.1", n % 2, "A", "K") for n in range(40)] + [(99, "XAJ25416.1", 0, "A", "K"), (99, "XAJ25416.1", 7, "A", "D")]
    ids += [(100, "XAJ25416.1", 7, "A", "D"), (None, "XAJ25416.1", 8, "A", "D"), (101, "XAJ25416.1", 8, "A", "D"), (1, "XAJ25416.1", 1, "A", "K")]
    even, odd = [*range(0, 40, 2), 99], [*range(1, 40, 2)]
    old = [(5, n) for n in even] + [(5, even[0])] + [(6, n) for n in odd[1:]] + [(7, n) for n in even + odd] + [(8, 99), (8, 100)]
    base = Tables(
        {
            "amino_acids": spark.createDataFrame(ids, aa),
            "effects": spark.createDataFrame([], "detail string"),
            "papers": spark.createDataFrame([], "id long, authors string, publication_year long, title string"),
            "annotations": spark.createDataFrame([(n, "e") for n in (5, 6, 7, 8)] + [(5, "f")], "annotation_id long, effect_detail string"),
            "annotations_amino_acids": spark.createDataFrame(old, "annotation_id long, amino_acid_id long"),
            "annotations_papers": spark.createDataFrame([], "annotation_id long, paper_id long"),
        }
    )
    names = {"a": ["0"], "b": ["1"], "c": ["0", "1"], "d": ["7D"], "g": ["1"], "h": ["0", "7D"], "i": ["8D"], "j": ["7D", "0"]}
    markers = [
        (f"M1:A{x if x[-1] == 'D' else x + 'K'}", effect, "t", "a", 2000, m) for m, xs in names.items() for x in xs for effect in ("e", "f")
    ]
    held, written = [], ia.cut
    monkeypatch.setattr(ia, "cut", lambda df, label: held.append(df.count()) or written(df, label) if label == "marker-members" else written(df, label))
    schema = "aa_change string, effect_detail string, title string, authors string, publication_year long, marker_id string"
    loaded = ia.ingest_annotations(base, spark.createDataFrame(markers, schema))
    assert held[0] < 40  # 302 with every id
    sets = {}
    for r in loaded.annotations_amino_acids.join(loaded.annotations.filter("annotation_id > 8"), "annotation_id").collect():
        sets.setdefault((r.annotation_id, r.effect_detail), []).append(r.amino_acid_id)
    # e: a, c and d are known and g repeats b; f: a is known, and j repeats h
    both = sorted({*even, 99, 100})
    wanted = [("e", odd), ("e", both), ("f", odd), ("f", sorted(even + odd)), ("f", [99, 100]), ("f", both)]
    assert sorted((e, sorted(s)) for (_, e), s in sets.items()) == sorted(wanted)


def test_stored_members_are_digested_where_their_bounds_fit(spark, monkeypatch):
    """Members of annotations that can have no group's set are not shuffled; shuffle files go with each written table."""
    ids = [(n, "XAJ25416.1", n % 4, "A", "K") for n in range(1, 41)]
    sets = {k: [n for n, *_ in ids if n % 4 == k] for k in range(4)}
    old = [(k, n) for k in sets for n in sets[k]] + [(5, n) for n in sets[1] if n != 5] + [(6, n) for n in sets[1]] * 2
    old += [(7, 1), (7, None), (None, 1), (8, None), (9, 1)] + [(n, n) for n in range(100, 300)]
    effects = [(k, "e") for k in (0, 1, 5, 7, 8, None)] + [(6, "f"), (2, "f"), (3, None)] + [(n, "e") for n in range(100, 300)]
    frames = {
        "amino_acids": spark.createDataFrame(ids, "id long, gff_feature string, position_aa long, ref_aa string, alt_aa string"),
        "effects": spark.createDataFrame([], "detail string"),
        "papers": spark.createDataFrame([], "id long, authors string, publication_year long, title string"),
        "annotations": spark.createDataFrame(effects, "annotation_id long, effect_detail string"),
        "annotations_amino_acids": spark.createDataFrame(old, "annotation_id long, amino_acid_id long"),
        "annotations_papers": spark.createDataFrame([], "annotation_id long, paper_id long"),
    }
    groups = [("m1", "e", [1]), ("m2", "e", [2]), ("m3", "f", [1]), ("m4", "f", [1, 2]), ("m5", "e", [1, 3])]
    markers = [(f"M1:A{x}K", effect, "t", "a", 2000, m) for m, effect, xs in groups for x in xs]
    schema = "aa_change string, effect_detail string, title string, authors string, publication_year long, marker_id string"
    digested, digest, written, dropped = [], ia._fingerprints, ia.cut, []
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)

    def spied(members, keys):
        if keys == ["annotation_id"]:
            digested.extend(sorted({r.annotation_id for r in members.collect()}))
        return digest(members, keys)

    monkeypatch.setattr(ia, "_fingerprints", spied)
    monkeypatch.setattr(ia, "cut", lambda df, label: dropped.append(spark.conf.get(setting)) or written(df, label))
    loaded = ia.ingest_annotations(Tables(frames), spark.createDataFrame(markers, schema))
    assert digested == [1, 5, 6]
    assert set(dropped) == {"true"} and spark.conf.get(setting) == before
    got = {}
    for r in loaded.annotations_amino_acids.join(loaded.annotations.filter("annotation_id >= 300"), "annotation_id").collect():
        got.setdefault((r.annotation_id, r.effect_detail), []).append(r.amino_acid_id)
    # e: m1 is known by 1; f: m3 is known by 6
    wanted = [("e", sets[2]), ("e", sorted(sets[1] + sets[3])), ("f", sorted(sets[1] + sets[2]))]
    assert sorted((e, sorted(s)) for (_, e), s in got.items()) == sorted(wanted)


def test_known_members_are_distinct_without_a_shuffle_of_pairs(spark, tmp_path):
    """The stored members of the queries are the rows of their SQL, also where keys repeat or are null."""
    part = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    made = [(n, "x", f"b{n % 3}", f"t{n % 3}", n % 5, 1.0) for n in [*range(0, 400, 4), 20, 20, 40]]
    made += [(40, "x", "b", "t0", 1, 1.0), (None, "x", "b", "t0", 1, 1.0), (60, "x", "b", None, 1, 1.0), (60, "x", "b", "t2", None, 1.0)]
    for name in binding.BASE_TABLES:
        if name != "part":
            spark.range(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.createDataFrame(made, part).write.parquet(str(tmp_path / "part.parquet"))
    got = ingest_queries.known_members(spark, str(tmp_path))
    wanted = raw_frame(spark, str(tmp_path), "known_annotation_members")
    assert got.dtypes == wanted.dtypes
    assert rows(got) == rows(wanted) and len(rows(got)) > 30
    single = got._jdf.queryExecution().optimizedPlan().children().head().toString().splitlines()
    assert single[0].startswith("Project") and single[1].startswith("+- Join")


def test_checks_pass_on_clean_tables(tables):
    names = {r.reference: r.n_violations for r in validate.check_all_references(tables).collect()}
    assert set(names.values()) == {0}
    assert validate.check_lineage_cycle(tables.lineages_immediate_children).count() == 0
    assert validate.check_cross_system_edge(tables.lineages_immediate_children, tables.lineages).count() == 0
    assert validate.check_sample_rows(tables.samples).count() == 0


def test_closed_range_touches_the_next(spark):
    ranges = frame(
        spark, "change_id long, lo int, hi int, hi_closed boolean",
        (1, 0, 50, False), (1, 50, 100, False), (2, 0, 50, True), (2, 50, 100, False), (3, 0, 90, False), (3, 10, 20, False), (3, 95, 99, False),
    )
    assert rows(validate.check_bin_overlap(ranges), "change_id", "lo") == [(2, 0), (2, 50), (3, 0), (3, 10)]


CATALOG = "id long, gff_feature string, position_aa int, ref_aa string, alt_aa string"
SCORES = CATALOG.replace("id long, ", "") + ", phenotype_metric_name string, phenotype_metric_assay_type string, value double, input_order long"


def test_looked_up_changes_are_dealt_to_all_tasks(spark):
    rows = spark.createDataFrame([("HA", n, "A", "D", "m", "t", 1.0, n) for n in range(100)], SCORES).coalesce(1)
    catalog = spark.createDataFrame([(n, "HA", n % 100, "A", "D") for n in range(300)], CATALOG)
    found = isc.lookup_equivalent_changes(rows, catalog)
    assert found.count() == 300
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_repeated_scores_are_reduced_before_the_lookup(spark, monkeypatch):
    rows = [("HA", 1, "A", "D", "m", t, float(n), n) for n in range(50) for t in ("t", "s")]
    rows += [("HA", 1, "A", "D", "m", "t", None, 99), ("HA", None, "A", "D", "m", "t", 3.0, 100)]
    frames = {
        "amino_acids": spark.createDataFrame([(n, "HA", 1, "A", "D") for n in range(4)], CATALOG),
        "phenotype_metrics": spark.createDataFrame([], "id long, phenotype_metric_name string, phenotype_metric_assay_type string"),
        "phenotype_metric_values": spark.createDataFrame([(7, 7, 7.0)], "phenotype_metric_id long, amino_acid_id long, value double"),
    }
    met, lookup = [], isc.lookup_equivalent_changes
    monkeypatch.setattr(isc, "lookup_equivalent_changes", lambda some, catalog: met.append(some.count()) or lookup(some, catalog))
    loaded = isc.load_scores(Tables(frames), spark.createDataFrame(rows, SCORES))
    assert met == [2]
    assert sorted(map(tuple, loaded.phenotype_metric_values.collect())) == [(1, n, 49.0) for n in range(4)] + [(7, 7, 7.0)]
    assert [tuple(r) for r in loaded.phenotype_metrics.collect()] == [(1, "m", "s")]


def test_bitmaps_are_made_after_the_shuffle(spark):
    edges = spark.createDataFrame([(n % 3, n * 1000) for n in range(300)] * 2, "change_id long, sample_id long")
    made = ic.carrier_bitmaps(edges)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") > plan.rindex("SortAggregate")
    assert made.agg(F.sum(F.bitmap_count("members"))).first()[0] == 300
