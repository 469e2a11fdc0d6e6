import json
import os

import pytest
from pyspark.sql import functions as F

from virosieve.plans.durable import shared_folder
from virosieve.sources import annotations, changes, lineages, samples, scores, sinks
from virosieve.sources.delimited import HeaderError, read_delimited, scan
from virosieve.workload.source_queries import source_queries

MUTATION_HEADER = list(changes.MUTATION_COLUMNS.values())
CODON_HEADER = list(changes.INTRAHOST_CODON_COLUMNS.values())
NT_HEADER = list(changes.INTRAHOST_NT_COLUMNS.values())


def write(path, rows, sep="\t"):
    path.write_text("\n".join(sep.join(map(str, r)) for r in rows) + "\n")
    return str(path)


def run_row(**values):
    row = {c: "" for c in samples.RUN_COLUMNS}
    row.update(accession="A1", bio_sample_model="m", organism="flu", is_retracted="false")
    row.update(values)
    return row


def test_sample_runs(spark, tmp_path):
    header = [*samples.RUN_COLUMNS.values(), "an extra column"]
    rows = [
        run_row(geo_loc_name="USA/Iowa//", collection_date="2024-02", bases="100", release_date="2024-05-01T10:00:00Z"),
        run_row(accession="A2", geo_loc_name="USA/Iowa"),
        run_row(accession="A3", collection_date="someday"),
        run_row(accession="A4", organism=""),
        run_row(accession="A5", bases="12.5"),
        run_row(accession="A6", is_retracted="TRUE", retraction_detected_date="2024-01-02T03:04:05"),
        run_row(accession="SRR29182450"),
    ]
    lines = [header] + [[*r.values(), "x"] for r in rows]
    got = {r.accession: r for r in samples.read_sample_runs(spark, write(tmp_path / "s.csv", lines, ","), ",").collect()}
    assert set(got) == {"A1", "A2", "A3", "A4", "A5", "A6"}
    assert [a for a in sorted(got) if got[a].malformed] == ["A2", "A4", "A5"]
    first = got["A1"]
    assert (first.country_name, first.admin1_name, first.admin2_name) == ("USA", "Iowa", "")
    assert str(first.collection_start_date) == "2024-02-01" and str(first.collection_end_date) == "2024-02-29"
    assert first.bases == 100 and first.host is None
    assert got["A3"].bad_collection_date and got["A3"].collection_start_date is None and not got["A3"].malformed
    assert got["A6"].is_retracted and str(got["A6"].retraction_detected_date) == "2024-01-02 03:04:05"


def test_sample_runs_need_their_columns(spark, tmp_path):
    path = write(tmp_path / "s.csv", [["Run", "Organism"], ["a", "b"]], ",")
    with pytest.raises(HeaderError, match="BioProject"):
        samples.read_sample_runs(spark, path)


def test_quoted_cells(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('a,b\n"x, ""y""",\n')
    row = read_delimited(spark, str(path), ",", ["a", "b"]).first()
    assert (row.a, row.b) == ('x, "y"', None)


def test_input_order_is_file_order(spark, tmp_path):
    path = write(tmp_path / "o.tsv", [["n"]] + [[i] for i in range(5000)])
    rows = read_delimited(spark, path, "\t", ["n"]).repartition(5).orderBy("input_order").collect()
    assert [int(r.n) for r in rows] == list(range(5000))


def test_bulk_samples(spark, tmp_path):
    rows = [["ID", "host", "collection_date", "location"], ["a", "human", "2024", "USA / Iowa"], ["b", "human", "", "USA"]]
    got = samples.read_bulk_sd(spark, write(tmp_path / "b.tsv", rows)).collect()
    assert [(r.accession, r.country_name, r.admin1_name, r.admin2_name, r.organism) for r in got] == [
        ("a", "USA", "Iowa", None, "NA")
    ]


def test_change_files_are_told_apart(spark, tmp_path):
    mutation = dict.fromkeys(MUTATION_HEADER, "")
    mutation.update(sra="S1", pos="5", ref="A", alt="C", region="HA")
    write(tmp_path / "m1.tsv", [mutation.keys(), mutation.values()])
    backwards = dict(reversed(mutation.items()))
    write(tmp_path / "m2.tsv", [backwards.keys(), backwards.values()])
    codon = dict.fromkeys(CODON_HEADER, "")
    codon.update(GFF_FEATURE="f", POS_CODON="3", REF_CODON="AAA", ALT_CODON="AAC", REF_DEPTH_CODON="9",
                 ALT_DEPTH_CODON="8", ALT_FREQ_CODON="0.5", SRA="S1")
    write(tmp_path / "c.tsv", [codon.keys(), codon.values()])
    found = changes.classify_by_header(spark, str(tmp_path))
    assert {k: len(v) for k, v in found.items()} == {"mutations": 2, "intrahost_nt": 0, "intrahost_codons": 1}
    frames = changes.read_classified(spark, str(tmp_path))
    assert [(r.accession, r.position_nt, r.ref_nt, r.gff_feature) for r in frames["mutations"].collect()] == [
        ("S1", 5, "A", None)
    ] * 2
    assert frames["intrahost_codons"].first().alt_freq == 0.5


def test_unknown_header_is_refused(spark, tmp_path):
    path = write(tmp_path / "m.tsv", [[*MUTATION_HEADER, "more"], ["x"] * 12])
    with pytest.raises(HeaderError):
        changes.classify_by_header(spark, path)
    with pytest.raises(HeaderError):
        changes.read_consensus_mutations(spark, path)


def test_broken_number_fails(spark, tmp_path):
    mutation = dict.fromkeys(MUTATION_HEADER, "x")
    path = write(tmp_path / "m.tsv", [mutation.keys(), mutation.values()])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        changes.read_consensus_mutations(spark, path).collect()


def test_demixed_directory(spark, tmp_path):
    def demixed(name, text):
        (tmp_path / f"{name}.demixed").write_text(text)

    demixed("S1", "\tS1_variants.tsv\nsummarized\t[('Other', 0.9)]\nlineages\tA.1 A.2  A.3\nabundances\t0.5 0.3 2e-1\nresid\t1\n")
    demixed("S2", "\tS9_variants.tsv\nlineages\tA\nabundances\t1\n")
    demixed("S3", "lineages\tA B\nabundances\t1\n")
    demixed("S4", "abundances\t1\n")
    demixed("S5", "lineages\tA\n")
    demixed("S6", "lineages\tA\nabundances\tmany\n")
    demixed("S7", "lineages\tA\nabundances\t1.0\n")
    (tmp_path / "notes.txt").write_text("lineages\tA\nabundances\t1.0\n")
    good = lineages.read_demixed_dir(spark, str(tmp_path)).orderBy("accession", "input_order").collect()
    assert [(r.accession, r.lineage_name, r.abundance) for r in good] == [
        ("S1", "A.1", 0.5), ("S1", "A.2", 0.3), ("S1", "A.3", 0.2), ("S7", "A", 1.0),
    ]
    bad = lineages.read_demixed_dir(spark, str(tmp_path), malformed=True)
    assert {r.accession for r in bad.collect()} == {"S2", "S3", "S4", "S5", "S6"}

def test_demixed_files_packed(spark, tmp_path):
    (tmp_path / "S1.demixed").write_text("lineages\tA B\nabundances\t0.5 0.25\n")
    texts = [("S2.demixed", "\tS2_variants.tsv\r\nlineages\tC\r\nabundances\t1\r\n"), ("S3.demixed", ""), ("S4.txt", "lineages\tX\nabundances\t1\n")]
    spark.createDataFrame(texts, "name string, text string").write.mode("append").parquet(str(tmp_path))
    good = lineages.read_demixed_dir(spark, str(tmp_path)).orderBy("accession", "input_order").collect()
    assert [tuple(r) for r in good] == [("S1", "A", 0.5, 0), ("S1", "B", 0.25, 1), ("S2", "C", 1.0, 0)]
    bad = lineages.read_demixed_dir(spark, str(tmp_path), malformed=True).collect()
    assert [tuple(r) for r in bad] == [("S3", "no lineages line")]


def test_demixed_files_of_the_query_are_few(spark, sf_dir, tmp_path):
    # a file of its own for each sample filled a disk by its blocks
    before = set(os.listdir(shared_folder(spark)))
    rows = source_queries()["src_demixed_dir"](spark, sf_dir)
    samples = rows.select("accession").distinct().count()
    folders = [f for f in set(os.listdir(shared_folder(spark))) - before if f.startswith("demixed")]
    files = [f for folder in folders for f in os.listdir(f"{shared_folder(spark)}/{folder}")]
    assert 0 < sum(f.endswith(".demixed") for f in files) < samples / 50



def test_lineage_files(spark, tmp_path):
    a = write(tmp_path / "a.tsv", [["sample", "Genotype"], ["S1", "B3.13"]])
    b = write(tmp_path / "b.csv", [["taxon", "lineage"], ["S1", "XBB"]], ",")
    assert lineages.read_consensus_lineages(spark, a, "genotype_tsv").first()[:2] == ("S1", "B3.13")
    assert lineages.read_consensus_lineages(spark, b, "taxon_csv").first()[:2] == ("S1", "XBB")
    (tmp_path / "h.json").write_text("\n".join(json.dumps(r) for r in [{"name": "A"}, {"name": "A.1", "parent": "A"}]))
    assert [tuple(r) for r in lineages.read_lineage_edges(spark, str(tmp_path / "h.json")).collect()] == [("A", "A.1")]


def test_wide_scores(spark, tmp_path):
    rows = [
        ["sequential_site", "wildtype", "mutant", "stability", "mouse sera escape", "other"],
        ["5", "A", "K", "1.5", "", "9"],
        ["6", "A", "", "1.5", "2", "9"],
        ["6.0", "A", "K", "1.5", "2", "9"],
        ["7", "A", "D", "n/a", "2", "9"],
    ]
    got = scores.read_scores(spark, write(tmp_path / "d.csv", rows, ","), "ha_csv").collect()
    assert sorted((r.position_aa, r.phenotype_metric_name, r.value) for r in got) == [
        (5, "stability", 1.5), (7, "mouse_sera_escape", 2.0),
    ]
    assert {r.gff_feature for r in got} == {scores.HA}
    with pytest.raises(HeaderError, match="no metric column"):
        scores.read_scores(spark, str(tmp_path / "d.csv"), "ha_csv_neuac_neugc")


def test_evescape_positions_may_be_decimal(spark, tmp_path):
    rows = [["i", "wt", "mut", "GFF_FEATURE", "evescape"], ["5.0", "A", "K", "S", "1"], ["5.5", "A", "K", "S", "1"]]
    got = scores.read_scores(spark, write(tmp_path / "e.csv", rows, ","), "sc2_evescape_csv").collect()
    assert [(r.gff_feature, r.position_aa, r.phenotype_metric_assay_type) for r in got] == [("S", 5, "EVEscape")]


def test_marker_file(spark, tmp_path):
    rows = [list(annotations.MARKER_COLUMNS.values()), ["M1:A3K", "more virulent", "t", "a", "2020", "m1"]]
    row = annotations.read_annotations(spark, write(tmp_path / "f.tsv", rows)).first()
    assert (row.aa_change, row.publication_year, row.marker_id) == ("M1:A3K", 2020, "m1")


def test_conflict_report(spark, tmp_path):
    some = spark.createDataFrame([("ref_nt", "HA", 1, "A", "C")], "field string, region string, position_nt long, alt_nt string, ref string")
    assert sinks.write_conflict_report(some, str(tmp_path / "r")) == 1
    assert spark.read.csv(str(tmp_path / "r"), header=True).first().ref == "C"
    assert sinks.write_conflict_report(some.filter("false"), str(tmp_path / "r2")) == 0
    assert spark.read.text(str(tmp_path / "r2")).first().value == "no conflicts found"


def test_many_files_with_several_headers(spark, tmp_path):
    folders = [tmp_path / str(i) for i in range(5)]
    for folder in folders:
        folder.mkdir()
    for i in range(5000):
        header, row = (["a", "b", "c"], [i, "x", ""]) if i % 3 else (["c", "extra", "b", "a"], ["", "no", "y", i])
        write(folders[i % 5] / f"f{i}.tsv", [header, row, header] if i % 7 == 0 else [header, row])
    got = read_delimited(spark, str(tmp_path), "\t", ["a", "b", "c"])
    seen = got.agg(F.count("*"), F.countDistinct("a"), F.count_if(F.col("b") == "y"), F.count("c"), F.countDistinct("input_order.file")).first()
    assert tuple(seen) == (5000, 5000, 1667, 0, 5000)
    with pytest.raises(HeaderError, match="missing columns"):
        read_delimited(spark, str(tmp_path), "\t", ["a", "extra"])


def test_headers_come_from_tasks(spark, tmp_path, monkeypatch):
    """No file is opened by the driver: the files' headers are rows of a job."""
    for i in range(40):
        write(tmp_path / f"f{i}.tsv", [["a", f"b{i % 4}"], [i, 1]])
    found = scan(spark, str(tmp_path), "\t")
    assert len(found.headers) == 4 and found.firsts.count() == 40
    chosen = found.with_header(found.headers[:1])
    assert chosen.rows(["a"]).count() == 10
    assert found.rows(["a"], ["b1"]).filter("b1 IS NOT NULL").count() == 10


def test_large_files_are_split_and_blank_lines_left_out(spark, tmp_path):
    write(tmp_path / "big.tsv", [["n", "text"]] + [[i, "größe" * 5] for i in range(30_000)] + [[""], ["", ""]])
    write(tmp_path / "small.tsv", [["text", "n"], ["t", 1]])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        rows = read_delimited(spark, str(tmp_path), "\t", ["n", "text"])
        assert rows.select("input_order.block").distinct().count() > 5
        assert tuple(rows.agg(F.count("n"), F.sum(F.col("n").cast("long"))).first()) == (30_001, 30_000 * 29_999 // 2 + 1)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_rejected_scores_are_told(spark, tmp_path):
    rows = [
        ["sequential_site", "wildtype", "mutant", "stability", "mouse sera escape"],
        ["5", "A", "K", "1.5", " "], ["6", "A", "", "1.5", "2"], ["x", "A", "K", "1", "2"], ["7", "A", "D", "n/a", "two"],
    ]
    path = write(tmp_path / "d.csv", rows, ",")
    rejects = scores.read_score_rejects(spark, path, "ha_csv").orderBy("file", "block", "record").collect()
    assert [(r.problem, r.phenotype_metric_name, r.cell) for r in rejects] == [
        (scores.NO_CHANGE, None, "6,A,"), (scores.NO_CHANGE, None, "x,A,K"),
        (scores.NO_NUMBER, "stability", "n/a"), (scores.NO_NUMBER, "mouse_sera_escape", "two"),
    ]
    assert all(r.file.endswith("d.csv") for r in rejects)
    staged = scores.stage_scores(spark, path, "ha_csv", str(tmp_path / "staged"))
    assert (staged.n_scores, staged.n_records_rejected, staged.n_cells_rejected) == (1, 2, 2)
    assert staged.scores.count() == 1 and staged.rejects.count() == 4


def test_cells_are_parsed_before_they_are_filtered(spark, tmp_path):
    path = write(tmp_path / "runs.csv", [samples.RUN_COLUMNS.values(), run_row().values()], ",")
    rows = samples.read_sample_runs(spark, path).filter("not malformed").select("accession", "center_name")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "from_csv" in line]
    assert [r.accession for r in rows.collect()] == ["A1"]


def test_files_of_other_headers_are_not_read_again(spark, tmp_path):
    paths = [write(tmp_path / f"{name} 1.tsv", [header, ["1"] * len(header)]) for name, header in (("m", MUTATION_HEADER), ("c", CODON_HEADER))]
    found = scan(spark, paths, "\t")
    for header in found.headers:
        chosen = found.with_header([header])
        assert chosen.files == [header.example.replace("%20", " ")]
        assert chosen.rows(header.names).count() == 1


def test_differing_headers_need_no_join_of_lines(spark, tmp_path):
    """Files of one header are one scan: lines are neither shuffled by their few files nor parsed once for every cell."""
    write(tmp_path / "a 1.tsv", [["n", "text"], [1, "x"], ["n", "text"], [2, ""]])
    write(tmp_path / "b.tsv", [["text", "more", "n"], ["y", "m", 3]])
    write(tmp_path / "c.tsv", [["n", "text"], [4, "z"]])
    found = scan(spark, str(tmp_path), "\t")
    every = found.rows(["n", "text"], ["more"])
    one = found.with_header([h for h in found.headers if len(h.names) == 2]).rows(["n", "text"])
    for df in (every, one):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan
    got = every.orderBy("input_order").drop("input_order").collect()
    assert [tuple(r) for r in got] == [("1", "x", None), ("2", None, None), ("3", "y", "m"), ("4", "z", None)]
    assert sorted(r.n for r in one.collect()) == ["1", "2", "4"]


def test_files_listed_twice_are_told_apart_by_a_join(spark, tmp_path):
    paths = [write(tmp_path / "a.tsv", [["n", "text"], [1, "x"]]), write(tmp_path / "b.tsv", [["text", "n"], ["y", 2]])]
    found = scan(spark, [*paths, str(tmp_path)], "\t")
    assert found._by_header() is None
    assert {tuple(r) for r in found.rows(["n", "text"]).drop("input_order").collect()} == {("1", "x"), ("2", "y")}
