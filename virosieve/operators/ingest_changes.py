"""Ingest of consensus and intra-host changes: filters, catalogs and carrier edges."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F

from virosieve.functions.changes import N_FREQ_BINS, freq_bin, translate_codon
from virosieve.operators import upkeep
from virosieve.operators.common import AA, NT
from virosieve.operators.ingest_samples import drop_null_ref
from virosieve.plans import buckets
from virosieve.plans.durable import cut
from virosieve.plans.ids import assign_ids, highest
from virosieve.plans.joins import join_null_safe
from virosieve.tables import Tables, path_exists

# Quality thresholds of intra-host calls.
MIN_FREQ = 0.02
MIN_DEPTH = 10

ALLELE_KEY = ("region", "position_nt", "alt_nt")
AMINO_ACID_KEY = ("gff_feature", "position_aa", "alt_aa", "alt_codon")
_AMINO_ACID_COLUMNS = (*AMINO_ACID_KEY, "ref_aa", "ref_codon")


def filter_intrahost_nt(rows: DataFrame, min_freq: float = MIN_FREQ, min_depth: int = MIN_DEPTH) -> DataFrame:
    """Real changes with enough gap-corrected frequency and depth. An unknown depth passes."""
    deep = F.coalesce(F.col("gapped_dp") >= min_depth, F.lit(True))
    return rows.filter((F.col("alt_nt") != F.col("ref_nt")) & (F.col("gapped_freq") >= min_freq) & deep)


def filter_intrahost_codons(rows: DataFrame, min_freq: float = MIN_FREQ, min_depth: int = MIN_DEPTH) -> DataFrame:
    """Real codon changes with enough frequency and depth."""
    return rows.filter(
        (F.col("alt_codon") != F.col("ref_codon")) & (F.col("alt_freq") >= min_freq) & (F.col("alt_dp") >= min_depth)
    )


# --- catalogs ----------------------------------------------------------------------------------


def staged_alleles(mutations: DataFrame, ih_nts: DataFrame, existing: DataFrame) -> DataFrame:
    """(region, position, ref, alt) of both inputs whose key, which leaves ref out, is not yet known."""
    columns = ["region", "position_nt", "ref_nt", "alt_nt"]
    staged = mutations.select(*columns).unionByName(ih_nts.select(*columns)).distinct()
    return staged.join(existing.select(*ALLELE_KEY), list(ALLELE_KEY), "left_anti")


def build_allele_catalog(mutations: DataFrame, ih_nts: DataFrame, existing: DataFrame) -> DataFrame:
    """New alleles under new ids. Of several refs for one key the smallest is kept."""
    staged = staged_alleles(mutations, ih_nts, existing)
    new = staged.groupBy(*ALLELE_KEY).agg(F.min("ref_nt").alias("ref_nt"))
    return assign_ids(new, ALLELE_KEY, highest(existing))


def _conflicts(staged: DataFrame, key, fields) -> DataFrame:
    """One row per (field, key, ref) of the keys that come with more than one ref in a field. Keys in
    conflict are found from the smallest and largest ref, so no list of refs is ever built."""
    flags = [(F.min(f) != F.max(f)).alias(f"__{f}") for f in fields]
    any_flag = reduce(or_, [F.col(f"__{f}") for f in fields])
    several = staged.groupBy(*key).agg(*flags).filter(any_flag)
    refs = F.array(
        *[F.struct(F.lit(f).alias("field"), F.col(f).alias("ref"), F.col(f"__{f}").alias("differs")) for f in fields]
    )
    rows = staged.join(several, list(key)).select(*key, F.explode(refs).alias("r")).filter("r.differs")
    return rows.select(F.col("r.field").alias("field"), *key, F.col("r.ref").alias("ref")).distinct()


def allele_ref_conflicts(mutations: DataFrame, ih_nts: DataFrame, existing: DataFrame) -> DataFrame:
    """New alleles whose inputs disagree on the ref, with every ref they come with."""
    return _conflicts(staged_alleles(mutations, ih_nts, existing), ALLELE_KEY, ["ref_nt"])


def staged_amino_acids(ih_codons: DataFrame, mutations: DataFrame, existing: DataFrame) -> DataFrame:
    """Amino-acid changes of both inputs whose key is not yet known. Codon records are translated,
    after they have been reduced to distinct codon changes; codons that mean nothing drop out."""
    codons = ih_codons.select("gff_feature", "position_aa", "alt_codon", "ref_codon").distinct()
    translated = codons.select(
        "*", translate_codon(F.col("alt_codon")).alias("alt_aa"), translate_codon(F.col("ref_codon")).alias("ref_aa")
    ).select(*_AMINO_ACID_COLUMNS)
    both = translated.unionByName(mutations.select(*_AMINO_ACID_COLUMNS)).na.drop().distinct()
    return both.join(existing.select(*AMINO_ACID_KEY), list(AMINO_ACID_KEY), "left_anti")


def build_amino_acid_catalog(ih_codons: DataFrame, mutations: DataFrame, existing: DataFrame) -> DataFrame:
    """New amino-acid changes under new ids; the smallest (ref aa, ref codon) pair is kept."""
    staged = staged_amino_acids(ih_codons, mutations, existing)
    new = staged.groupBy(*AMINO_ACID_KEY).agg(F.min(F.struct("ref_aa", "ref_codon")).alias("__ref"))
    return assign_ids(new.select(*AMINO_ACID_KEY, "__ref.*"), AMINO_ACID_KEY, highest(existing))


def with_canonical_ids(new: DataFrame, existing: DataFrame, reading) -> DataFrame:
    """New catalog rows with ``canonical_id``: the smallest id of the changes that read the same.

    Ids grow with every load, so rows that are stored keep theirs: a new change takes that of a stored
    one that reads the same, or the smallest among the new ones.
    """
    reading = list(reading)
    known = existing.groupBy(*reading).agg(F.min("canonical_id" if "canonical_id" in existing.columns else "id").alias("__known"))
    fresh = new.groupBy(*reading).agg(F.min("id").alias("__fresh"))
    ids = join_null_safe(fresh, known, reading, "left")
    ids = ids.select(*reading, F.coalesce("__known", "__fresh").alias("canonical_id"))
    return join_null_safe(new, ids, reading)


def amino_acid_ref_conflicts(ih_codons: DataFrame, mutations: DataFrame, existing: DataFrame) -> DataFrame:
    """New amino-acid changes whose inputs disagree on the ref codon or on the ref amino acid."""
    staged = staged_amino_acids(ih_codons, mutations, existing)
    return _conflicts(staged, AMINO_ACID_KEY, ["ref_codon", "ref_aa"])


# --- carriers ----------------------------------------------------------------------------------


def with_sample_ids(records: DataFrame, samples: DataFrame) -> DataFrame:
    """The records of known samples, with ``sample_id`` in place of the accession."""
    ids = samples.select("accession", F.col("id").alias("sample_id"))
    return records.join(ids, "accession").drop("accession")


def _edges(records: DataFrame, catalog: DataFrame, key, samples: DataFrame | None, extra=()) -> DataFrame:
    """Distinct edges of records: the catalog gives the change id, the accession the sample id, unless the
    records have it already (no ``samples``).

    Records are first reduced to the columns of the edge. The catalog is joined on its whole key and
    samples on their unique accession, so neither join multiplies rows.
    """
    changes = catalog.select(F.col("id").alias("change_id"), *key)
    slim = records.select("sample_id" if samples is None else "accession", *key, *extra).join(changes, list(key))
    if samples is not None:
        slim = with_sample_ids(slim, samples)
    return slim.select("change_id", "sample_id", *extra).distinct()


def carriers_cns_allele(mutations: DataFrame, alleles: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    return _edges(mutations, alleles, ALLELE_KEY, samples)


def carriers_cns_amino_acid(mutations: DataFrame, amino_acids: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    return _edges(mutations.filter(F.col("ref_aa").isNotNull()), amino_acids, AMINO_ACID_KEY, samples)


def assign_freq_bin(rows: DataFrame, freq: str, n_bins: int = N_FREQ_BINS) -> DataFrame:
    """The frequency bin by arithmetic; no join with a table of ranges."""
    return rows.withColumn("freq_bin", freq_bin(F.col(freq), n_bins))


def carriers_ih_allele(ih_nts: DataFrame, alleles: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    binned = assign_freq_bin(ih_nts, "gapped_freq").filter(F.col("freq_bin").isNotNull())
    return _edges(binned, alleles, ALLELE_KEY, samples, ["freq_bin"])


def carriers_ih_amino_acid(ih_codons: DataFrame, amino_acids: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Codon records name no amino acid, so the key is (feature, position, alt codon)."""
    binned = assign_freq_bin(ih_codons, "alt_freq").filter(F.col("freq_bin").isNotNull())
    return _edges(binned, amino_acids, ("gff_feature", "position_aa", "alt_codon"), samples, ["freq_bin"])


def carrier_union_merge(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored and new edges as one set; nothing is ever removed. Stored edges are a set already: only
    the new ones are made distinct, and those not stored yet are added."""
    fresh = incoming.select(*stored.columns).distinct().join(stored, stored.columns, "left_anti")
    return stored.unionByName(fresh.select(*stored.columns))


def transpose_carriers(edges: DataFrame) -> DataFrame:
    """The edges as sample to changes, for the layout that is clustered by sample."""
    return edges.select("sample_id", "change_id")


def carrier_bitmaps(edges: DataFrame) -> DataFrame:
    """Optional compact form: the carriers of a change as bitmaps of at most 4 KiB, one per 32768
    sample ids. The bucket is part of the key, so a change with many carriers spreads over many rows.

    Edges are dealt by key first: they are shuffled and sorted as ids, and each bitmap is made once.
    """
    dealt = edges.select("change_id", "sample_id", F.bitmap_bucket_number("sample_id").alias("bucket")).repartition("change_id", "bucket")
    return dealt.groupBy("change_id", "bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("sample_id")).alias("members"))


# --- one load ----------------------------------------------------------------------------------

EDGES = ("cns_nt", "cns_aa", "ih_nt", "ih_aa")


def load_changes(tables: Tables, mutations: DataFrame, ih_nts: DataFrame, ih_codons: DataFrame, root: str,
                 n_buckets: int = buckets.BUCKETS) -> Tables:
    """One load of raw change records into the tables stored below ``root``.

    Catalogs come first and only grow, then the carriers that refer to them: edges by change, edges by
    sample, and, where they are stored, the derived tables (see ``upkeep``). Tables below ``root`` are
    changed in place, in those buckets that the load touches; others are made from ``tables`` and the
    load. Every step can be run again: a load that was cut short is repeated as a whole, which
    finds its part of the catalogs and edges and adds the rest.
    """
    spark = mutations.sparkSession

    def stored(name: str) -> DataFrame | None:
        if path_exists(spark, f"{root}/{name}"):
            return buckets.read(spark, f"{root}/{name}")
        return tables[name] if name in tables else None

    def grown(name: str, columns: list[str], reading, build) -> DataFrame:
        """A catalog with its new rows added."""
        path = f"{root}/{name}"
        old = stored(name)
        if "canonical_id" not in old.columns:
            old = with_canonical_ids(old.select(*columns), old.limit(0), reading)
        new = cut(build(old).select(*columns), name)
        new = cut(with_canonical_ids(new, old, reading).select(*columns, "canonical_id"), name)
        if not path_exists(spark, path):
            new = old.select(*new.columns).unionByName(new)
        new.write.mode("append").parquet(path)
        return spark.read.schema(new.schema).parquet(path)

    def merged(name: str, incoming: DataFrame, key: str, combine) -> DataFrame:
        path = f"{root}/{name}"
        if path_exists(spark, path):
            buckets.merge(spark, path, incoming, key, combine, written=True)
            return buckets.read(spark, path)
        old = stored(name)
        return buckets.create(incoming if old is None else combine(old, incoming), path, key, n_buckets)

    # Text is parsed and filtered and samples are looked up once; the steps below read columns of the staged records.
    known = cut(tables.samples.select("id", "accession"), "known-samples")
    mutations = with_sample_ids(drop_null_ref(mutations).select("accession", *ALLELE_KEY, "ref_nt", *_AMINO_ACID_COLUMNS), known)
    mutations = cut(mutations, "staged-mutations")
    ih_nts = filter_intrahost_nt(ih_nts).select("accession", *ALLELE_KEY, "ref_nt", "gapped_freq")
    ih_nts = cut(with_sample_ids(ih_nts, known), "staged-nucleotides")
    codon_columns = ["gff_feature", "position_aa", "alt_codon", "ref_codon", "alt_freq"]
    ih_codons = filter_intrahost_codons(ih_codons).select("accession", *codon_columns)
    ih_codons = cut(with_sample_ids(ih_codons, known), "staged-codons")

    allele_columns = ["id", "region", "position_nt", "ref_nt", "alt_nt"]
    alleles = grown("alleles", allele_columns, NT.columns, lambda old: build_allele_catalog(mutations, ih_nts, old))
    aa_columns = ["id", *_AMINO_ACID_COLUMNS]
    amino_acids = grown("amino_acids", aa_columns, AA.columns, lambda old: build_amino_acid_catalog(ih_codons, mutations, old))

    incoming = {
        "cns_nt": carriers_cns_allele(mutations, alleles),
        "cns_aa": carriers_cns_amino_acid(mutations, amino_acids),
        "ih_nt": carriers_ih_allele(ih_nts, alleles),
        "ih_aa": carriers_ih_amino_acid(ih_codons, amino_acids),
    }
    incoming = {name: cut(edges, f"incoming-{name}") for name, edges in incoming.items()}
    edges = {}
    for name in EDGES:
        edges[name] = merged(name, incoming[name], "change_id", carrier_union_merge)
        # made from the edges by change where it is new
        layout, source = f"{name}_by_sample", incoming[name]
        if not path_exists(spark, f"{root}/{layout}"):
            edges[layout] = buckets.create(edges[name], f"{root}/{layout}", "sample_id", n_buckets)
        else:
            edges[layout] = merged(layout, source, "sample_id", carrier_union_merge)
    loaded = tables.replace(alleles=alleles, amino_acids=amino_acids, **edges)
    return _keep_up(loaded, incoming, root)


def _keep_up(tables: Tables, incoming: dict[str, DataFrame], root: str) -> Tables:
    """The derived tables below ``root``, brought up to a load's new edges."""
    spark = tables.samples.sparkSession
    derived = {}
    path = f"{root}/first_seen"
    if path_exists(spark, path):
        fresh = upkeep.first_seen_rows(tables, incoming["cns_aa"], incoming["ih_aa"])
        buckets.merge(spark, path, fresh, "lineage_id", upkeep.merge_first_seen)
        derived["first_seen"] = buckets.read(spark, path)
    for name, edges, number in (
        ("metric_sum_cache", "cns_aa", "n_scored_mutations"),
        ("variant_sum_cache", "ih_aa", "n_scored_variants"),
    ):
        path = f"{root}/{name}"
        if not path_exists(spark, path):
            continue
        samples = incoming[edges].select("sample_id").distinct()
        own = buckets.read_touched(spark, f"{root}/{edges}_by_sample", samples, "sample_id")
        fresh = upkeep.score_sums(tables, own, number, samples)
        # edges are only ever added, so a touched sample with rows before has rows again
        buckets.merge(spark, path, fresh, "sample_id", lambda old, new: upkeep.replace_samples(old, new, new))
        derived[name] = buckets.read(spark, path)
    return tables.replace(**derived)


def store_derived(tables: Tables, root: str, n_buckets: int = buckets.BUCKETS) -> Tables:
    """Make the derived tables of all edges below ``root``; later loads keep them up."""
    made = {
        "first_seen": (upkeep.first_seen_rows(tables, tables.cns_aa, tables.ih_aa), "lineage_id"),
        "metric_sum_cache": (upkeep.score_sums(tables, tables.cns_aa, "n_scored_mutations"), "sample_id"),
        "variant_sum_cache": (upkeep.score_sums(tables, tables.edges_of_samples("ih_aa"), "n_scored_variants"), "sample_id"),
    }
    return tables.replace(**{name: buckets.create(rows, f"{root}/{name}", key, n_buckets) for name, (rows, key) in made.items()})


def by_change(edges: DataFrame) -> DataFrame:
    """File layout for look-ups by change. The range is over both columns, so a change with very many
    carriers spreads over several files."""
    return edges.repartitionByRange("change_id", "sample_id").sortWithinPartitions("change_id", "sample_id")


def by_sample(edges: DataFrame) -> DataFrame:
    """File layout for look-ups by sample."""
    return edges.repartitionByRange("sample_id", "change_id").sortWithinPartitions("sample_id", "change_id")
