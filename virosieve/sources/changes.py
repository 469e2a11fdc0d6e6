"""Readers of consensus and intra-host change files, told apart by their header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from virosieve.sources.delimited import DelimitedFiles, Header, HeaderError, cast_columns, renamed, scan

# Model column -> header of consensus mutation files.
MUTATION_COLUMNS = {
    "accession": "sra",
    "position_nt": "pos",
    "ref_nt": "ref",
    "alt_nt": "alt",
    "region": "region",
    "gff_feature": "GFF_FEATURE",
    "ref_codon": "ref_codon",
    "alt_codon": "alt_codon",
    "ref_aa": "ref_aa",
    "alt_aa": "alt_aa",
    "position_aa": "pos_aa",
}
MUTATION_TYPES = {"position_nt": "bigint", "position_aa": "bigint"}

# Model column -> header of intra-host nucleotide files.
INTRAHOST_NT_COLUMNS = {
    "region": "REGION",
    "position_nt": "POS",
    "ref_nt": "REF",
    "alt_nt": "ALT",
    "ref_dp": "REF_DP",
    "ref_rv": "REF_RV",
    "ref_qual": "REF_QUAL",
    "alt_dp": "ALT_DP",
    "alt_rv": "ALT_RV",
    "alt_qual": "ALT_QUAL",
    "alt_freq": "ALT_FREQ",
    "total_dp": "TOTAL_DP",
    "pval": "PVAL",
    "pass_qc": "PASS",
    "gff_feature": "GFF_FEATURE",
    "ref_codon": "REF_CODON",
    "ref_aa": "REF_AA",
    "alt_codon": "ALT_CODON",
    "alt_aa": "ALT_AA",
    "position_aa": "POS_AA",
    "gapped_freq": "GAPPED_FREQ",
    "gapped_dp": "GAPPED_DEPTH",
    "flagged_pos": "FLAGGED_POS",
    "amp_masked": "AMP_MASKED",
    "std_dev": "STD_DEV",
    "amp_freq": "AMP_FREQ",
    "amp_numbers": "AMP_NUMBERS",
    "accession": "SRA",
}
INTRAHOST_NT_TYPES = {
    "position_nt": "bigint",
    "ref_dp": "int",
    "ref_rv": "int",
    "ref_qual": "double",
    "alt_dp": "int",
    "alt_rv": "int",
    "alt_qual": "double",
    "alt_freq": "double",
    "total_dp": "int",
    "pval": "double",
    "pass_qc": "boolean",
    "position_aa": "bigint",
    # decimal: bin bounds must be met exactly
    "gapped_freq": "decimal(20,10)",
    "gapped_dp": "int",
    "flagged_pos": "boolean",
    "amp_masked": "boolean",
    "std_dev": "double",
    "amp_freq": "double",
    "amp_numbers": "int",
}

# Model column -> header of intra-host codon files.
INTRAHOST_CODON_COLUMNS = {
    "gff_feature": "GFF_FEATURE",
    "position_aa": "POS_CODON",
    "ref_codon": "REF_CODON",
    "alt_codon": "ALT_CODON",
    "ref_dp": "REF_DEPTH_CODON",
    "alt_dp": "ALT_DEPTH_CODON",
    "alt_freq": "ALT_FREQ_CODON",
    "position_nt": "POS",
    "ref_nt": "REF",
    "alt_nt": "ALT",
    "accession": "SRA",
}
INTRAHOST_CODON_TYPES = {"position_aa": "bigint", "ref_dp": "int", "alt_dp": "int", "alt_freq": "double"}

RECORD_TYPES = {
    "mutations": (MUTATION_COLUMNS, MUTATION_TYPES),
    "intrahost_nt": (INTRAHOST_NT_COLUMNS, INTRAHOST_NT_TYPES),
    "intrahost_codons": (INTRAHOST_CODON_COLUMNS, INTRAHOST_CODON_TYPES),
}

SEPARATOR = "\t"


def _type_of(header: Header) -> str:
    """The record type whose columns a header has, in any order and no others."""
    for record_type, (columns, _) in RECORD_TYPES.items():
        if set(header.names) == set(columns.values()) and len(header.names) == len(columns):
            return record_type
    raise HeaderError(f"{header.example}: the header fits no record type: {list(header.names)}")


def _by_type(files: DelimitedFiles) -> dict[str, list[Header]]:
    by_type: dict[str, list[Header]] = {name: [] for name in RECORD_TYPES}
    for header in files.headers:
        by_type[_type_of(header)].append(header)
    return by_type


def classify_by_header(spark: SparkSession, paths) -> dict[str, dict[str, tuple[str, ...]]]:
    """Files per record type, with their header. The header must be exactly that of one type, in any
    order. The files are listed here one by one; reading them needs no such list."""
    files = scan(spark, paths, SEPARATOR)
    by_type, names = _by_type(files), {h.text: h.names for h in files.headers}
    found: dict[str, dict[str, tuple[str, ...]]] = {name: {} for name in RECORD_TYPES}
    type_of = {header.text: record_type for record_type, headers in by_type.items() for header in headers}
    for file, text in files.firsts.orderBy("file").collect():
        found[type_of[text]][file] = names[text]
    return found


def _typed(files: DelimitedFiles, record_type: str) -> DataFrame:
    columns, types = RECORD_TYPES[record_type]
    return cast_columns(renamed(files.rows(columns.values()), columns).drop("input_order"), types)


def _read(spark, paths, record_type: str) -> DataFrame:
    files = scan(spark, paths, SEPARATOR)
    files.check(RECORD_TYPES[record_type][0].values(), exact=True)
    return _typed(files, record_type)


def read_consensus_mutations(spark: SparkSession, paths) -> DataFrame:
    return _read(spark, paths, "mutations")


def read_intrahost_nt(spark: SparkSession, paths) -> DataFrame:
    return _read(spark, paths, "intrahost_nt")


def read_intrahost_codons(spark: SparkSession, paths) -> DataFrame:
    return _read(spark, paths, "intrahost_codons")


def read_classified(spark: SparkSession, paths) -> dict[str, DataFrame]:
    """One frame per record type present among mixed files."""
    files = scan(spark, paths, SEPARATOR)
    return {t: _typed(files.with_header(headers), t) for t, headers in _by_type(files).items() if headers}
