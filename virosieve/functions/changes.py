"""Names of changes, codons, site numbers and frequency bins, as column expressions."""

from __future__ import annotations

import re
from decimal import Decimal
from itertools import chain

from pyspark.sql import Column, functions as F

# The form of a change name, feature:REF<position>ALT.
CHANGE_PATTERN = r"^([\w.-]+):([a-zA-Z])(\d+)([a-zA-Z\-+]+)"

# The standard genetic code, * = stop.
CODON_TABLE = {
    "TTT": "F", "TTC": "F", "TTA": "L", "TTG": "L", "TCT": "S", "TCC": "S", "TCA": "S", "TCG": "S",
    "TAT": "Y", "TAC": "Y", "TAA": "*", "TAG": "*", "TGT": "C", "TGC": "C", "TGA": "*", "TGG": "W",
    "CTT": "L", "CTC": "L", "CTA": "L", "CTG": "L", "CCT": "P", "CCC": "P", "CCA": "P", "CCG": "P",
    "CAT": "H", "CAC": "H", "CAA": "Q", "CAG": "Q", "CGT": "R", "CGC": "R", "CGA": "R", "CGG": "R",
    "ATT": "I", "ATC": "I", "ATA": "I", "ATG": "M", "ACT": "T", "ACC": "T", "ACA": "T", "ACG": "T",
    "AAT": "N", "AAC": "N", "AAA": "K", "AAG": "K", "AGT": "S", "AGC": "S", "AGA": "R", "AGG": "R",
    "GTT": "V", "GTC": "V", "GTA": "V", "GTG": "V", "GCT": "A", "GCC": "A", "GCA": "A", "GCG": "A",
    "GAT": "D", "GAC": "D", "GAA": "E", "GAG": "E", "GGT": "G", "GGC": "G", "GGA": "G", "GGG": "G",
}

# Frequency bins.
N_FREQ_BINS = 20


def parse_change(name: Column) -> Column:
    """``PB1-F2:V56A`` to ``struct<feature, ref, position, alt>``; null unless the whole text fits."""
    whole = CHANGE_PATTERN + r"\z"
    fields = F.struct(
        F.regexp_extract(name, whole, 1).alias("feature"),
        F.regexp_extract(name, whole, 2).alias("ref"),
        F.regexp_extract(name, whole, 3).try_cast("bigint").alias("position"),
        F.regexp_extract(name, whole, 4).alias("alt"),
    )
    return F.when(name.rlike(whole), fields)


def split_change(name: str) -> tuple[str, str, int, str]:
    """The same for one literal name, as an operator parameter."""
    match = re.fullmatch(CHANGE_PATTERN, name)
    if match is None:
        raise ValueError(f"not a change name: {name!r}")
    feature, ref, position, alt = match.groups()
    return feature, ref, int(position), alt


def clean_feature_name(name: Column) -> Column:
    """``HA:cds-X.1``, ``cds-X.1`` and ``HA:X.1`` all give ``X.1``."""
    bare = F.when(name.contains(":"), F.split_part(name, F.lit(":"), F.lit(2))).otherwise(name)
    return F.replace(bare, F.lit("cds-"))


def translate_codon(codon: Column) -> Column:
    """Amino acid of a codon: X when any base is N, null when the codon is not one of the 64."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(CODON_TABLE.items())])
    return F.when(codon.contains("N"), F.lit("X")).otherwise(F.try_element_at(table, codon))


def mature_to_sequential(position: Column) -> Column:
    """Mature HA site to sequential site; null outside the mature numbering."""
    return F.when(position.between(-16, -1), position + 17).when(position.between(1, 552), position + 16)


def freq_bin(freq: Column, n_bins: int = N_FREQ_BINS) -> Column:
    """Index of the frequency bin; 1.0 belongs to the last bin, values outside [0, 1] to none.

    Decimal arithmetic, so that a value on a boundary lands above it.
    """
    if 1000 % n_bins:
        raise ValueError(f"{n_bins} bins do not have bounds in whole thousandths")
    exact = freq.cast("decimal(20,10)")
    index = F.least(F.floor(exact * n_bins).cast("int"), F.lit(n_bins - 1))
    return F.when(exact.between(0, 1), index)


def bin_lower(index: Column, n_bins: int = N_FREQ_BINS) -> Column:
    return (index.cast("decimal(6,0)") * Decimal(1000 // n_bins) / Decimal(1000)).cast("decimal(6,3)")


def bin_upper(index: Column, n_bins: int = N_FREQ_BINS) -> Column:
    return bin_lower(index + 1, n_bins)


def bin_midpoint(index: Column, n_bins: int = N_FREQ_BINS) -> Column:
    return ((index * 2 + 1) / F.lit(2 * n_bins)).cast("double")


def bin_text(index: Column, n_bins: int = N_FREQ_BINS) -> Column:
    """``[0.05,0.1)``, and ``[0.95,1]`` for the closed last bin."""

    def short(bound: Column) -> Column:
        trimmed = F.rtrim(bound.cast("string"), F.lit("0"))
        return F.rtrim(trimmed, F.lit("."))

    lower = F.when(index == 0, F.lit("0")).otherwise(short(bin_lower(index, n_bins)))
    close = F.when(index == n_bins - 1, F.lit("]")).otherwise(F.lit(")"))
    return F.concat(F.lit("["), lower, F.lit(","), short(bin_upper(index, n_bins)), close)


def freq_overlap(low: float | None, high: float | None, index="freq_bin", n_bins: int = N_FREQ_BINS) -> Column | None:
    """Bins that overlap the closed window [low, high]; an open bound is None.

    Only the bin index is compared, so the predicate reaches the scan of the edge table.
    """
    index = index if isinstance(index, Column) else F.col(index)
    tests = []
    if high is not None:
        # lower bound of the bin <= high
        last = int((Decimal(str(high)) * n_bins).__floor__())
        tests.append(index <= last)
    if low is not None:
        # upper bound of the bin > low; the last bin is closed and also takes low = 1
        low_exact = Decimal(str(low)) * n_bins
        first = int(low_exact.__floor__())
        if low_exact == n_bins:
            first = n_bins - 1
        tests.append(index >= first)
    if not tests:
        return None
    return tests[0] if len(tests) == 1 else tests[0] & tests[1]
