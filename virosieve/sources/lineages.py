"""Readers of lineage calls, demixed abundances and the lineage hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from virosieve.sources.delimited import read_delimited, renamed

# Model column -> header, and separator, of the two call layouts.
CALL_LAYOUTS = {
    "genotype_tsv": ({"accession": "sample", "lineage_name": "Genotype"}, "\t"),
    "taxon_csv": ({"accession": "taxon", "lineage_name": "lineage"}, ","),
}

#: Parquet files that hold the names and texts of many demixed files.
PACKED = "*.parquet"


def read_consensus_lineages(spark: SparkSession, paths, layout: str) -> DataFrame:
    """``accession, lineage_name, input_order``."""
    columns, sep = CALL_LAYOUTS[layout]
    return renamed(read_delimited(spark, paths, sep, columns.values()), columns)


def read_demixed_dir(spark: SparkSession, directory: str, malformed: bool = False) -> DataFrame:
    """Abundances from a directory of ``<accession>.demixed`` files. A file is a few lines for one
    sample; the directory may hold very many.

    Files may also lie packed, as a small file fills a whole block of a disk: ``PACKED`` files of the directory
    hold one row ``name, text`` for each, and count as if the files themselves were there.
    """
    single = spark.read.text(directory, wholetext=True, pathGlobFilter="*.demixed").select("_metadata.file_name", "value")
    packed = spark.read.schema("name string, text string").parquet(directory, pathGlobFilter=PACKED)
    packed = packed.filter(F.col("name").endswith(".demixed"))
    files = single.union(packed).select("value", F.regexp_extract("file_name", r"^(.*)\.demixed$", 1).alias("accession"))
    return parse_demixed(files, malformed)


def parse_demixed(files: DataFrame, malformed: bool = False) -> DataFrame:
    """File texts (``accession, value``) to ``accession, lineage_name, abundance, input_order``.

    A file counts only if it has a lineages and an abundances line of equal length, all abundances
    are numbers, and an accession named inside agrees with the file name. ``malformed`` returns the
    other files instead, as ``accession, problem``.
    """
    lines = F.transform(F.split("value", r"\r\n|\r|\n", -1), lambda line: _strip(line))

    def last(prefix: str):
        """Fields of the last line that starts with a word."""
        hits = F.filter(lines, lambda line: F.startswith(line, F.lit(prefix)))
        text = F.element_at(hits, -1)
        rest = _strip(F.substring(text, F.lit(len(prefix) + 1), F.length(text)))
        return F.when(F.size(hits) > 0, F.split(rest, r"\s+", -1))

    others = F.filter(
        lines,
        lambda line: ~F.startswith(line, F.lit("lineages"))
        & ~F.startswith(line, F.lit("abundances"))
        & line.contains("_variants.tsv"),
    )
    named_inside = F.transform(others, lambda line: _strip(F.regexp_replace(line, r"_variants\.tsv\z", "")))
    parsed = files.select(
        "accession", last("lineages").alias("names"), last("abundances").alias("texts"), named_inside.alias("inside")
    ).withColumn("numbers", F.transform("texts", lambda t: t.try_cast("double")))
    problem = (
        F.when(F.exists("inside", lambda a: a != F.col("accession")), "accession differs from the file name")
        .when(F.col("names").isNull(), "no lineages line")
        .when(F.col("texts").isNull(), "no abundances line")
        .when(F.exists("numbers", lambda n: n.isNull()), "an abundance is not a number")
        .when(F.size("names") != F.size("numbers"), "lineages and abundances differ in length")
    )
    if malformed:
        return parsed.select("accession", problem.alias("problem")).filter(F.col("problem").isNotNull())
    good = parsed.filter(problem.isNull())
    pairs = F.posexplode(F.arrays_zip(F.col("names").alias("n"), F.col("numbers").alias("a"))).alias("place", "pair")
    return good.select("accession", pairs).select(
        "accession",
        F.col("pair.n").alias("lineage_name"),
        F.col("pair.a").alias("abundance"),
        F.col("place").alias("input_order"),
    )


def _strip(text):
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def lineage_edges(records: DataFrame) -> DataFrame:
    """``parent_name, child_name`` from records of ``name`` and an optional ``parent``."""
    return records.filter(F.col("parent").isNotNull()).select(
        F.col("parent").alias("parent_name"), F.col("name").alias("child_name")
    )


def read_lineage_edges(spark: SparkSession, paths) -> DataFrame:
    """The hierarchy from JSON lines."""
    return lineage_edges(spark.read.json(paths, schema="name string, parent string"))

