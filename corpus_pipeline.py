"""The corpus pipeline: filters, deduplicates, decontaminates and encodes ``documents``.

``STAGES`` lists (name, function); each function takes ``(spark, docs, sf_dir)``, works on all rows that the
stage before it kept, and returns a DataFrame. All but the last return the columns of ``documents``. ``run``
writes each stage's rows as Parquet in the shared folder and reads them as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from virosieve.llm import decontaminate, quality_mil, quality_rules, sentencepiece_bpe, simhash
from virosieve.llm.text import table, tokenizer_path
from virosieve.plans.durable import cut

#: Documents that score less go, as the classifier calls them low.
LEAST_QUALITY = 0.5


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far from their language's references go."""
    return quality_rules.kept_rows(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores low go; it learns from all labelled documents, as the rules leave one class."""
    return quality_mil.kept_rows(docs, table(spark, sf_dir, "labels"), LEAST_QUALITY, examples=table(spark, sf_dir, "documents"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, linked by SimHash and then by shared shingles, the document with the least id stays."""
    return simhash.distinct_rows(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's question and answer go."""
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each remaining document, with digests of the ids and of the text decoded from them."""
    model = tokenizer_path("piece_bpe_32k.model")
    rows = sentencepiece_bpe.encoded(docs.select("doc_id", "text"), model, with_decoded=False, carried=["doc_id"])
    return rows.select("row.doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: Model fitting and tokenising have no SQL form; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
