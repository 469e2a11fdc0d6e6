"""The pipeline's classifier learns from both classes, whatever the rules left."""

from pyspark.sql import functions as F

import corpus_pipeline
from virosieve.llm import quality_mil


def test_low_quality_that_passes_the_rules_goes(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").filter("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # all that is left to learn from is good; the low documents are none that any model learned from
    chosen = labels.filter(F.col("quality") == 1).union(labels.filter(F.col("quality") == 0).filter(quality_mil.held_out("doc_id")))
    given = docs.join(chosen.select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    left = corpus_pipeline.quality_classifier_stage(spark, given, sf_dir).join(chosen, "doc_id").groupBy("quality").count()
    kept, all_ = ({r["quality"]: r["count"] for r in df.collect()} for df in (left, chosen.join(docs, "doc_id", "left_semi").groupBy("quality").count()))
    print("kept", kept, "of", all_)
    assert all_[0] > 0 and kept.get(0, 0) <= 0.1 * all_[0] and kept[1] >= 0.9 * all_[1]
