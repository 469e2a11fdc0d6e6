"""One sample or one change holds a large share of all edges."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from virosieve.functions.dates import MONTH
from virosieve.operators import annotations, counts, lineages, phenotype
from virosieve.plans.durable import cut

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1000",
}


def _cited(tables):
    return tables.annotations_papers.agg(F.min("annotation_id")).first()[0]


@pytest.fixture(scope="module")
def hot(spark, tables):
    """The small tables, plus a sample that carries, and a change that is carried, very often."""
    n = 30000
    filler = spark.range(n).select((F.col("id") + 1_000_000).alias("id"))
    amino_acids = tables.amino_acids.unionByName(
        filler.select(
            "id", F.lit("LARGE").alias("gff_feature"), F.col("id").cast("int").alias("position_aa"), F.lit("A").alias("ref_aa"),
            F.lit("K").alias("alt_aa"), F.lit("r0").alias("ref_codon"), F.concat(F.lit("c"), "id").alias("alt_codon"), F.col("id").alias("canonical_id"),
        )
    )
    hot_sample = filler.select(F.col("id").alias("change_id"), F.lit(8).cast("bigint").alias("sample_id"))
    annotated = tables.annotations_amino_acids.unionByName(
        filler.select(F.lit(_cited(tables)).alias("annotation_id"), F.col("id").alias("amino_acid_id"))
    )
    values = tables.phenotype_metric_values.unionByName(
        filler.select(F.lit(2).alias("phenotype_metric_id"), F.col("id").alias("amino_acid_id"), F.lit(20.0).alias("value"))
    )
    edges = cut(tables.cns_aa.unionByName(hot_sample).distinct().repartition(8))
    return tables.replace(
        amino_acids=cut(amino_acids),
        cns_aa=edges,
        cns_aa_by_sample=edges,  # the same edges in both layouts
        annotations_amino_acids=cut(annotated),
        phenotype_metric_values=cut(values),
    )


@pytest.fixture
def sorted_joins(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run(df):
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_hot_sample_is_split_and_counted_whole(hot, sorted_joins):
    query = counts.count_mutations_by_collection_date(hot, MONTH, "aa")
    rows, plan = run(query)
    assert "skew=true" in plan
    edges = hot.cns_aa.join(hot.amino_acids.withColumnRenamed("id", "change_id"), "change_id")
    dated = hot.samples.filter("collection_end_date - collection_start_date <= interval 366 days")
    pairs = edges.join(dated.select(F.col("id").alias("sample_id")), "sample_id")
    pairs = pairs.select("gff_feature", "ref_aa", "position_aa", "alt_aa", "sample_id").distinct().collect()
    want = Counter(tuple(r)[:4] for r in pairs)
    got = Counter()
    for r in rows:
        got[(r.gff_feature, r.ref_aa, r.position_aa, r.alt_aa)] += r.n
    assert got == want


def test_hot_sample_in_a_lineage_subset_is_split(hot, sorted_joins):
    _, plan = run(phenotype.scored_mutations_by_date(hot, "signed_size", 10.0))
    assert "skew=true" in plan
    own = hot.samples_lineages.filter("sample_id = 8 AND is_consensus_call").join(hot.named_lineages, "lineage_id")
    rows, plan = run(lineages.mutation_incidence(hot, own.first().lineage_name, "consensus", "aa", 0.01))
    assert "skew=true" in plan
    assert len(rows) >= 30000


def test_annotations_with_a_hot_sample(hot, sorted_joins):
    effect = _cited(hot).split("/")[0]
    rows, plan = run(annotations.annotation_proportion_mutations_by_date(hot, effect))
    assert "skew=true" in plan
    assert all(0 <= r.n <= r.n_total for r in rows)
    assert max(r.n_total for r in rows) > 30000
