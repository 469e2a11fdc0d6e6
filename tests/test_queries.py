"""Every registered query against its SQL counterpart on the smallest tables, and operator rules that
SQL counterparts do not show."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from virosieve.functions.dates import MONTH, WEEK
from virosieve.operators import annotations, counts, lineages, mutations, phenotype, samples, variants, wastewater
from virosieve.workload.checks import compare, connect
from virosieve.workload.registry import all_oracles, all_queries

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, sf_dir, name):
    ok, note = compare(spark, con, sf_dir, QUERIES[name], ORACLES[name])
    assert ok, note


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


def test_nucleotide_counts_take_all_edges(spark, sf_dir):
    # one of five intra-host edges was left out of the code and the SQL alike
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    expected = lines.filter("l_returnflag = 'R'").select("l_partkey", "l_orderkey").distinct().count()
    assert QUERIES["count_variants_by_column_nt"](spark, sf_dir).agg(F.sum("n")).first()[0] == expected


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def as_set(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# search text and the names expected for it, best first; similarities worked out by hand
SEARCHES = [
    ("texas", ["Texas", "New Texas"]),  # substring hits, the earlier one first; Taxes has 3 of 5 letters: 0.6
    (" TEXAZ ", ["Texas"]),  # 4 of 5 letters: 0.8; within New Texas 8/14
    ("ohia", ["Ohio"]),  # 3 of 4 letters: 0.75
    ("io", ["Ohio"]),
    ("zzz", []),
    ("  ", ["New Texas", "Ohio", "Taxes", "Texas"]),  # nothing searched: all, in order
]


@pytest.mark.parametrize(("search", "expected"), SEARCHES)
def test_search(spark, tables, search, expected):
    names = [(i, "USA", name, None, None) for i, name in enumerate(["Texas", "Taxes", "New Texas", "Ohio"])]
    places = spark.createDataFrame(names, tables.geo_locations.schema)
    found = samples.distinct_values_search(tables.replace(geo_locations=places), "admin1_name", search)
    assert [r.value for r in found.collect()] == expected


def test_listed_fields_only(tables):
    with pytest.raises(ValueError):
        samples.distinct_values(tables, "accession")
    with pytest.raises(ValueError):
        samples.distinct_values(tables, "region", "host = 'BUILDING'")


def test_true_filter_changes_nothing(tables):
    for axis in ("nt", "aa"):
        plain = counts.count_variants_by_column(tables, "position_aa" if axis == "aa" else "region", axis)
        same = counts.count_variants_by_column(tables, "position_aa" if axis == "aa" else "region", axis, "id >= 0")
        assert as_set(plain) == as_set(same)
    assert as_set(counts.count_mutations_by_collection_date(tables)) == as_set(
        counts.count_mutations_by_collection_date(tables, where="id >= 0")
    )


def test_filter_is_one_unit_and_and_binds_first(tables):
    where = "host = 'BUILDING' OR host = 'MACHINERY' AND platform = '5-LOW'"
    got = counts.count_samples_by_collection_date(tables, MONTH, where, max_span_days=10)
    narrow = tables.replace(samples=tables.samples.filter("datediff(collection_end_date, collection_start_date) <= 10"))
    want = counts.count_samples_by_collection_date(
        narrow, MONTH, "host = 'BUILDING' OR (host = 'MACHINERY' AND platform = '5-LOW')"
    )
    assert as_set(got) == as_set(want)


def test_column_filters_work_like_text(tables):
    text = counts.sample_counts_by_lineage(tables, "host = 'BUILDING'")
    assert as_set(text) == as_set(counts.sample_counts_by_lineage(tables, F.col("host") == "BUILDING"))


def test_columns_out_of_scope_are_refused(tables):
    with pytest.raises(AnalysisException):
        counts.count_samples_by_column(tables, "host", "lineage_name = 'N3'").collect()
    with pytest.raises(AnalysisException):
        lineages.mutation_incidence(tables, "N3", "consensus", where="country_name = 'ASIA'").collect()
    with pytest.raises(ValueError):
        wastewater.ww_average_abundance(tables, "census_region", where="admin1_name = 'NATION_3'")
    with pytest.raises(ValueError):
        wastewater.ww_average_abundance(tables, "country_name")


def test_empty_subset_gives_no_rows(tables):
    nobody = "host = 'nobody'"
    assert counts.count_variants_by_collection_date(tables, where=nobody).count() == 0
    assert counts.count_variants_by_column(tables, "position_aa", "aa", nobody).count() == 0
    assert lineages.mutation_incidence(tables, "no such lineage", "consensus").count() == 0
    assert phenotype.scored_variants_by_date(tables, "price", 1.0, where=nobody).count() == 0
    assert annotations.annotated_positions_variants(tables, "Brand#12", nobody).count() == 0
    assert phenotype.metric_load_mutations_by_date(tables, "no such metric").count() == 0
    quantile = phenotype.metric_quantile_variants(tables, "no such metric", 0.5).collect()
    assert [tuple(r) for r in quantile] == [(0.5, None)]


def test_sample_counts_dispatch(tables):
    assert as_set(counts.sample_counts(tables, "host")) == as_set(counts.count_samples_by_column(tables, "host"))
    assert as_set(counts.sample_counts(tables, "release_date", WEEK)) == as_set(
        counts.count_samples_by_simple_date(tables, "release_date", WEEK)
    )
    assert as_set(counts.sample_counts(tables, "creation_date,lineage")) == as_set(
        counts.count_lineages_by_simple_date(tables, "creation_date")
    )
    with pytest.raises(NotImplementedError):
        counts.sample_counts(tables, "host,lineage")
    with pytest.raises(ValueError):
        counts.sample_counts(tables, "host,lineage,platform")


def test_null_dates_form_a_bin(tables):
    binned = counts.count_samples_by_simple_date(tables, "creation_date")
    missing = tables.samples.filter("creation_date IS NULL").count()
    assert binned.filter("label IS NULL").first().n == missing > 0


def test_samples_with_two_lineages_count_once_in_load(spark, tables):
    doubled = tables.samples_lineages.unionByName(
        tables.samples_lineages.filter("is_consensus_call").withColumn("lineage_id", F.lit(2000))
    )
    more = tables.replace(samples_lineages=doubled)
    assert as_set(phenotype.metric_load_mutations_by_date(tables, "price")) == as_set(
        phenotype.metric_load_mutations_by_date(more, "price")
    )


def test_cached_sums_give_the_same_load(spark, tables, tmp_path):
    phenotype.write_metric_sum_cache(tables, str(tmp_path / "cache"))
    cached = tables.replace(metric_sum_cache=spark.read.parquet(str(tmp_path / "cache")))
    live = phenotype.metric_load_mutations_by_date(tables, "price").drop("label")
    stored = phenotype.metric_load_mutations_by_date(cached, "price").drop("label")
    for a, b in zip(as_set(live), as_set(stored), strict=True):
        assert a == pytest.approx(b)


def test_filter_on_change_and_sample_together(tables):
    mixed = "position_aa < 20 AND lineage_name = 'N3'"
    got = counts.count_mutations_by_collection_date(tables, where=mixed)
    want = counts.count_mutations_by_collection_date(tables, where="lineage_name = 'N3'").filter("position_aa < 20")
    assert as_set(got) == as_set(want)
    only = counts.count_mutations_by_collection_date(tables, where="position_aa < 20")
    assert as_set(only) == as_set(counts.count_mutations_by_collection_date(tables).filter("position_aa < 20"))


def test_thresholds_are_checked(tables):
    with pytest.raises(ValueError):
        lineages.mutation_incidence(tables, "N3", "consensus", threshold=0.001)
    with pytest.raises(ValueError):
        mutations.mutation_sample_count(tables, "not a change")
    with pytest.raises(ValueError):
        phenotype.metric_quantile_variants(tables, "price", 1.5)
    with pytest.raises(ValueError):
        variants.variant_sample_frequency(tables, "A5B")
