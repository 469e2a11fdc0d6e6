import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from virosieve.plans.closure import reachable, transitive_closure
from virosieve.plans.durable import cut, shared_folder
from virosieve.plans.ids import assign_ids, highest
from virosieve.plans.joins import join_null_safe
from virosieve.plans.quantiles import QUARTILES, exact_quantiles, few_valued_quantiles

NAMES = ["q1", "median", "q3"]


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with a third of all rows, one constant group, one tiny group, nulls and repeats."""
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 1000 == 1, "tiny").when(F.col("id") % 7 == 2, "same")
        .otherwise(F.concat(F.lit("g"), (F.col("id") % 10).cast("string"))).alias("g"),
        (F.pmod(F.xxhash64("id"), F.lit(5000)) / 7.0).alias("v"),
    )
    df = df.withColumn("v", F.when(F.col("g") == "same", 1.5).when(F.rand(3) < 0.01, None).otherwise(F.col("v")))
    return cut(df)


def expected(skewed, q, discrete):
    out = {}
    pdf = skewed.toPandas().dropna()
    for g, part in pdf.groupby("g"):
        v = np.sort(part.v.to_numpy())
        out[g] = [v[max(math.ceil(p * len(v)), 1) - 1] if discrete else np.quantile(v, p) for p in q]
    return out


@pytest.mark.parametrize("discrete", [False, True])
def test_exact_quantiles(skewed, discrete):
    q = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    names = [f"c{i}" for i in range(len(q))]
    rows = exact_quantiles(skewed, ["g"], "v", q, names, discrete).collect()
    want = expected(skewed, q, discrete)
    assert len(rows) == len(want)
    for r in rows:
        assert [r[n] for n in names] == pytest.approx(want[r.g], abs=1e-9), r.g


def test_ungrouped_quantile(skewed):
    values = skewed.toPandas().v.dropna().to_numpy()
    assert list(exact_quantiles(skewed, [], "v", QUARTILES, NAMES).first()) == pytest.approx(list(np.quantile(values, QUARTILES)))


def test_a_group_spans_ranges_and_no_plan_holds_it(skewed, spark):
    found = exact_quantiles(skewed, ["g"], "v", QUARTILES, NAMES)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "collect_" not in plan and "array" not in plan
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = {r.g: list(r)[1:] for r in exact_quantiles(skewed, ["g"], "v", QUARTILES, NAMES).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert spread == {r.g: list(r)[1:] for r in found.collect()}


def test_no_rows_give_no_group(skewed):
    none = skewed.filter("g = 'nobody'")
    assert exact_quantiles(none, ["g"], "v", QUARTILES, NAMES).count() == 0


def test_few_valued_quantiles(skewed):
    whole = skewed.select("g", F.floor("v").alias("v"))
    a = {r.g: list(r)[1:] for r in few_valued_quantiles(whole, ["g"], "v", QUARTILES, NAMES).collect()}
    b = {r.g: list(r)[1:] for r in exact_quantiles(whole, ["g"], "v", QUARTILES, NAMES).collect()}
    assert a.keys() == b.keys()
    for g in a:
        assert a[g] == pytest.approx(b[g])


def test_ids_are_dense_and_repeatable(spark):
    rows = spark.range(5000).select((F.col("id") * 7).cast("string").alias("a"), (F.col("id") % 3).alias("b"))
    first = {(r.a, r.b): r.id for r in assign_ids(rows.repartition(7), ["a", "b"], F.lit(100)).collect()}
    second = {(r.a, r.b): r.id for r in assign_ids(rows.repartition(3, "b"), ["a", "b"], F.lit(100)).collect()}
    assert first == second
    assert sorted(first.values()) == list(range(101, 5101))


def test_highest_of_nothing(spark):
    empty = spark.range(0)
    assert spark.range(1).select(highest(empty).alias("h")).first().h == 0


def closure(spark, edges):
    df = spark.createDataFrame(edges, "parent_id long, child_id long")
    rows = [tuple(r) for r in transitive_closure(df).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_closure_of_diamond_and_chain(spark):
    assert closure(spark, [(1, 2), (1, 3), (2, 4), (3, 4)]) == {(1, 2), (1, 3), (2, 4), (3, 4), (1, 4)}
    chain = [(i, i + 1) for i in range(20)]
    assert closure(spark, chain) == {(i, j) for i in range(21) for j in range(i + 1, 21)}


def test_closure_ends_on_a_cycle(spark):
    assert closure(spark, [(1, 2), (2, 3), (3, 1)]) == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3)}


def test_null_safe_join(spark):
    a = spark.createDataFrame([("x", None), ("y", 1)], "k string, n int")
    b = spark.createDataFrame([("x", None, 5), ("y", 2, 6)], "k string, n int, v int")
    assert [tuple(r) for r in join_null_safe(a, b, ["k", "n"]).collect()] == [("x", None, 5)]
    assert [tuple(r) for r in join_null_safe(a, b, ["k", "n"], "left_anti").collect()] == [("y", 1)]


def test_reachable_nodes(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 8)], "parent_id long, child_id long")
    roots = spark.createDataFrame([(2,)], "n long")
    assert sorted(r.n for r in reachable(edges, roots, "n").collect()) == [1, 2, 3, 4]
    assert reachable(edges, roots.limit(0), "n").count() == 0


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "yarn"

    class Session:
        sparkContext = Context()
        conf = spark.conf

    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    with pytest.raises(RuntimeError):
        shared_folder(Session())
