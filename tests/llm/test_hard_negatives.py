"""Strassen's products, mergeable heaps, and hard negatives of odd tables against a plain search."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from virosieve.llm import hard_negatives
from virosieve.llm.hard_negatives import Heaps, Mining, strassen


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 70), st.integers(0, 70), st.integers(0, 70), st.sampled_from([3, 1000, 1 << 28]), st.integers(0, 9))
def test_products_are_exact(n, k, m, size, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-size, size + 1, (n, k)), rng.integers(-size, size + 1, (k, m))
    wanted = a.astype(object) @ b.astype(object) if k else np.zeros((n, m), object)
    got = strassen(a, b, leaf=2)
    assert got.dtype == np.int64 and got.shape == (n, m) and (got == wanted).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-4, 4), st.integers(0, 30)), max_size=80), st.integers(1, 6), st.integers(1, 80))
def test_heaps_merge_to_the_best(rows, k, step):
    heaps = Heaps(4, k)
    for at in range(0, len(rows), step):
        heaps.push(*(np.array(c, np.int64) for c in zip(*rows[at : at + step], strict=True)))
    got = list(zip(heaps.key.tolist(), heaps.score.tolist(), heaps.id.tolist(), strict=True))
    wanted = []
    for key in range(4):
        wanted += sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))[:k]
    assert got == wanted


def _plain(rows, anchors, options):
    """A plain search over Python integers; ``rows`` are (id, label, vector)."""
    good = []
    for i, label, vector in rows:
        if i is None or label is None or vector is None or not all(x is not None and np.isfinite(x) for x in vector):
            continue
        good.append((i, label, [int(np.floor(options.scale * float(x))) for x in vector]))
    first = {}
    for i, label, vector in good:
        if i in anchors:
            first[i] = min(first.get(i, (label, vector)), (label, vector))
    out = []
    for anchor, (label, vector) in first.items():
        scored = [(sum(x * y for x, y in zip(vector, v, strict=False)), i, at) for i, at, v in good]
        best = sorted(((s, i) for s, i, at in scored if at == label and i != anchor), key=lambda p: (-p[0], p[1]))
        for score, positive in best[: options.positives]:
            inside = [(s, i) for s, i, at in scored if at != label and options.least * score <= 100 * s <= options.most * score]
            for rank, (s, i) in enumerate(sorted(inside, key=lambda p: (-p[0], p[1]))[: options.negatives]):
                out.append((anchor, positive, rank + 1, i, score, s))
    return sorted(out)


SCHEMA = "id long, label int, vector array<double>, score long, rank string"


@pytest.fixture(scope="module")
def odd():
    rng = np.random.default_rng(5)
    rows = [(int(i), int(rng.integers(0, 3)), rng.normal(size=int(rng.integers(0, 9))).round(1).tolist()) for i in range(150)]
    rows += rows[:20] + [(0, 1, [0.5] * 4), (0, 2, [0.25]), (5, 1, rows[6][2])]  # repeated rows and ids, ties
    rows += [(None, 1, [1.0]), (200, None, [1.0]), (210, 1, None), (220, 1, [1.0, None]), (230, 1, [float("nan")]), (240, 1, [float("inf")]), (250, 0, [])]
    return rows


@pytest.mark.parametrize("slab_bytes", [1, 200, 1 << 20])
def test_odd_rows_match_a_plain_search(spark, odd, slab_bytes):
    rows = spark.createDataFrame([(*r, 0, "r") for r in odd], SCHEMA).repartition(5)
    options = Mining(positives=3, negatives=4)
    got = hard_negatives.mined(rows, F.col("id") % 40 == 0, options, slab_bytes)
    assert sorted(tuple(r) for r in got.collect()) == _plain(odd, {0, 40, 80, 120, 200, 240}, options)


def test_many_ties_and_tiles(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 2, rng.integers(-1, 2, 3).astype(float).tolist()) for i in range(5000)]
    options = Mining()
    got = hard_negatives.mined(spark.createDataFrame(rows, "id long, label int, vector array<double>"), F.col("id") < 3, options)
    assert sorted(tuple(r) for r in got.collect()) == _plain(rows, {0, 1, 2}, options)


def test_empty_and_too_large(spark, odd):
    rows = spark.createDataFrame([(*r, 0, "r") for r in odd], SCHEMA)
    assert hard_negatives.mined(rows.limit(0), F.col("id") == 0).count() == 0
    assert hard_negatives.mined(rows, F.lit(False)).count() == 0
    huge = spark.createDataFrame([(0, 1, [1e15]), (1, 1, [1e15])], "id long, label int, vector array<double>")
    with pytest.raises(Exception, match="too large"):
        hard_negatives.mined(huge, F.col("id") == 0).count()
