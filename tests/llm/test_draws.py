"""The language model's draws: reproducible whatever the partitions, and distributed as they should be."""

import numpy as np
import pytest

from virosieve.llm import lm_score
from virosieve.llm.pitman_yor import Keyed, Restaurants, Spread


def test_scores_do_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (3, 8):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            rows = lm_score.scored(docs.repartition(parts, "doc_id"), lm_score.held_out()).collect()
            found.append({r["id"]: r["score"] for r in rows})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert set(found[0]) == set(found[1]) and len(found[0]) == docs.count()
    assert max(abs(found[0][i] - found[1][i]) / max(1, abs(found[0][i])) for i in found[0]) < 1e-5


@pytest.mark.parametrize(("n", "p"), [(1, 0.3), (7, 0.9), (40, 0.2), (1000, 0.004), (1000, 0.5), (100_000, 0.3), (50, 0.0), (50, 1.0)])
def test_binomial_draws(n, p):
    rows = np.arange(20_000)
    draws = Keyed(rows, 3).binomial(rows, np.full(len(rows), n), np.full(len(rows), p), 2)
    assert draws.min() >= 0 and draws.max() <= n
    sd = (n * p * (1 - p)) ** 0.5
    assert abs(draws.mean() - n * p) <= 5 * sd / len(rows) ** 0.5 + 1e-9
    assert abs(draws.std() - sd) <= 0.05 * sd + 1e-9


def test_a_rows_draws_do_not_depend_on_its_batch():
    rng = np.random.default_rng(0)
    keys, c, served, base = rng.integers(0, 1 << 60, 500), rng.integers(1, 3000, 500), rng.integers(1, 50, 500).astype(float), rng.random(500) * 0.1

    def tables(some):
        part = Spread(keys[some], served[some], 5)
        part.seat(c[some], base[some])
        for _ in range(6):
            part.move(base[some])
        return part.tables

    whole = tables(np.arange(500))
    halves = np.concatenate([tables(np.arange(0, 500, 2)), tables(np.arange(1, 500, 2))])
    assert (whole[np.concatenate([np.arange(0, 500, 2), np.arange(1, 500, 2)])] == halves).all()


def test_seats_are_like_those_of_one_generator():
    c, base = np.full(3000, 60), np.full(3000, 0.02)
    dealt = Spread(np.arange(3000), np.full(3000, 20.0), 1)
    dealt.seat(c, base)

    class One(Restaurants):
        def _sum(self, values):
            return np.full(3000, 20.0)

    one = One(np.arange(3000), 3000, np.random.default_rng(1))
    one.seat(c, base)
    assert abs(dealt.tables.mean() - one.tables.mean()) < 0.1 * one.tables.mean()


def _texts(spark, parts):
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(f"w{n}" for n in rng.zipf(1.4, 40) % 500)) for i in range(120)]
    return spark.createDataFrame([*rows, (None, ""), (7, None)], "doc_id long, text string").repartition(parts, "doc_id")


def test_pairs_met_once_are_no_rows(spark, monkeypatch):
    rows, cut = {}, lm_score.cut

    def counted(df, label):
        kept = cut(df, label)
        rows[label] = kept.count()
        return kept

    monkeypatch.setattr(lm_score, "cut", counted)
    docs = _texts(spark, 3)
    held = lm_score.held_out()
    assert lm_score.scored(docs, held).count() == 122
    times, words = {}, set()
    for r in docs.filter(~held).collect():
        own = ["", *(r["text"] or "").split(), ""]
        words |= set(own)
        for pair in zip(own, own[1:], strict=False):
            times[pair] = times.get(pair, 0) + 1
    again = sum(c > 1 for c in times.values())
    assert rows["pair-seats"] == again
    assert rows["pairs"] <= again + 3 * len(words) < len(times)  # pairs met again, and words of each of the chunks


def test_scores_do_not_depend_on_buckets(spark, monkeypatch):
    found = []
    for tokens in (20, 1_000_000):
        monkeypatch.setattr(lm_score, "BUCKET_PAIRS", tokens)
        found.append(sorted(tuple(r) for r in lm_score.scored(_texts(spark, 3).filter("doc_id is not null"), lm_score.held_out()).collect()))
    assert found[0] == found[1] and len(found[0]) == 121


@pytest.mark.parametrize("values", [[], [0], [-5, 1 << 62, -(1 << 63), 3], range(1000)])
def test_packed_integers_come_back(values):
    values = np.array(values, np.int64)
    assert (lm_score._restored(lm_score._squeezed(values)) == values).all()
    ascending = np.sort(values.view(np.uint64))
    assert (np.cumsum(lm_score._restored(lm_score._squeezed_steps(ascending)).view(np.uint64)) == ascending).all()
