"""Scores of the language model depend on the order of words."""

import numpy as np
from pyspark.sql import functions as F

from virosieve.llm import lm_score


def test_fluent_scores_above_shuffled(spark):
    rng = np.random.default_rng(6)
    # each word is followed by one of three
    follows = {n: rng.integers(0, 300, 3) for n in range(300)}

    def text():
        at, words = int(rng.integers(0, 300)), []
        for _ in range(60):
            words.append(f"w{at}")
            at = int(rng.choice(follows[at]))
        return words

    texts = [text() for _ in range(260)]
    shuffled = [list(rng.permutation(t)) for t in texts[200:]]
    rows = [(i, " ".join(t)) for i, t in enumerate([*texts, *shuffled])]
    got = {r["id"]: r["score"] for r in lm_score.scored(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 200).collect()}
    assert all(np.isfinite(x) and x < 0 for x in got.values())
    assert sum(got[200 + i] > got[260 + i] + 10 for i in range(60)) == 60


def test_steps_are_a_distribution(spark):
    # after "a", the known words, the end and one unknown word have at most probability one together
    rows = [(0, "a b a b"), (1, "a c"), (2, "b a")] + [(10 + i, f"a {w}") for i, w in enumerate(["a", "b", "c", "zz"])] + [(20, "a")]
    got = {r["id"]: r["score"] for r in lm_score.scored(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 10).collect()}
    assert len(got) == len(rows) and all(np.isfinite(x) and x < 0 for x in got.values())
    assert got[11] > got[10] and got[11] > got[13]
    assert sum(10 ** got[n] for n in (10, 11, 12, 13, 20)) < 1
