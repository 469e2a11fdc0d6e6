"""Collocations against a plain count of all phrases, on odd tables and with a full filter."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest

from virosieve.llm import collocations


def _plain(rows, least, top):
    counts, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, 6):
                counts.update((lang, *words[i : i + size]) for i in range(len(words) - size + 1))
    frequent = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    found = collections.defaultdict(list)
    for (lang, *words), a in frequent.items():
        if any(
            len(p) > len(words) + 1 and p[0] == lang and b >= a and any(list(p[1:])[i : i + len(words)] == words for i in range(len(p)))
            for p, b in frequent.items()
        ):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[(lang, *words[:k])], counts[(lang, *words[k:])]
            cuts.append((1000 * a * total[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found[lang].append((-score, -a, " ".join(words).encode(), left, right))
    out = []
    for lang, phrases in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(phrases)[:top]):
            out.append((lang, rank + 1, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def _rows(rng, n):
    vocabulary = ["a", "B", "c-d", "größe", "日本", "é", "E", "x\x00y", "the", "of", "(k)", " "]
    gaps = [" ", " ", " ", " ", "\t", "  ", ", ", ".", "\n", "; ", "\x0b", "?! "]
    rows = []
    for _ in range(n):
        size = int(rng.integers(0, 40))
        words, between = rng.choice(len(vocabulary), size, p=np.array([5, 4, 4, 3, 3, 1, 1, 1, 5, 5, 1, 1]) / 34), rng.choice(len(gaps), size)
        rows.append((["en", "de", None, "und"][int(rng.integers(0, 4))], "".join(vocabulary[w] + gaps[g] for w, g in zip(words, between, strict=True))))
    return rows


SCHEMA = "lang string, text string, n long, w1 string, phrase string, rank string"


@pytest.fixture(scope="module")
def odd():
    rows = _rows(np.random.default_rng(3), 300)
    return [*rows, *rows[:40], ("en", None), ("en", ""), (None, " \t\n."), ("fr", "one two"), ("en", "the of a b " * 5000), ("xx", "y " * 300)]


@pytest.mark.parametrize(("least", "top"), [(3, 50), (12, 7), (100, 2000)])
def test_phrases_match_a_plain_count(spark, odd, least, top):
    docs = spark.createDataFrame([(*r, 1, "w", "p", "r") for r in odd], SCHEMA).repartition(4)
    got = sorted(tuple(r) for r in collocations.mined(docs, least=least, top=top).collect())
    assert got == _plain(odd, least, top) and got


def test_results_do_not_depend_on_the_filter_or_on_batches(spark, odd, monkeypatch):
    docs = spark.createDataFrame([(*r, 1, "w", "p", "r") for r in odd], SCHEMA)
    monkeypatch.setattr(collocations, "frequent_pairs", lambda texts, least: np.full(1 << (collocations.FILTER_BITS - 3), 255, np.uint8))
    got = sorted(tuple(r) for r in collocations.mined(docs, least=5, top=40).collect())
    assert got == _plain(odd, 5, 40)


def test_long_texts_are_cut_where_pieces_end(monkeypatch):
    monkeypatch.setattr(collocations, "BATCH", 50)
    text = "größe one two. three, four" * 40 + "x" * 500 + " end"
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], ["lang", "text"])
    parts = [t[0].as_py() for _, t in collocations._parts(iter([batch]))]
    assert "".join(parts) == text and len(parts) > 10
    assert all(p[-1] in ".,;:!?\n" for p in parts[:-1])


def test_large_counts_are_scored_exactly(spark):
    big = 3_000_000_000_000_001
    rows = [("en", 0, "", 7 * big), ("en", 1, "a", big + 5), ("en", 1, "b", big + 9), ("en", 2, "a b", big)]
    got = collocations.scored(spark.createDataFrame(rows, "lang string, size int, phrase string, f long")).collect()
    assert [(r["score"], r["l"], r["r"]) for r in got] == [(1000 * big * 7 * big // ((big + 5) * (big + 9)), big + 5, big + 9)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert collocations.mined(docs).count() == 0
    assert collocations.mined(spark.createDataFrame([("en", "a b", 1, "", "", "")], SCHEMA)).count() == 0
