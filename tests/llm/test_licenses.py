"""The licence scan against a plain regular-expression version, its expressions, and odd tables."""

import regex
import pytest
from pyspark.sql import functions as F

from virosieve.llm import licenses, queries

WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


def _plain(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for i in range(len(words)) for p, label in PHRASES.items() if tuple(words[i : i + len(p)]) == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_query_matches_plain_version(spark, sf_dir):
    got = {r["doc_id"]: r for r in queries.op13_license_scan(spark, sf_dir).collect()}
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(texts)
    for doc_id, text in texts:
        r = got[doc_id]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == _plain(text)
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "")
    assert any(r["n_base"] for r in got.values())


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("CC-BY cc by CC\nBY ccby cc  by", [(0, "cc-by"), (2, "cc-by"), (4, "cc-by"), (7, "cc-by")]),
        ("cc by cc by", [(0, "cc-by"), (2, "cc-by")]),
        ("GNU Affero General Public License", [(1, "agpl"), (2, "gpl")]),
        ("çcc by, ÀLL rights reserved", []),
        ("x All Rights Reserved.", [(1, "reserved")]),
    ],
)
def test_places_of_phrases(text, wanted):
    n, found = licenses.scan(text)
    assert n == _plain(text)[0]
    assert [(start, label) for start, _, label, _, _ in found] == wanted


@pytest.mark.parametrize(
    ("line", "wanted"),
    [
        (" MIT", ({"mit"}, 0)),
        (" MIT OR GPL-3.0-only", ({"mit", "gpl-3.0-only"}, 0)),
        (" MIT AND GPL-3.0-only", ({"mit", "gpl-3.0-only"}, 2)),
        (" MIT OR GPL-2.0-only AND CC-BY-NC-4.0", ({"mit", "gpl-2.0-only", "cc-by-nc-4.0"}, 0)),
        (" (MIT OR GPL-2.0-only) AND CC-BY-NC-4.0", ({"mit", "gpl-2.0-only", "cc-by-nc-4.0"}, 3)),
        (" GPL-2.0-only WITH Classpath-exception-2.0", ({"gpl-2.0-only"}, 1)),
        (" GPL-2.0-only WITH Classpath-exception-2.0 AND MIT OR AGPL-3.0", ({"gpl-2.0-only", "mit", "agpl-3.0"}, 1)),
        (" ((Apache-2.0))", ({"apache-2.0"}, 0)),
        (" MIT OR", ({"mit"}, 0)),
        (" MIT see file", ({"mit"}, 0)),
        (" MIT) OR (ISC", ({"mit"}, 0)),
        (" (MIT OR ISC", None),
        (" OR MIT", None),
        (" see the file", None),
        ("", None),
        (" MIT+ */", ({"mit"}, 0)),
        (" unknown-1 AND MIT", ({"mit"}, 3)),
    ],
)
def test_expressions(line, wanted):
    got = licenses.evaluate(line)
    assert (got if got is None else (set(got[0]), got[1])) == wanted


def test_deep_and_long_expressions():
    assert licenses.evaluate("(" * 50_000 + "MIT" + ")" * 50_000) == (frozenset({"mit"}), 0)
    assert licenses.evaluate(" OR ".join(["GPL-2.0-only"] * 20_000 + ["ISC"]))[1] == 0


def test_tags_are_placed_by_word():
    text = "one two\n# SPDX-License-Identifier: MIT OR ISC\nsublicense: ISC.\nA License: see file\nlicence: zlib"
    _, found = licenses.scan(text)
    assert [(s, e, label, kind) for s, e, label, kind, _ in found] == [(2, 5, "isc", "tag"), (2, 5, "mit", "tag"), (14, 15, "zlib", "tag")]


def test_odd_tables(spark):
    long = "all rights reserved " * 50_000
    rows = [(None, "CC BY", 1, "p"), (1, None, 2, "p"), (2, "", 3, "p"), (3, long, 4, "p"), (4, "cc by", 5, "p"), (4, "cc by", 5, "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long, places string")
    got = licenses.scanned(docs)
    by_id = {r["id"]: r for r in got.collect()}
    assert got.count() == 6 and set(by_id) == {None, 1, 2, 3, 4}
    assert by_id[1]["n_words"] == by_id[2]["n_words"] == 0 and by_id[1]["places"] == []
    assert by_id[3]["n_words"] == 150_000 and len(by_id[3]["places"]) == 50_000 and by_id[3]["places"][-1]["start"] == 149_997
    assert got.select(licenses.confidence(F.col("places")).alias("c")).filter("c = 0.6").count() == 4
    assert licenses.scanned(docs.limit(0)).count() == 0
