"""Association rules for URLs against a plain miner, with planted labels on the given pages and on odd tables."""

import itertools
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from virosieve.llm import queries, url_filter
from virosieve.llm.url_filter import Mining


def _tokens(url):
    found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (found[1], found[2]) if found else ("", "")
    out = set()
    for mark, text in (("h:", host), ("p:", path)):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        out |= {mark + w for w in re.split(r"[\W_]+", low) if w and not re.fullmatch("[0-9]+", w)}
    return frozenset(out)


def _plain_rules(labelled, options):
    """Every token combination, counted one by one: ``{combination: (confidence, support)}``."""
    n, blocked = len(labelled), sum(b for _, b in labelled)
    if n < options.min_count or not blocked:
        return {}
    met, hit = Counter(), Counter()
    for tokens, b in labelled:
        for size in range(1, len(tokens) + 1):
            for combination in itertools.combinations(sorted(tokens), size):
                met[combination] += 1
                hit[combination] += b
    least = max(options.min_support, options.min_count / n)
    good = {}
    for c, times in hit.items():
        confidence = times / met[c]
        if times / n >= least - 1e-12 and confidence >= options.min_confidence and confidence >= options.min_lift * blocked / n:
            good[c] = (confidence, times / n)
    # idle if a combination with one token less is a rule, too
    return {c: v for c, v in good.items() if not any(tuple(t for t in c if t != left) in good for left in c)}


@pytest.fixture(scope="module")
def planted(spark, sf_dir):
    """The given pages; blocked are those of some hosts and the German pages of blogs, with a few labels turned round."""
    pages = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/pages.parquet").select("page_id", "url")
    rows = pages.collect()
    labels = []
    for page_id, url in rows:
        tokens = _tokens(url)
        bad = bool(tokens & {"h:casino", "h:ads", "h:spam", "h:pills"}) or {"h:blog", "p:de"} <= tokens or "h:m" in tokens
        labels.append((page_id, bad != (page_id % 17 == 0)))
    return pages, rows, spark.createDataFrame(labels, "doc_id long, blocked boolean"), dict(labels)


OPTIONS = Mining(min_count=4, min_confidence=0.6, min_lift=1.2)


def test_rules_are_those_of_a_plain_miner(planted):
    pages, rows, labels, marks = planted
    got = {tuple(sorted(r["antecedent"])): (round(r["confidence"], 9), round(r["support"], 9)) for r in url_filter.mined_rules(pages, labels, options=OPTIONS).collect()}
    want = _plain_rules([(_tokens(url), marks[page_id]) for page_id, url in rows], OPTIONS)
    assert got == {c: (round(a, 9), round(b, 9)) for c, (a, b) in want.items()} and len(got) >= 2


def test_verdicts_follow_fixed_then_mined_rules(planted):
    pages, rows, labels, marks = planted
    rules = _plain_rules([(_tokens(url), marks[page_id]) for page_id, url in rows], OPTIONS)
    got = {r["id"]: r for r in url_filter.judged(pages, labels, options=OPTIONS).collect()}
    fired = 0
    for page_id, url in rows:
        r = got[page_id]
        hit = any(set(c) <= _tokens(url) for c in rules)
        fixed = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}.get(r["rule"])
        fired += hit and fixed is None
        assert r["verdict"] == (fixed or ("block" if hit else "allow"))
    assert fired > 5


def test_labels_come_by_the_number_in_the_url(spark):
    df = spark.createDataFrame([("http://a.b/en/77.html",), ("http://a.b/12/en?x=5",), ("http://a.b/x",), (None,), ("http://a.b/" + "9" * 30,)], "url string")
    assert [r[0] for r in df.select(url_filter.number_in(F.col("url"))).collect()] == [77, 12, None, None, 999999999999999999]


def test_query_gives_hosts_paths_and_rules(spark, sf_dir):
    got = {r["page_id"]: r for r in queries.op3_url_association_rules(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()
    fixed = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    for page_id, url in pages:
        found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (found[1].lower(), found[2]) if found else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in fixed if (host == h or host.endswith("." + h)) and path.startswith(p)]
        r = got[page_id]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fits)[1] if fits else None)
        assert not fits or r["verdict"] == max(fits)[2]


def test_odd_tables(spark):
    schema = "page_id long, url string, set string, blocked string, id long, host string"
    rows = [(1, None, "s", "b", 7, "h"), (2, "no scheme", "s", "b", 7, "h"), (None, "http://x.org/fr/1", "s", "b", 7, "h"), (2, "http://x.net/", "s", "b", 7, "h")]
    pages, labels = spark.createDataFrame(rows, schema), spark.createDataFrame([(1, True), (None, True), (2, None)], "doc_id long, blocked boolean")
    got = sorted((tuple(r) for r in url_filter.judged(pages, labels).collect()), key=str)
    assert got == sorted([(1, "", "", None, "allow"), (2, "", "", None, "allow"), (None, "x.org", "/fr/1", "org/fr/", "allow"), (2, "x.net", "/", "net/", "block")], key=str)
    assert url_filter.judged(pages.limit(0), labels).count() == 0 and url_filter.judged(pages, labels.limit(0)).count() == 4
