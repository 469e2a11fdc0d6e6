"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from virosieve.llm import chat, decontaminate, language_id, lm_score, quality_mil, quality_rules, sentencepiece_bpe, simhash, token_files, url_filter
from virosieve.llm.text import tokenizer_path
from virosieve.plans.durable import fresh_path

LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(30_000))
# clashing names: columns that operators use inside
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, score double, kept boolean, fp long, words string"
TEXTS = [None, "", " \n\t ", "Hello", "a b", LONG, "Größe und Übermut, sagt man.", "the cat sat on the mat " * 20, "the cat sat on the mat " * 20, "日本語 テスト 123", "x\x00y ▁ z  ", "🙂" * 50]


def _rows(texts):
    return [(i if i != 6 else None, t, None if i % 3 == 0 else "en", "s", 1, 7, "r", 0.5, True, 3, "w") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = _rows(TEXTS)
    return spark.createDataFrame([*rows, rows[7], rows[4]], COLUMNS)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def test_fingerprints_of_odd_texts(odd, empty):
    got = {(r["id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(odd).collect()}
    assert got[(0, 0)] == got[(1, 0)] == got[(2, 0)] == 0  # without words
    hello = int.from_bytes(__import__("xxhash").xxh64_digest(b"hello", 42), "big", signed=True)
    assert (3, hello) in got
    assert len({c for (i, _), c in got.items() if i in (7, 8)}) == 1
    assert simhash.near_duplicates(odd).count() == odd.count()
    assert simhash.near_duplicates(empty).count() == 0


def test_similar_texts_of_odd_tables(odd, empty):
    kept = simhash.distinct_rows(odd).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [0, 3, 4, 5, 7, 9, 10, 11]
    assert [r["text"] for r in kept if r["doc_id"] is None] == [TEXTS[6]]
    assert simhash.distinct_rows(odd).columns == odd.columns
    assert simhash.distinct_rows(empty).count() == 0


def test_rules_on_odd_texts(odd, empty):
    rows = {r["row"]["doc_id"]: r for r in quality_rules.judged(odd).collect()}
    assert len(rows) == len(TEXTS) and quality_rules.judged(odd).count() == odd.count()
    assert rows[0]["n_words"] == 0 and rows[0]["base_failed"] and not rows[0]["kept"]
    assert rows[5]["n_words"] == 60_000 and rows[5]["n_repeat_words"] == 0 or rows[5]["n_repeat_words"] > 0
    assert rows[7]["n_repeat_words"] == 120
    assert quality_rules.kept_rows(odd).columns == odd.columns
    assert quality_rules.judged(empty).count() == 0


def test_classifier_on_odd_texts(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (5, 1, None), (7, 0, 1), (None, 1, 0), (8, None, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality_mil.fit(odd, labels)
    rows = quality_mil.scored(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in quality_mil.scored(odd, quality_mil.fit(odd, labels.limit(0))).collect()} == {0.5}
    assert quality_mil.scored(empty, model).count() == 0
    assert quality_mil.kept_rows(odd, labels).columns == odd.columns


def test_language_of_odd_texts(odd, empty):
    model = language_id.learn(odd)
    rows = {r["row"]["doc_id"]: r for r in language_id.predicted(odd, model).collect()}
    assert rows[0]["lang_pred"] == rows[1]["lang_pred"] == rows[2]["lang_pred"] == "und"
    assert rows[7]["lang_pred"] == "en" and rows[7]["score"] == 1.0
    assert rows[11]["lang_pred"] == "und"  # no letter
    nothing = language_id.learn(empty)
    assert {r["lang_pred"] for r in language_id.predicted(odd, nothing).collect()} == {"und"}
    assert language_id.predicted(empty, model).count() == 0


def test_token_files_of_odd_texts(spark, odd, empty):
    path = tokenizer_path("word_bpe_49k.json")
    out = token_files.read(spark, token_files.write(odd, path, fresh_path(spark, "t")), digests=True).collect()
    tokenizer = Tokenizer.from_file(path)
    rows = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    start, want = 0, []
    for r in rows:
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in out), key=lambda r: r[1]) == want
    assert token_files.read(spark, token_files.write(empty, path, fresh_path(spark, "t"))).count() == 0


def test_sentencepiece_of_odd_texts(odd, empty):
    path = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = sentencepiece_bpe.encoded(odd, path).collect()
    assert len(rows) == odd.count()
    for r in rows:
        ids = [*library.encode(r["row"]["text"] or ""), 2]
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids) and r["decoded"] == library.decode(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert sentencepiece_bpe.encoded(empty, path).count() == 0


def test_items_in_odd_texts(spark, odd, empty):
    items = spark.createDataFrame([(1, "the cat sat on the mat the cat. Sat on the mat the cat"), (2, None), (None, "hello"), (3, ""), (4, "Hello"), (4, "a b"), (4, "a b")], "item_id long, text string")
    rows = decontaminate.matched(odd, items).select("row.doc_id", F.explode("matches.item_id").alias("i")).collect()
    assert sorted((r["doc_id"], r["i"]) for r in rows) == [(3, 4), (4, 4), (4, 4), (7, 1), (7, 1), (8, 1)]
    assert decontaminate.clean_rows(odd, items.limit(0)).count() == odd.count()
    assert decontaminate.clean_rows(empty, items).count() == 0
    assert decontaminate.clean_rows(odd, items).columns == odd.columns


def test_scores_of_odd_texts(odd, empty):
    held = F.coalesce(F.col("doc_id"), F.lit(0)) == 9
    rows = lm_score.scored(odd, held).collect()
    assert len(rows) == odd.count()
    by = {r["id"]: r for r in rows}
    assert by[0]["n_tokens"] == 1 and by[0]["n_known"] == 1 and np.isfinite(by[0]["score"])
    assert by[9]["n_tokens"] == 4 and by[9]["n_known"] == 1
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert {r["train_tokens"] for r in lm_score.scored(odd, F.lit(True)).collect()} == {0}
    assert lm_score.scored(empty, held).count() == 0


def test_urls_of_odd_tables(spark):
    pages = spark.createDataFrame([(1, None), (None, "http://A.Example.NET/en/x?y"), (2, "nope"), (2, "https://x.org/fr/"), (3, "a://net"), (4, "a://x.notnet/en")], "page_id long, url string")
    labels = spark.createDataFrame([(1, True), (None, False), (2, None)], "doc_id long, blocked boolean")
    rows = url_filter.judged(pages, labels).collect()
    assert sorted((r["id"] or 0, r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in rows) == [
        (0, "a.example.net", "/en/x", "example.net/en/", "allow"),
        (1, "", "", "", "allow"),
        (2, "", "", "", "allow"),
        (2, "x.org", "/fr/", "org/fr/", "allow"),
        (3, "net", "", "", "allow"),
        (4, "x.notnet", "/en", "", "allow"),
    ]
    assert url_filter.judged(pages.limit(0), labels.limit(0)).count() == 0


def test_conversations_of_odd_tables(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (None, None, None, None), (2, None, "x", "é")], "conv_id long, turn long, role string, text string")
    record = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    formatted = chat.format_records(rows.withColumn("json", record))
    got = {r["conv_id"]: r for r in chat.digests(chat.parsed(formatted)).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 2
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nb\nassistant\nb\n").hexdigest()
    assert got[None]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest()
    assert chat.digests(chat.parsed(chat.format_records(rows.limit(0).withColumn("json", record)))).count() == 0


RECORDS = {
    "plain": ('{"messages": [{"role": "user", "content": "a"}, {"role": "bot", "content": "b"}]}', [("user", "a"), ("assistant", "b")]),
    "extra field": ('{"messages": [{"role": "user", "content": "a"}], "source": "x"}', [("user", "a")]),
    "extra in message": ('{"messages": [{"role": "human", "name": "n", "content": "a"}, {"role": "gpt", "content": null}]}', [("user", "a"), ("assistant", "")]),
    "extra in both": ('{"id": 3, "meta": {"k": [1]}, "instruction": "i", "input": "", "output": "o"}', [("user", "i"), ("assistant", "o")]),
    "no output text": ('{"question": "q", "answer": null, "score": 0.5}', [("user", "q"), ("assistant", "")]),
    "no messages": ('{"messages": []}', "no turns"),
    "list for text": ('{"prompt": ["a"], "completion": "b"}', "no known layout"),
    "two layouts": ('{"question": "q", "answer": "a", "prompt": "p", "completion": "c", "x": 1}', "no known layout"),
    "half": ('{"question": "q", "x": 1}', "no known layout"),
    "bad": ('{"question": ', "no JSON"),
    "null": (None, "no JSON"),
    "text": ('"hello"', "no known layout"),
}


def test_records_of_any_layout_are_formatted_or_reported(spark):
    rows = spark.createDataFrame([(name, json, "l", 5, i) for i, (name, (json, _)) in enumerate(RECORDS.items())], "name string, json string, layout string, turns int, conv_id long")
    found = {r["row"]["name"]: r for r in chat.canonical(rows).collect()}
    reported = {r["row"]["name"]: r["problem"] for r in chat.rejected(rows).collect()}
    for name, (_, wanted) in RECORDS.items():
        if isinstance(wanted, str):
            assert reported.pop(name) == wanted and not found[name]["turns"], name
        else:
            assert [(t["role"], t["text"]) for t in found[name]["turns"]] == wanted, name
        # the caller's own columns of these names stay
        assert found[name]["row"]["layout"] == "l" and found[name]["row"]["turns"] == 5
    assert not reported
    formatted = chat.format_records(rows, turn_column="turns")
    assert formatted.select("conv_id").distinct().count() == 5
    assert chat.rejected(rows.limit(0)).count() == 0


def test_all_languages_are_learned_and_judged(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{i:03}": [letters[i % 26] + letters[i // 26 % 26] + w for w in ("ab", "cd", "ef", "gh", "ij")] for i in range(230)}
    rows = [(10 * i + k, " ".join(w * (k + 12)), lang) for i, (lang, w) in enumerate(words.items()) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.predicted(docs, language_id.learn(docs), with_spans=False).collect()
    right = sum(r["lang_pred"] == r["row"]["lang"] for r in found)
    assert len(found) == len(rows) and right >= 0.98 * len(rows)
    # in one pass, and in passes of a hundred languages each
    one = quality_rules.judged(docs, limits=quality_rules.Limits(min_reference_words=50, max_repeat_percent=1000))
    several = quality_rules.judged(docs, limits=quality_rules.Limits(min_reference_words=50, max_repeat_percent=1000, max_languages=100))
    key = lambda df: sorted((r["row"]["doc_id"], r["kept"], round(r["word_distance"], 9), round(r["class_distance"], 9)) for r in df.collect())
    assert key(one) == key(several) and len(key(one)) == len(rows)


def test_the_classifiers_sample_bounds_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_mil, "fit_arrays", lambda bags, marks: seen.append(len(bags)))
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "the same")] * 500 + [(3, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    quality_mil.fit(docs, labels, sample=20)
    quality_mil.fit(docs.filter("doc_id > 1"), labels, sample=20)
    assert seen == [20, 2]
