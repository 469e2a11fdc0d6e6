"""Operators without SQL against plain versions on the small tables, and planted cases."""

import collections
import zlib

import numpy as np
import pytest
import regex
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from virosieve.llm import decontaminate, language_id, lm_score, oracles, queries, rans, simhash, url_filter
from virosieve.llm.sentencepiece_bpe import Encoder
from virosieve.llm.text import tokenizer_path, words_of
from virosieve.workload.checks import compare, connect

QUERIES = queries.llm_queries()


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(oracles.llm_oracles()))
def test_query_matches_sql(spark, sf_dir, name):
    ok, note = compare(spark, connect(sf_dir), sf_dir, QUERIES[name], oracles.llm_oracles()[name])
    assert ok, note


def _linked(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


def test_links_within_three_bits(spark):
    rng = np.random.default_rng(4)
    fps = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 60)]
    for start in fps[:12]:  # chains and dense groups around some of them
        at = start
        for k in range(12):
            flips = rng.choice(64, size=1 + k % 4, replace=False)
            near = at
            for bit in flips.tolist():
                near ^= simhash._signed(1 << bit)
            fps.append(near)
            at = near if k % 3 == 0 else start
    fps = sorted(set(fps))
    values = np.array(fps, np.int64).view(np.uint64)
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if int(values[i] ^ values[j]).bit_count() <= 3]
    edges = [(r.u, r.v) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]
    place = {f: i for i, f in enumerate(fps)}
    assert all(int(values[place[u]] ^ values[place[v]]).bit_count() <= 3 for u, v in edges)
    assert _linked(len(fps), [(place[u], place[v]) for u, v in edges]) == _linked(len(fps), pairs)


def test_fingerprints(spark, sf_dir, docs):
    got = {r["doc_id"]: r["fingerprint"] for r in QUERIES["op2_simhash_near_duplicates"](spark, sf_dir).collect()}
    for doc_id, text in docs:
        words = regex.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert got[doc_id] == f"{bits:016x}"


def test_similar_groups(spark, sf_dir, docs):
    # one family of many near copies of one text, whose members are less like each other
    base = words_of(max((t for _, t in docs), key=len))[:240]
    rng = np.random.default_rng(1)
    family = [" ".join(w.decode() for w in base)]
    for k in range(60):
        copy = list(base)
        for at in rng.choice(len(copy), 3, replace=False):
            copy[at] = f"planted{k}x{at}".encode()
        family.append(" ".join(w.decode() for w in copy))
    rows = [*docs, *[(100_000 + i, t) for i, t in enumerate(family)]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in simhash.similar_groups(df).collect()}
    sets = [set(simhash.shingles(words_of(t), 5)) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = _linked(len(rows), pairs)
    assert [got[d] for d, _ in rows] == [rows[r][0] for r in root]


def test_leaks(spark, sf_dir, docs):
    tokens = lambda t: regex.findall(r"[\p{L}\p{N}]+", t.lower())
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    question, answer = decontaminate.split_answer(F.col("text"))
    want = set()
    runs = {d: {n: set(zip(*(w[i:] for i in range(n)), strict=False)) for n in range(1, 6)} for d, t in docs for w in [tokens(t)]}
    for item in items.select("item_id", question.alias("q"), answer.alias("a")).collect():
        for d in runs:
            shares = []
            for part in (item["q"], item["a"]):
                words = tokens(part)
                own = {tuple(words)} if 0 < len(words) <= 5 else set(zip(*(words[i:] for i in range(5)), strict=False))
                shares.append(len(own & runs[d][len(next(iter(own)))]) / len(own) if own else 1)
            if min(shares) >= 0.8:
                want.add((d, item["item_id"]))
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op1_benchmark_decontamination"](spark, sf_dir).collect()}
    assert got == want and want


def test_retrieval_is_complete():
    rng = np.random.default_rng(0)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, list(rng.choice(vocabulary, 12)), []) for i in range(100)]
    idf = {w: 0.1 + i % 7 for i, w in enumerate(vocabulary)}
    index = decontaminate._index(items, idf, 12.0)
    passages = [sorted(set(rng.integers(0, len(index.vocabulary), 25).tolist())) for _ in range(50)]
    score = collections.Counter()
    weight = {}
    term = np.repeat(np.repeat(np.arange(len(index.vocabulary)), np.diff(index.term_at)), np.diff(index.block_at))
    for t, i, g in zip(term.tolist(), index.item_of.tolist(), index.gain.tolist(), strict=True):
        weight.setdefault(t, []).append((i, g))
    for p, own in enumerate(passages):
        for t in own:
            for i, g in weight.get(t, ()):
                score[p, i] += g
    for threshold in (0.3, 0.5, 0.7):
        pairs = index.search(np.repeat(np.arange(50), [len(p) for p in passages]), np.concatenate(passages), threshold)
        got = {(p, i) for p, i, _ in zip(*(x.tolist() for x in pairs), strict=True)}
        assert got == {k for k, s in score.items() if s >= threshold - 1e-9}


def test_sentencepiece_against_library():
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as file:
        encoder = Encoder(file.read())
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    rng = np.random.default_rng(2)
    letters = list("abcdefgh ▁\n\té日👍ABC.,!?0123456789#$%&*")
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(500)] + ["abab" * 300, "a" * 999, " ", ""]
    import pyarrow as pa

    for text, (ids, shown) in zip(texts, encoder.encode(pa.array(texts)), strict=True):
        want = [*library.encode(text), 2]
        assert ids.tolist() == want and shown.decode() == " ".join(map(str, want))


def test_range_coding():
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.zipf(1.3, 200_000), 4999).astype(np.uint32)
    table = rans.Table.of_counts(np.bincount(ids, minlength=5000))
    blocks = [ids[:70_000], ids[:1], ids[:0], ids[70_000:]]
    coded = rans.encode(blocks, table)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, rans.decode(coded, table), strict=True))
    assert np.array_equal(rans.decode(coded[:1], table, checkpoint=2)[0], ids[:70_000][2 * rans.CHECKPOINT * rans.LANES :])
    assert sum(map(len, coded)) < 2 * len(ids)
    broken = bytearray(coded[0])
    broken[100] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        rans.decode([bytes(broken)], table)


def test_quality_on_held_out_labels(spark, sf_dir):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = QUERIES["op4_attention_quality"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("held_out")
    share = rows.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert share > 0.97


def test_language_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op5_language_spans"](spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert rows.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_viterbi_is_best():
    import itertools

    rng = np.random.default_rng(0)
    for size in range(1, 7):
        scores = rng.normal(0, 3, (size, 3))
        value = lambda path, s=scores: sum(s[i, x] for i, x in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))
        got = language_id.viterbi(scores, np.zeros(size, int), 1, 2.0)
        assert value(got) == pytest.approx(max(value(p) for p in itertools.product(range(3), repeat=size)))


def test_base_scores(spark, sf_dir, docs):
    rows = {r["doc_id"]: r for r in QUERIES["op10_pitman_yor_scores"](spark, sf_dir).collect()}
    counts = collections.Counter()
    for doc_id, text in docs:
        if zlib.crc32(str(doc_id).encode()) % 5 != 1:
            counts.update([*words_of(text), None])
    total, floor = sum(counts.values()), np.log10(sum(counts.values()) + 0.5 * (len(counts) + 1))
    for doc_id, text in docs:
        words = [*words_of(text), None]
        row = rows[doc_id]
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), total)
        assert row["base_score"] == pytest.approx(sum(np.log10(counts[w] + 0.5) - floor for w in words))
        assert row["held_out"] == (zlib.crc32(str(doc_id).encode()) % 5 == 1) and row["score"] < 0


def test_model_is_a_distribution(spark):
    """Spelling probabilities over all one-letter steps of a context sum to at most one."""
    words = spark.createDataFrame([("ab", 3), ("abc", 1), ("b", 2), ("x", 0)], "word string, c long")
    table = {r["key"]: r["p"] for r in lm_score.probabilities(words, 2).collect()}
    _, contexts, _ = lm_score.grams(["q"])
    start = contexts[0][:1]
    symbols = [lm_score.STOP, lm_score.END, *(ord(c) + 3 for c in "abcx")]
    keys = [int(lm_score.key_of(start, np.array([s]))[0]) for s in symbols]
    seen = [table[k] for k in keys if k in table]
    assert 0.5 < sum(seen) <= 1 + 1e-9


def test_association_rules(spark):
    rows = [(i, f"http://{'casino' if i % 4 == 0 else 'alpha'}.{'a' if i % 2 else 'b'}.org/{'es' if i % 3 else 'en'}/{i}") for i in range(600)]
    pages = spark.createDataFrame([*rows, (9000, "http://casino.zz.com/"), (9001, "http://alpha.b.com/en")], "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 4 == 0) for i in range(600)], "doc_id long, blocked boolean")
    got = {r["id"]: r["verdict"] for r in url_filter.judged(pages, labels).collect()}
    assert got[9000] == "block" and got[9001] == "allow"
    assert all(got[i] == ("block" if i % 4 == 0 else "allow") for i in range(600))


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.cut(stage(spark, docs, sf_dir), name)
        assert kept.columns == columns and kept.join(docs, columns, "left_anti").count() == 0
        docs = kept
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert sorted(r["doc_id"] for r in last.select("doc_id").collect()) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    # no two texts left are similar, and no item is left
    left = [set(simhash.shingles(words_of(r["text"]), 5)) for r in docs.collect()]
    assert all(len(a & b) < 0.8 * len(a | b) for i, a in enumerate(left) for b in left[:i])
