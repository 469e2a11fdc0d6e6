"""Near-duplicate texts of the kinds that fingerprints of words miss."""

import numpy as np

from virosieve.llm import simhash


def _pairs_found(spark, texts, pairs):
    """How many of ``pairs`` of places in ``texts`` are in one group; pairs are similar enough, which is checked."""
    sets = [set(simhash.shingles(t.encode().split(), 5)) for t in texts]
    assert all(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i, j in pairs)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in simhash.similar_groups(df).collect()}
    alone = set(range(len(texts))) - {i for pair in pairs for i in pair}
    assert all(got[i] == i for i in alone)
    return sum(got[i] == got[j] for i, j in pairs)


def test_crowded_points(spark):
    # many orders of the same words: all meet in any fingerprint of words
    rng = np.random.default_rng(2)
    lists = [[f"lengthy{n}" for n in rng.permutation(120)] for _ in range(400)]
    copies = [[*words[:i], "replaced", *words[i + 1 :]] for i, words in enumerate(lists[:60], 20)]
    texts = [" ".join(words) for words in (*lists, *copies)]
    assert _pairs_found(spark, texts, [(i, 400 + i) for i in range(60)]) == 60


def test_contiguous_edits(spark):
    # ends cut off, ends appended and blocks replaced change as many words as shingles
    rng = np.random.default_rng(3)
    texts, pairs = [], []
    for size in (60, 90, 150, 300, 600):
        for _ in range(6):
            words = [f"lengthy{n}" for n in rng.integers(0, 50_000, size)]
            block, at, other = round(0.1 * (size - 4)) - 4, size // 3, [f"another{n}" for n in rng.integers(0, 50_000, size)]
            kinds = [words[: -round(0.18 * size)], [*words, *other[: round(0.2 * size)]], [*words[:at], *other[:block], *words[at + block :]]]
            pairs += [(len(texts), len(texts) + 1 + k) for k in range(len(kinds))]
            texts += [" ".join(w) for w in (words, *kinds)]
    # each copy alone with its text, so that no other copy links them
    found = 0
    for k in range(3):
        own = [pair for pair in pairs if (pair[1] - pair[0]) == k + 1]
        found += _pairs_found(spark, [texts[i] for pair in own for i in pair], [(2 * i, 2 * i + 1) for i in range(len(own))])
    assert found == len(pairs)


def test_few_long_words(spark):
    # the copy lacks the last of eight long words
    rng = np.random.default_rng(4)
    texts = []
    for number in range(40):
        words = [f"w{n}" for n in rng.integers(100, 1000, 60)]
        for at in range(7):
            words[5 + 7 * at] = f"lengthy{8 * number + at}"
        texts += [" ".join([*words, f"lengthy{8 * number + 7}"]), " ".join(words)]
    assert _pairs_found(spark, texts, [(2 * i, 2 * i + 1) for i in range(40)]) == 40


def test_rows_that_share_an_id(spark):
    rng = np.random.default_rng(5)
    first, second, third = ([f"lengthy{n}" for n in rng.integers(0, 50_000, 200)] for _ in range(3))
    near = [*first[:100], "replaced", *first[101:]]
    # id 2 has a near copy of id 1's text, and two rows of a text of its own; 3 and 4 are linked only by a row without id
    rows = [(1, first), (2, near), (2, second), (2, second), (3, third), (None, third[:-20]), (4, third[25:-20])]
    rows = [(i, " ".join(words)) for i, words in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in simhash.distinct_rows(df).collect())
    assert kept == sorted([(0, rows[5][1]), (1, rows[0][1]), (2, rows[2][1]), (3, rows[4][1])])


def test_pipeline_stage_links_by_simhash(spark):
    # equal fingerprints, as one phrase outweighs the rest, but few of their shingles are shared
    texts = ["red green blue " * 300 + " ".join(f"{kind}{i}" for i in range(40)) for kind in ("left", "right")]
    texts.append(" ".join(f"other{i}" for i in range(400)))
    docs = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert len({r.component_id for r in simhash.similar_groups(docs).collect()}) == 3
    assert sorted(r.doc_id for r in simhash.distinct_rows(docs).collect()) == [1, 3]
    expected = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert expected == {1, 3}


def _compared(spark, monkeypatch, texts):
    """The groups, and how many pairs were compared after those with hubs."""
    seen = []
    cut = simhash.cut

    def counted(df, label="cut"):
        kept = cut(df, label)
        seen.extend([kept.count()] if label == "pairs" else [])
        return kept

    monkeypatch.setattr(simhash, "cut", counted)
    monkeypatch.setattr(simhash, "_OFTEN", 1 << 30)  # the order knows no frequent shingles, as for those a sample misses
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = {}
    for r in simhash.similar_groups(df).collect():
        groups.setdefault(r["component_id"], set()).add(r["id"])
    return sorted(map(sorted, groups.values())), seen[0]


def test_unlike_texts_that_share_a_passage_are_not_paired(spark, monkeypatch):
    rng = np.random.default_rng(7)
    passage = [f"shared{i}" for i in range(30)]
    lists = [[*(f"w{n}" for n in rng.integers(0, 50_000, size)), *passage] for size in (60, 200, 700) for _ in range(50)]
    pairs = [[*lists[i][:20], "replaced", *lists[i][21:]] for i in (0, 60, 120)]
    groups, compared = _compared(spark, monkeypatch, [" ".join(w) for w in (*lists, *pairs)])
    assert [g for g in groups if len(g) > 1] == [[0, 150], [60, 151], [120, 152]]
    assert compared < 300  # of 150 texts' pairs at the passage's points


def test_edited_copies_meet_the_text_they_were_made_of(spark, monkeypatch):
    # a copy is similar to the text, but not to another copy
    rng = np.random.default_rng(8)
    first = [f"w{n}" for n in rng.integers(0, 50_000, 150)]
    copies = []
    for number in range(120):
        copies.append(list(first))
        for at in (10, 70, 130):
            copies[-1][int(at + rng.integers(-8, 8))] = f"edit{number}"
    groups, compared = _compared(spark, monkeypatch, [" ".join(w) for w in (first, *copies)])
    assert groups == [list(range(121))]
    assert compared < 600  # of 7140 pairs of copies


def test_bitmaps_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(9)
    for size in (0, 1, 40, 64, 65, 150, 1000, 9000):
        own = np.unique(rng.integers(-(1 << 62), 1 << 62, size))
        other = np.unique(np.concatenate([own[size // 10 :], rng.integers(-(1 << 62), 1 << 62, size // 5)]))
        bits = sorted((simhash._parity(own), simhash._parity(other)), key=len)
        while len(bits[1]) > len(bits[0]):
            bits[1] = bits[1][: len(bits[1]) // 2] ^ bits[1][len(bits[1]) // 2 :]
        differing = np.unpackbits((bits[0] ^ bits[1]).view(np.uint8)).sum()
        assert differing <= len(np.setxor1d(own, other))
