"""What the language model's tasks hold at once, and that working in pieces changes nothing."""

import tracemalloc

import numpy as np
import pyarrow as pa

from virosieve.llm import lm_score


def _chunk(tokens, n_words, seed=0):
    rng = np.random.default_rng(seed)
    codes = (rng.zipf(1.2, tokens) % n_words).astype("<i4")
    lengths = np.full(tokens // 100, 100, np.int32)
    hashes = rng.integers(-(1 << 62), 1 << 62, n_words)
    columns = {
        "lengths": pa.array([lengths.tolist()], pa.list_(pa.int32())),
        "codes": pa.array([lm_score._packed(codes)], pa.binary()),
        "hashes": pa.array([hashes.tolist()], pa.list_(pa.int64())),
        "held": pa.array([[i % 5 == 1 for i in range(len(lengths))]], pa.list_(pa.bool_())),
    }
    return pa.table(columns), codes, lengths, hashes


def test_a_chunks_pairs_take_few_bytes_a_token():
    chunk, codes, _, _ = _chunk(200_000, 30_000)
    lm_score._ChunkPairs(chunk, 0)
    tracemalloc.start()
    lm_score._ChunkPairs(chunk, 0)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 55 * len(codes)


def test_a_chunks_pairs_are_those_of_its_texts():
    chunk, codes, lengths, hashes = _chunk(3000, 40)
    own, expected, steps = lm_score._ChunkPairs(chunk, 0), {}, []
    begin = 0
    for i, size in enumerate(lengths):
        edge = len(hashes)
        words = [edge, *codes[begin : begin + size].tolist(), edge]
        begin += size
        for pair in zip(words, words[1:]):
            expected[pair] = expected.get(pair, 0) + (i % 5 != 1)
            steps.append(pair)
    found = list(zip(own.first.tolist(), own.then.tolist(), strict=True))
    assert dict(zip(found, own.n.tolist(), strict=True)) == expected and len(found) == len(expected)
    assert [found[i] for i in own.of_step] == steps and (np.diff(own.keys.astype(object)) > 0).all()


def test_pieces_of_texts_cover_all(monkeypatch):
    monkeypatch.setattr(lm_score, "PIECE", 10)
    lengths = np.array([0, 3, 40, 0, 0, 9, 1, 1, 12], np.int32)
    pieces = lm_score._text_pieces(lengths)
    assert [i for a, b in pieces for i in range(a, b)] == list(range(len(lengths))) and len(pieces) > 2
    assert all(b - a == 1 or (lengths[a:b] + 1).sum() <= 10 + lengths[a] + 1 for a, b in pieces)
    assert lm_score._text_pieces(np.zeros(0, np.int32)) == []
