"""Language spans of mixed-language texts: script ranges, word scores, and Viterbi with a switching penalty.

Each word's letters are told by script; only languages that write at least ``LEAST_SHARE`` of their letters in
the word's main script are candidates. A word's score for a language is the log probability of its letter
trigrams and of the word itself, from hashed counts. Viterbi finds the best labelling of all words of a text,
where a change of language costs ``PENALTY``; texts of an Arrow batch advance together, longest first. Equal
labels in a row are a span. A text's language is the one with the most letters, and its score their share.

Learning uses at most ``PER_LANGUAGE`` texts of each language, those with the least hash of their id; counts are
taken by Spark. Every language is learned; the model has ``BUCKETS`` numbers (128 KB) for each, and the texts that
are scored at once become fewer as languages become more, so that a task's memory stays bounded. Prediction is one
pass without a shuffle over whole texts.

Nulls: a null text, or one without a letter, is ``und`` with score 0. A text with letters in scripts that no
learned language uses gets the commonest learned language with score 0; so it is ``und`` only where nothing was
learned. Ties go to the language first in alphabetical order. Rows with null language teach nothing. Repeated
rows stay repeated. Only the id, text and language columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from virosieve.llm.text import column, id_remainder, small_batches

BUCKETS = 1 << 15
PENALTY = 8.0
LEAST_SHARE = 0.01
PER_LANGUAGE = 2000
BROADCAST_LANGUAGES = 500
#: Word scores held at once, in (word, language) pairs of about a byte of text each.
HELD = 200 * (4 << 20)
UNKNOWN = "und"

#: The Unicode blocks of the main scripts (first and last code point).
SCRIPTS = (
    ("latin", 0x0041, 0x024F),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("gurmukhi", 0x0A00, 0x0A7F),
    ("gujarati", 0x0A80, 0x0AFF),
    ("tamil", 0x0B80, 0x0BFF),
    ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF),
    ("malayalam", 0x0D00, 0x0D7F),
    ("sinhala", 0x0D80, 0x0DFF),
    ("thai", 0x0E00, 0x0E7F),
    ("lao", 0x0E80, 0x0EFF),
    ("tibetan", 0x0F00, 0x0FFF),
    ("myanmar", 0x1000, 0x109F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF),
    ("ethiopic", 0x1200, 0x137F),
    ("khmer", 0x1780, 0x17FF),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x1F00, 0x1FFF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
    ("han", 0x20000, 0x323AF),
)
_NAMES = sorted({name for name, _, _ in SCRIPTS})
#: 0: no letter; 1 and up: the named scripts; the last: letters of other scripts.
N_SCRIPTS = len(_NAMES) + 2


@cache
def _script_of() -> np.ndarray:
    letters = np.array([chr(c).isalpha() for c in range(0x110000)])
    found = np.where(letters, N_SCRIPTS - 1, 0).astype(np.int8)
    for name, first, last in SCRIPTS:
        block = slice(first, last + 1)
        found[block] = np.where(letters[block], _NAMES.index(name) + 1, 0)
    return found


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, and the number and text of each word in order."""
    listed = pc.split_pattern_regex(pc.fill_null(texts.cast(pa.large_string()), ""), "[ \t-\r]+")
    owner = pc.list_parent_indices(listed).to_numpy()
    coded = listed.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), owner


def _features(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(bucket, word)`` of every feature, letters per (word, script), and which words have letters."""
    lowered = pc.utf8_lower(words).to_pylist()
    points = np.frombuffer("".join(lowered).encode("utf-32-le"), np.uint32).astype(np.int64)
    word = np.repeat(np.arange(len(lowered)), [len(w) for w in lowered])
    script = _script_of()[points]
    by_script = np.bincount(word * N_SCRIPTS + script, minlength=len(lowered) * N_SCRIPTS).reshape(-1, N_SCRIPTS)
    by_script[:, 0] = 0
    letters = script > 0
    points, word = points[letters], word[letters]
    n = np.bincount(word, minlength=len(lowered))
    # each word's letters with a mark (1) on either side
    at = np.arange(len(points)) + 2 * word + 1
    padded = np.ones(len(points) + 2 * len(lowered), np.int64)
    padded[at] = points
    grams = (padded[at - 1] * 961_748_941 + padded[at] * 433_494_437 + padded[at + 1] * 29_996_224_275_833) % 2_147_483_647
    sums = np.bincount(word, weights=(grams * (1 + at - (np.cumsum(n) - n)[word])) % 1_000_003, minlength=len(lowered)).astype(np.int64)
    own = np.flatnonzero(n)
    bucket = np.concatenate([grams % BUCKETS, (sums[own] * 2_654_435_761 + 7) % BUCKETS])
    return bucket, np.concatenate([word, own]), by_script, n


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # (language, bucket): log probability
    allowed: np.ndarray  # (script, language)
    commonest: int

    def word_scores(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by (word, language), the words' letters, and whether each word has a candidate."""
        bucket, word, by_script, n = _features(words)
        scores = np.stack([np.bincount(word, weights=row[bucket], minlength=len(words)) for row in self.scores], axis=1)
        candidates = self.allowed[by_script.argmax(axis=1)] & (n > 0)[:, None]
        usable = candidates.any(axis=1)
        return np.where(candidates, scores, -1e9), n, usable

    def label(self, texts: pa.Array) -> list[tuple[str, float, list]]:
        """``(language, score, spans)`` of each text; spans are (language, first word, end)."""
        if not self.languages:
            return [(UNKNOWN, 0.0, [])] * len(texts)
        words, code, owner = _words(texts)
        scores, letters, usable = self.word_scores(words)
        place = np.arange(len(code)) - np.searchsorted(owner, owner)
        lettered = np.bincount(owner, weights=letters[code], minlength=len(texts))
        solid = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)[code]
        place -= np.concatenate([[0], np.cumsum(~solid)[:-1]]) - np.concatenate([[0], np.cumsum(~solid)])[np.searchsorted(owner, owner)]
        keep = usable[code]
        code, owner, place = code[keep], owner[keep], place[keep]
        labels = viterbi(scores[code], owner, len(texts), PENALTY)
        size = len(self.languages)
        sums = np.bincount(owner * size + labels, weights=letters[code], minlength=len(texts) * size).reshape(-1, size)
        best, total = sums.argmax(axis=1), np.maximum(lettered, 1)
        cuts = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (labels[1:] != labels[:-1])])) if len(owner) else np.zeros(0, np.int64)
        ends = np.append(cuts[1:], len(owner))[: len(cuts)] - 1
        spans: list[list] = [[] for _ in range(len(texts))]
        for a, b in zip(cuts.tolist(), ends.tolist(), strict=True):
            spans[owner[a]].append((self.languages[labels[a]], int(place[a]), int(place[b]) + 1))
        result = []
        for i in range(len(texts)):
            if not lettered[i]:
                result.append((UNKNOWN, 0.0, []))
            elif not spans[i]:
                result.append((self.languages[self.commonest], 0.0, []))
            else:
                result.append((self.languages[best[i]], float(sums[i, best[i]] / total[i]), spans[i]))
        return result


def viterbi(scores: np.ndarray, owner: np.ndarray, n_texts: int, penalty: float) -> np.ndarray:
    """The best label of each row of ``scores``; rows of one owner are a chain, in order."""
    labels = np.zeros(len(owner), np.int64)
    sizes = np.bincount(owner, minlength=n_texts)
    begin = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    if not len(order):
        return labels
    begin, sizes = begin[order], sizes[order]
    active = [int(k) for k in np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")]
    state = scores[begin].copy()
    before: list[np.ndarray] = [np.zeros(0, np.int16)]  # the label each label came from
    own = np.arange(scores.shape[1], dtype=np.int16)[None, :]
    for step in range(1, int(sizes[0])):
        k = active[step]
        past = state[:k]
        top = past.argmax(axis=1)
        switch = past[np.arange(k), top] - penalty
        stay = past >= switch[:, None]
        before.append(np.where(stay, own, top[:, None].astype(np.int16)))
        state[:k] = np.where(stay, past, switch[:, None]) + scores[begin[:k] + step]
    now = state.argmax(axis=1)
    for step in range(int(sizes[0]) - 1, 0, -1):
        k = active[step]
        labels[begin[:k] + step] = now[:k]
        now[:k] = before[step][np.arange(k), now[:k]]
    labels[begin] = now
    return labels


def learn(docs: DataFrame, learn_from: Column | None = None, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Model:
    """Learn from rows with a language for which ``learn_from`` (over the columns id, lang, text) holds."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(lang_column).cast("string").alias("lang"), F.col(text_column).cast("string").alias("text"))
    rows = rows.filter("lang is not null")
    if learn_from is not None:
        rows = rows.filter(learn_from)
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # the distinct languages
    if not sizes:
        return Model([], np.zeros((0, BUCKETS)), np.zeros((N_SCRIPTS, 0), bool), 0)
    languages = sorted(sizes)
    # of a language with many texts, only ids with a small hash are ranked: about twice as many as are taken
    bound = {lang: int((2 * PER_LANGUAGE / n - 0.5) * 2**64) for lang, n in sizes.items() if n > 4 * PER_LANGUAGE}
    low = F.lit(True)
    if bound:
        least = docs.sparkSession.createDataFrame(list(bound.items()), "_l string, _bound long")  # a row for each language
        rows_in = rows.select("id", "lang", F.xxhash64("id").alias("h")).join(F.broadcast(least), F.col("lang") == F.col("_l"), "left")
        low = F.col("_bound").isNull() | (F.col("h") <= F.col("_bound"))
    else:
        rows_in = rows.select("id", "lang", F.xxhash64("id").alias("h"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    chosen = rows_in.filter(low).select("id", "lang", "h").distinct().withColumn("rank", rank).filter(F.col("rank") <= PER_LANGUAGE)
    chosen = chosen.select(F.col("id").alias("_id"), F.col("lang").alias("_lang"))
    if len(languages) <= BROADCAST_LANGUAGES:  # then at most PER_LANGUAGE ids for each
        chosen = F.broadcast(chosen)
    picked = rows.join(chosen, F.col("id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang"))).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = BUCKETS + N_SCRIPTS
        for batch in small_batches(batches, "text", 4 << 20):
            words, code, owner = _words(column(batch, "text"))
            bucket, word, by_script, _ = _features(words)
            lang = np.searchsorted(languages, column(batch, "lang").to_pylist())[owner]
            for number in np.unique(lang).tolist():
                times = np.bincount(code[lang == number], minlength=len(words))
                total = np.zeros(width, np.int64)
                total[:BUCKETS] = np.bincount(bucket, weights=times[word], minlength=BUCKETS)
                total[BUCKETS:] = times @ by_script
                some = np.flatnonzero(total)
                arrays = [pa.array(np.full(len(some), number), pa.int32()), pa.array(some, pa.int32()), pa.array(total[some])]
                yield pa.RecordBatch.from_arrays(arrays, names=["lang", "bucket", "n"])

    counted = picked.mapInArrow(run, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counted = counted.toArrow()  # at most BUCKETS + N_SCRIPTS rows for each language: the model
    total = np.zeros((len(languages), BUCKETS + N_SCRIPTS))
    total[counted["lang"].to_numpy(), counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    grams, scripts = total[:, :BUCKETS], total[:, BUCKETS:]
    scores = np.log((grams + 0.1) / (grams.sum(axis=1, keepdims=True) + 0.1 * BUCKETS))
    allowed = (scripts >= LEAST_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)) & (scripts > 0)
    commonest = max(range(len(languages)), key=lambda i: (sizes[languages[i]], -i))
    return Model(languages, scores.astype(np.float32), allowed.T.copy(), commonest)


def predicted(docs: DataFrame, model: Model, text_column: str = "text", with_spans: bool = True) -> DataFrame:
    """``docs`` as a struct column ``row``, with ``lang_pred``, ``score`` and the spans."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    packed = packed.withColumn("text", F.col("row").getField(text_column).cast("string"))
    shown = packed.select("row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"))
    if with_spans:
        shown = shown.withColumn("spans", F.lit(None).cast("array<struct<lang:string,first:int,end:int>>"))
    schema = shown.schema
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", max(1 << 14, min(4 << 20, HELD // max(1, len(held.value.languages))))):
            found = held.value.label(column(batch, "text"))
            arrays = [column(batch, "row"), pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64())]
            if with_spans:
                kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("end", pa.int32())]))
                arrays.append(pa.array([[dict(zip(("lang", "first", "end"), s, strict=True)) for s in f[2]] for f in found], kind))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return packed.mapInArrow(run, schema)


def held_out(id_column: str = "doc_id") -> Column:
    return id_remainder(id_column, 4) == 2
