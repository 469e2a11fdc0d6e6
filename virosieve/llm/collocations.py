"""Collocations: counts of all phrases of up to five words from padded longest windows, summed by ROLLUP.

Every word starts one window of five columns, the word and those that lead it, padded with nulls where its piece
ends. Only these longest windows are counted; ROLLUP then sums the counts of successively shorter prefixes, and as
each occurrence of a phrase is a prefix of exactly one window, that gives the count of every phrase and, at the
level of the language, of all words. Counts of phrases score the cuts of each frequent phrase; all of that is joins
and grouping on (language, phrase).

A phrase of at least ``least`` occurrences holds no pair of neighbours that has fewer. So pairs are counted by a
64-bit hash first, the frequent hashes set bits of a map of ``1 << FILTER_BITS`` bits (8 MB, whatever the corpus),
and a window is padded from the first pair that has no bit. Hashes that collide only leave windows longer than
needed; counts never depend on them. In a corpus with so many frequent pairs that the map is full, windows are
counted uncut, at most five columns for each word.

Pieces, words and windows are found by numpy over a batch of texts, counted within the batch, and shuffled as counts.
A common phrase is combined on the map side. The first ``top`` phrases are taken from 64 parts of a language, then
from those, so no task sorts a language whole.

Nulls: a null text is an empty one and gives nothing, a null language counts as ``und``. Very long texts are cut
where a piece ends once they pass ``BATCH`` bytes; one piece longer than that is read whole. Repeated rows count
each time. Ties are in the order of the phrases' UTF-8 bytes. Only the text and language columns are read. Empty
tables, and languages without a frequent phrase, give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from virosieve.llm.text import column, small_batches
from virosieve.plans.durable import cut

LONGEST = 5
UNKNOWN = "und"
FILTER_BITS = 26
BATCH = 3 << 20
#: Distinct pairs a task holds before it hands them on.
HELD_PAIRS = 1_000_000
PARTS = 64
#: Bits of one map that ``bitmap_construct_agg`` builds.
_MAP_BITS = 32768

_CUT = re.compile(rb"[.,;:!?\x0A-\x0D]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0 in a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?\x0a\x0b\x0c\x0d"]] = 2
_WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]


@dataclass(frozen=True)
class Words:
    """Words of a batch: their codes in ``names``, their language, and whether the next word continues the piece."""

    codes: np.ndarray
    names: pa.Array
    language: np.ndarray
    languages: pa.Array
    goes_on: np.ndarray

    def pair_hashes(self) -> np.ndarray:
        """Hash of (language, word, next word) at every word; of no meaning where the piece ends."""
        of_name = np.array([xxhash.xxh64_intdigest(w) for w in self.names.to_pylist()], np.uint64)
        of_language = np.array([xxhash.xxh64_intdigest(w, 1) for w in self.languages.to_pylist()], np.uint64)
        word = of_name[self.codes]
        mixed = (word ^ of_language[self.language]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed[:-1] += word[1:]
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        return mixed ^ (mixed >> np.uint64(32))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """``(languages, texts)`` of at most about ``BATCH`` bytes; longer texts are cut where a piece ends."""
    for batch in small_batches(batches, "text", BATCH):
        texts = pc.fill_null(column(batch, "text").cast(pa.string()), "")
        if batch.num_rows > 1 or pc.binary_length(texts)[0].as_py() <= BATCH:
            yield column(batch, "lang"), texts
            continue
        raw, at = texts[0].as_buffer().to_pybytes(), 0
        while at < len(raw):
            end = _CUT.search(raw, at + BATCH)
            stop = end.end() if end else len(raw)
            yield column(batch, "lang"), pa.array([raw[at:stop].decode()], pa.string())
            at = stop


def words_of(languages: pa.Array, texts: pa.Array) -> Words | None:
    """The words of a batch of texts without nulls; None if there are none."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    size = int(offsets[-1] - offsets[0])
    if not size:
        return None
    raw = np.frombuffer(texts.buffers()[2], np.uint8, size, int(offsets[0]))
    offsets -= offsets[0]
    kind = _KIND[raw]
    inside = kind == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < size]  # a text's first character starts a word, whatever the text before ends with
    first[begins] = inside[begins]
    start = np.flatnonzero(first)
    if not len(start):
        return None
    last = inside.copy()
    last[:-1] &= first[1:] | ~inside[1:]
    sizes = np.flatnonzero(last) + 1 - start
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    names = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(_LOWER[raw[inside]])).dictionary_encode()
    cuts = np.cumsum(kind == 2, dtype=np.int32)[start]
    row = np.searchsorted(offsets, start, side="right") - 1
    goes_on = np.zeros(len(start), bool)
    goes_on[:-1] = (cuts[1:] == cuts[:-1]) & (row[1:] == row[:-1])
    known = languages.dictionary_encode()
    return Words(names.indices.to_numpy().astype(np.int64), names.dictionary, known.indices.to_numpy()[row], known.dictionary, goes_on)


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, counts, size = [], [], 0

    def merged():
        pairs, place = np.unique(np.concatenate(held), return_inverse=True)
        n = np.bincount(place, np.concatenate(counts), len(pairs)).astype(np.int64)
        return pairs, n

    for languages, texts in _parts(batches):
        words = words_of(languages, texts)
        if words is None:
            continue
        pairs, n = np.unique(words.pair_hashes()[words.goes_on], return_counts=True)
        held.append(pairs)
        counts.append(n)
        size += len(pairs)
        if size > HELD_PAIRS:
            pairs, n = merged()
            held, counts, size = [pairs], [n], len(pairs)
            if size > HELD_PAIRS // 2:
                yield pa.RecordBatch.from_arrays([pa.array(pairs.view(np.int64)), pa.array(n)], ["pair", "n"])
                held, counts, size = [], [], 0
    if held:
        pairs, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(pairs.view(np.int64)), pa.array(n)], ["pair", "n"])


def frequent_pairs(texts: DataFrame, least: int) -> np.ndarray:
    """A map with a bit set for every pair of neighbours that occurs at least ``least`` times (and for some others)."""
    pairs = texts.mapInArrow(_pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    slot = F.shiftrightunsigned("pair", 64 - FILTER_BITS) + 1
    maps = pairs.groupBy(F.bitmap_bucket_number(slot).alias("map")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for number, part in maps.collect():  # at most (1 << FILTER_BITS) / 32768 rows of 4 KB
        at = (number - 1) * (_MAP_BITS // 8)
        bits[at : at + len(part)] = np.frombuffer(part, np.uint8)
    return bits


def _windows(bits: np.ndarray):
    """Arrow function: ``(lang, w1, ..., w5, n)``, the padded windows of each batch with their counts."""

    def run(batches):
        for languages, texts in _parts(batches):
            words = words_of(languages, texts)
            if words is None:
                continue
            slot = words.pair_hashes() >> np.uint64(64 - FILTER_BITS)
            good = words.goes_on & ((bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
            length = np.ones(len(good), np.int8)
            alive = good.copy()
            for k in range(1, LONGEST):
                length += alive
                alive[:-k] &= good[k:]
                alive[-k:] = False
            for k in range(1, LONGEST + 1):
                at = np.flatnonzero(length == k)
                if len(at):
                    yield _counted(words, at, k)

    return run


def _counted(words: Words, at: np.ndarray, k: int) -> pa.RecordBatch:
    """The distinct windows of ``k`` words that start at ``at``, with their counts."""
    key = words.language[at].astype(np.int64)
    first, n = None, None
    for step in range(k):
        key = key * len(words.names) + words.codes[at + step]
        # dense again, so that the next product can't overflow
        _, first, key, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    at = at[first]
    columns = [words.languages.take(pa.array(words.language[at]))]
    for step in range(LONGEST):
        columns.append(words.names.take(pa.array(words.codes[at + step])) if step < k else pa.nulls(len(at), pa.string()))
    return pa.RecordBatch.from_arrays([*columns, pa.array(n.astype(np.int64))], ["lang", *_WORDS, "n"])


def phrase_counts(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", least: int = 100) -> DataFrame:
    """``(lang, size, phrase, f)`` of all phrases with at least ``least`` occurrences; size 0 counts all words of a language."""
    lang = F.coalesce(F.col(lang_column).cast("string"), F.lit(UNKNOWN))
    texts = docs.select(lang.alias("lang"), F.col(text_column).cast("string").alias("text"))
    schema = "lang string, " + ", ".join(f"{w} string" for w in _WORDS) + ", n long"
    windows = texts.mapInArrow(_windows(frequent_pairs(texts, least)), schema)
    counted = windows.groupBy("lang", *_WORDS).agg(F.sum("n").alias("n"))
    rolled = counted.rollup("lang", *_WORDS).agg(F.sum("n").alias("f"), F.grouping_id().alias("left_out"))
    # a prefix of k words leaves LONGEST - k columns out; padded prefixes are shorter phrases, counted at their own level
    size, whole = F.lit(None), F.lit(False)
    for k in range(LONGEST + 1):
        level = F.col("left_out") == (1 << (LONGEST - k)) - 1
        size = F.when(level, k).otherwise(size)
        whole = whole | (level & F.col(_WORDS[k - 1]).isNotNull() & (F.col("f") >= least) if k else level)
    found = rolled.filter(whole).select("lang", size.alias("size"), F.concat_ws(" ", *_WORDS).alias("phrase"), "f")
    return cut(found, "phrases")


def scored(counts: DataFrame) -> DataFrame:
    """``(lang, size, phrase, a, l, r, n, score)`` of every phrase of two words or more, by its lowest cut."""
    n = counts.filter("size = 0").select("lang", F.col("f").alias("n"))
    parts = F.split("phrase", " ")
    cuts = counts.filter("size >= 2").select("lang", "size", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("head", F.array_join(F.slice(parts, F.lit(1), F.col("k")), " "))
    cuts = cuts.withColumn("rest", F.array_join(F.slice(parts, F.col("k") + 1, F.col("size") - F.col("k")), " "))
    shown = counts.filter("size >= 1")
    cuts = cuts.join(shown.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(shown.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    wide = "cast({} as decimal(38, 0))"
    # a language may hold most phrases: its total is repeated for each part of it
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).cast("int")
    n = n.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    value = F.expr(f"({wide.format('1000')} * a * n) div ({wide.format('l')} * r)")
    cuts = cuts.withColumn("part", part).join(n, ["lang", "part"]).withColumn("score", value)
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "size", "a", "l", "r", "n")).alias("b"))
    return best.select("lang", "b.size", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")


def _inner(candidates: DataFrame) -> DataFrame:
    """``(longer_lang, longer_f, inner_phrase)``: the phrases one word shorter in each candidate.

    One word is enough: if a much longer phrase is as frequent, so is every phrase between the two.
    """
    parts = F.split("phrase", " ")
    shorter = F.array(F.slice(parts, F.lit(1), F.col("size") - 1), F.slice(parts, F.lit(2), F.col("size") - 1))
    inner = candidates.filter("size >= 3").select(F.col("lang").alias("longer_lang"), F.col("a").alias("longer_f"), F.explode(shorter).alias("words"))
    return inner.select("longer_lang", "longer_f", F.array_join("words", " ").alias("inner_phrase"))


def mined(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", least: int = 100, top: int = 2000) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)`` of the first ``top`` phrases of each language.

    Phrases that a longer one holds at least as often are left out. Runs the counting jobs when called.
    """
    candidates = cut(scored(phrase_counts(docs, text_column, lang_column, least)), "collocations")
    held = F.expr("lang = longer_lang and phrase = inner_phrase and longer_f >= a")
    kept = candidates.join(_inner(candidates), held, "left_anti")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = kept.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    first = first.filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
