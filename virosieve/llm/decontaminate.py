"""Benchmark decontamination: a BM25 index of test items, searched by every training passage.

The index is inverted: term -> blocks of items -> items, with each term's greatest contribution overall and in
each block. A passage is a query. Contributions are divided by the item's own full score, so one threshold
serves all items. Search follows block-max WAND, for all passages of an Arrow batch at once:

1. a passage's terms are ordered by their greatest contribution; terms whose sum stays below the threshold
   cannot lift an item over it alone, so only the others open blocks;
2. an opened block is left unless the block's greatest contributions of all the passage's terms reach it;
3. items of the blocks that remain are scored in full, and all at or above the threshold are retrieved.

A retrieved pair is verified: at least ``overlap`` of the question's five-word shingles, and of the answer's,
stand in the passage. A text of fewer than five words counts as one shingle. Passages overlap by half and are
at least two and a half times as long as the longest item, so an item's occurrence lies whole in one of them.

Words are runs of letters and digits, lower-cased. Term statistics cover all items and come from Spark. Items
are searched in shards of at most ``SHARD`` items, which bounds the index that a task holds; documents pass
through the shards one after the other, without a shuffle.

Nulls: an item or document without words matches nothing; items with a null id are left out. Of repeated item
ids, each text is an item of its own and the id is reported once with its best score. Repeated documents stay
repeated. Only the text column is read; the document's other columns travel in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from virosieve.llm.text import column, small_batches, tidy

SHARD = 20_000
THRESHOLD = 0.5
OVERLAP = 0.8
SHINGLE = 5
BLOCK = 16
K1, B = 1.2, 0.75
MATCH = "item_id long, score double, question_overlap double, answer_overlap double"


def terms(texts: pa.Array) -> pa.Array:
    """Lower-cased runs of letters and digits of each text; a null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    return pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\pL\pN]+")


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the text of each."""
    listed = terms(texts)
    flat, owner = listed.flatten(), pc.list_parent_indices(listed).to_numpy()
    solid = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(solid), owner[solid.to_numpy(zero_copy_only=False)]


def _shingles(codes: list[int]) -> set[tuple[int, ...]]:
    if len(codes) <= SHINGLE:
        return {tuple(codes)} if codes else set()
    return set(zip(*(codes[i:] for i in range(SHINGLE)), strict=False))


def split_answer(text: Column) -> tuple[Column, Column]:
    """Question and answer of an item that is one text: the answer is its last sentence, if there are several."""
    pattern = r"(?s)^(.*[.!?])\s+(\S.*)$"
    whole = F.coalesce(text, F.lit(""))
    has = whole.rlike(pattern)
    return F.when(has, F.regexp_extract(whole, pattern, 1)).otherwise(whole), F.when(has, F.regexp_extract(whole, pattern, 2)).otherwise("")


@dataclass
class Index:
    """One shard: postings by (term, block), their bounds, and what verification needs."""

    vocabulary: pa.Array
    ids: np.ndarray
    questions: list[set]
    answers: list[set]
    top: np.ndarray  # greatest contribution of each term
    term_at: np.ndarray  # where each term's blocks begin
    block_of: np.ndarray
    block_top: np.ndarray
    block_at: np.ndarray  # where each (term, block)'s postings begin
    item_of: np.ndarray
    gain: np.ndarray
    stride: int

    def __post_init__(self):
        term = np.repeat(np.arange(len(self.term_at) - 1), np.diff(self.term_at))
        self.keys = term * self.blocks + self.block_of

    @property
    def blocks(self) -> int:
        return -(-len(self.ids) // BLOCK)

    def search(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ``(passage, item, score)`` at or above the threshold, of distinct (passage, term) pairs."""
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        order = np.lexsort((self.top[term], passage))
        passage, term = passage[order], term[order]
        if not len(passage):
            return nothing
        begin = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
        sizes = np.diff(np.append(begin, len(passage)))
        total = np.cumsum(self.top[term])
        total -= np.repeat(total[begin] - self.top[term[begin]], sizes)
        essential = total >= threshold - 1e-9
        opened = np.unique(passage[essential])
        if not len(opened):
            return nothing
        # pairs of the passages that opened anything, by their own range of rows
        row_of = np.repeat(np.arange(len(begin)), sizes)
        pair, block = _spread(self.term_at[term[essential]], self.term_at[term[essential] + 1])
        keys = np.unique(row_of[essential][pair] * self.blocks + self.block_of[block])
        row, block = keys // self.blocks, keys % self.blocks
        # bound of each opened block over all terms of its passage
        which, at = _spread(begin[row], begin[row] + sizes[row])
        posting_key = term[at] * self.blocks + block[which]
        found = np.minimum(np.searchsorted(self.keys, posting_key), len(self.keys) - 1)
        hit = self.keys[found] == posting_key
        which, found = which[hit], found[hit]
        bound = np.bincount(which, weights=self.block_top[found], minlength=len(row))
        alive = bound >= threshold - 1e-9
        live = alive[which]
        which, found = which[live], found[live]
        spot, posting = _spread(self.block_at[found], self.block_at[found + 1])
        score_key, inverse = np.unique(which[spot] * np.int64(len(self.ids)) + self.item_of[posting], return_inverse=True)
        score = np.bincount(inverse, weights=self.gain[posting], minlength=len(score_key))
        good = score >= threshold - 1e-9
        which, item = score_key[good] // len(self.ids), score_key[good] % len(self.ids)
        return passage[begin[row[which]]], item, score[good]



def _spread(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges: the number of the range, and each position in it."""
    sizes = stop - start
    which = np.repeat(np.arange(len(start)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes - start, sizes)


def build_indexes(items: DataFrame, id_column: str, question: Column, answer: Column) -> list[Index]:
    """The shards of the index of ``items``; statistics are Spark aggregates over all of them."""
    rows = items.select(F.col(id_column).cast("long").alias("id"), question.alias("question"), answer.alias("answer")).filter("id is not null")
    rows = rows.select("id", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [terms(column(batch, name)).cast(pa.list_(pa.string())) for name in ("question", "answer")]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), *parts], names=["id", "question", "answer"])

    rows = rows.mapInArrow(run, "id long, question array<string>, answer array<string>")
    solid = lambda name: F.filter(name, lambda w: w != "")
    rows = rows.select("id", solid("question").alias("question"), solid("answer").alias("answer"))
    rows = rows.filter(F.size("question") + F.size("answer") > 0)
    all_words = F.concat("question", "answer")
    # a copied item has all its words' weight; df counts texts
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(all_words)).alias("length")).first()
    if not sums["n"]:
        return []
    df = rows.select(F.explode(F.array_distinct(all_words)).alias("term")).groupBy("term").count()
    idf = df.select("term", F.log(1 + (sums["n"] - F.col("count") + 0.5) / (F.col("count") + 0.5)).alias("idf"))
    shards = -(-sums["n"] // SHARD)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", "question", "answer"), F.lit(shards)))
    built = []
    for shard in range(shards):
        own = rows.filter(F.col("shard") == shard)
        chosen = sorted((r["id"], r["question"], r["answer"]) for r in own.select("id", "question", "answer").collect())
        weights = own.select(F.explode(F.array_distinct(all_words)).alias("term")).distinct().join(idf, "term")
        if chosen:
            built.append(_index(chosen, {r["term"]: r["idf"] for r in weights.collect()}, sums["length"]))
    return built


def _index(items: list[tuple], idf: dict[str, float], mean_length: float) -> Index:
    names = sorted(idf)
    code = {w: i for i, w in enumerate(names)}
    postings = []
    longest = 0
    for number, (_, question, answer) in enumerate(items):
        words = question + answer
        longest = max(longest, len(words))
        base = K1 * (1 - B + B * len(words) / mean_length)
        counts: dict[str, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        own = {w: idf[w] * n * (K1 + 1) / (n + base) for w, n in counts.items()}
        full = sum(own.values())
        postings += [(code[w], number // BLOCK, number, gain / full) for w, gain in own.items()]
    postings.sort()
    term, block, item = (np.array([p[k] for p in postings], np.int64) for k in range(3))
    gain = np.array([p[3] for p in postings])
    block_at = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])]))
    term_of_block = term[block_at]
    return Index(
        vocabulary=pa.array(names, pa.large_string()),
        ids=np.array([i for i, _, _ in items], np.int64),
        questions=[_shingles([code[w] for w in q]) for _, q, _ in items],
        answers=[_shingles([code[w] for w in a]) for _, _, a in items],
        top=np.maximum.reduceat(gain, np.searchsorted(term, np.arange(len(names)))),
        term_at=np.searchsorted(term_of_block, np.arange(len(names) + 1)),
        block_of=block[block_at],
        block_top=np.maximum.reduceat(gain, block_at),
        block_at=np.append(block_at, len(term)),
        item_of=item,
        gain=gain,
        stride=max(32, int(longest * 1.25) + 1),
    )


def _share(wanted: set, codes: list[int], cache: dict) -> float:
    """Share of the shingles in ``wanted`` that stand in ``codes``; 1 if there are none."""
    if not wanted:
        return 1.0
    width = len(next(iter(wanted)))
    if width not in cache:
        cache[width] = set(zip(*(codes[i:] for i in range(width)), strict=False))
    return len(wanted & cache[width]) / len(wanted)


def find(index: Index, texts: pa.Array, threshold: float, overlap: float) -> list[dict]:
    """For each text ``{item_id: (score, question_overlap, answer_overlap)}`` of its verified items."""
    matches: list[dict] = [{} for _ in range(len(texts))]
    words, owner = _words(texts)
    if not len(words):
        return matches
    code = pc.fill_null(pc.index_in(words, index.vocabulary), -1).to_numpy().astype(np.int64)
    counts = np.bincount(owner, minlength=len(texts))
    text_at = np.cumsum(counts) - counts
    # half passages of ``stride`` words; a passage is a half and the next of the same text
    place = np.arange(len(code)) - text_at[owner]
    halves = np.maximum(1, -(-counts // index.stride))
    half_at = np.cumsum(halves) - halves
    half = half_at[owner] + place // index.stride
    known = code >= 0
    first = half[known]
    pairs = np.concatenate([first, first[place[known] >= index.stride] - 1])
    own_terms = np.concatenate([code[known], code[known][place[known] >= index.stride]])
    size = np.int64(len(index.vocabulary))
    distinct = np.unique(pairs * size + own_terms)
    passage, item, score = index.search(distinct // size, distinct % size, threshold)
    cache: dict[int, dict] = {}
    text_of = np.repeat(np.arange(len(texts)), halves)
    for p, i, s in zip(passage.tolist(), item.tolist(), score.tolist(), strict=True):
        text = int(text_of[p])
        if p not in cache:
            begin = int(text_at[text]) + (p - int(half_at[text])) * index.stride
            stop = min(begin + 2 * index.stride, int(text_at[text] + counts[text]))
            cache[p] = {"codes": code[begin:stop].tolist()}
        codes = cache[p]["codes"]
        asked = _share(index.questions[i], codes, cache[p])
        if asked >= overlap and (told := _share(index.answers[i], codes, cache[p])) >= overlap:
            best = matches[text].get(int(index.ids[i]))
            matches[text][int(index.ids[i])] = max(best, (s, asked, told)) if best else (s, asked, told)
    return matches


def matched(
    docs: DataFrame,
    items: DataFrame,
    item_id: str = "item_id",
    question: Column | None = None,
    answer: Column | None = None,
    text_column: str = "text",
    threshold: float = THRESHOLD,
    overlap: float = OVERLAP,
) -> DataFrame:
    """``docs`` as a struct column ``row``, with the array ``matches`` of its verified items.

    Without ``question`` and ``answer`` (columns of ``items``), an item is its column ``text``, split by ``split_answer``.
    """
    if question is None:
        question, answer = split_answer(F.col("text").cast("string"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rows = rows.withColumn("matches", F.array().cast(f"array<struct<{MATCH.replace(' ', ':').replace(',:', ',')}>>"))
    schema = rows.schema
    for index in build_indexes(items, item_id, question, F.lit("") if answer is None else answer):
        held = docs.sparkSession.sparkContext.broadcast(index)  # one shard: at most SHARD items

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches, "row", 1 << 20, text_column):
                texts = column(batch, "row").field(text_column).cast(pa.string())
                found = find(held.value, texts, threshold, overlap)
                listed = column(batch, "matches")
                if any(found):
                    before = listed.to_pylist()
                    names = ("item_id", "score", "question_overlap", "answer_overlap")
                    after = [b + [dict(zip(names, (i, *m), strict=True)) for i, m in sorted(f.items())] for b, f in zip(before, found, strict=True)]
                    listed = pa.array(after, listed.type)
                yield pa.RecordBatch.from_arrays([column(batch, "row"), listed], names=["row", "matches"])

        rows = rows.mapInArrow(tidy(run), schema)
    return rows


def clean_rows(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without a verified item, with their own columns."""
    return matched(docs, items, **options).filter(F.size("matches") == 0).select("row.*")
