"""Language-model scores by a hierarchical Pitman-Yor model: words after words, over words, over letters.

A word's context is the word before it, or the text's begin; the text's end is drawn like a word. All these
restaurants share one parent of words, whose customers are their tables and whose base distribution is a spelling. A spelling is a word's characters
and an end mark; a character's context is the ``ORDER`` characters before it in the word. Restaurants of
contexts share parents: a context's parent leaves out its first character, up to the root. A text's probability
is the product of its words' and the text end's predictive probabilities, averaged over Gibbs samples.

As Spark jobs:

1. Each task cuts its texts into chunks of about ``CHUNK`` words, with one entry for each distinct word and its
   training count; chunks are written to the shared folder. Counts of words are summed over chunks, so what
   is shuffled is distinct words per chunk, and a word that fills the corpus is one entry in each.
2. With each known word at one table, distinct words give the counts of (context, character).
3. Contexts that end in the same character are a subtree below the root and are sampled together, one task a
   subtree, whose rows are distinct (context, character) pairs and not occurrences. Two rounds are run: the
   root is re-seated in between from all subtrees' tables. The root's dishes are characters, at most Unicode.
4. Each chunk's distinct pairs of words that follow each other are counted over chunks: their 64-bit keys are sent
   to buckets as packed arrays, and what returns is packed counts of the pairs that are met more than once, or only
   in another chunk. A pair met once has one table; the others are rows, from one chunk that owns them, and are
   seated in any task, knowing their context's number of tables, so a frequent context is spread. Tables are summed to contexts and, as customers, to words.
   Draws of words and pairs follow from their hashes, not from how rows are dealt: scores are the same whatever the
   partitions.
5. Predictive probabilities are joined to the distinct words' characters and summed to spellings. Given these,
   words are re-seated in the tasks that hold them, all knowing the restaurant's number of tables.
6. Words and pairs are sent to their chunks by the buckets, packed (pairs met only once, there, are not sent); each
   chunk then sums up its texts.

The probability table is broadcast if it has at most ``BROADCAST_ROWS`` rows, else joined by a shuffle.

Nulls: a null text counts as empty and has the end alone. Rows with a null id are scored, and count as id ''
when rows are split into training and held out. Repeated rows stay repeated, in training as well. Without
training texts all counts are zero, the base score is zero, and the model is uniform over the characters met.
Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from virosieve.llm.pitman_yor import DISCOUNT, STRENGTH, Restaurants, Share, Spread, Subtree, mixed
from virosieve.llm.text import column, id_remainder, small_batches, tidy, tidy_cogroup, tidy_group
from virosieve.plans import durable

ORDER = 4
CHUNK = 1_500_000
BROADCAST_ROWS = 2_000_000
#: Tokens for each bucket of pairs (half of it at least), so that a task holds a bucket's pairs.
BUCKET_PAIRS = 1_000_000
#: Tokens or pairs of a chunk that are worked on at once where each takes many bytes.
PIECE = 1 << 17
BURN_IN, SAMPLES, MOVES = 2, 4, 3
#: Symbols that are no characters: before a word, after a word, and the end of a text.
START, STOP, END = 0, 1, 2
#: What stands for a text's begin and end among the words' hashes.
EDGE = 1
_MIX = np.uint64(0x9E3779B97F4A7C15)

cut = partial(durable.cut, drop_shuffles=True)


def _hash(value: np.ndarray, more: np.ndarray) -> np.ndarray:
    return mixed(value * _MIX + more)


def grams(words: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """``(word, contexts, symbol)`` of every character and end mark; contexts from longest to shortest, hashed.

    The shortest context is the character before, as it is.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(3)
    own = sizes + ORDER + 1
    begin = np.cumsum(own) - own
    padded = np.full(int(own.sum()), START, np.uint64)
    word = np.repeat(np.arange(len(words)), sizes)
    padded[begin[word] + ORDER + np.arange(len(points)) - (np.cumsum(sizes) - sizes)[word]] = points
    padded[begin + ORDER + sizes] = STOP
    word = np.repeat(np.arange(len(words)), sizes + 1)
    at = begin[word] + ORDER + np.arange(len(word)) - (np.cumsum(sizes + 1) - sizes - 1)[word]
    contexts = [padded[at - 1]]
    for back in range(2, ORDER + 1):
        contexts.append(_hash(contexts[-1] * np.uint64(31) + np.uint64(back), padded[at - back]))
    return word, [c.view(np.int64) for c in reversed(contexts)], padded[at].astype(np.int64)


def _end_contexts() -> list[int]:
    """The contexts of the text's end: those of a word's first character."""
    word, contexts, _ = grams(["x"])
    return [int(c[0]) for c in contexts]


def key_of(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return _hash(context.view(np.uint64), symbol.astype(np.uint64) + np.uint64(1 << 40)).view(np.int64)


CONTEXTS = [f"h{n}" for n in range(ORDER, 0, -1)]


def _packed(codes: np.ndarray) -> bytes:
    return pa.compress(codes.astype("<i4").tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=4 * count, codec="zstd", asbytes=True), "<i4")


def _chunks(docs: DataFrame, id_column: str, text_column: str, held: Column) -> DataFrame:
    rows = docs.select(F.col(id_column).cast("long").alias("id"), held.alias("held"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())]
    names = ["chunk", "ids", "held", "lengths", "codes", "words", "train"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids: list = []
        held_out: list = []
        lengths: list = []
        words: list = []  # each piece coded by itself, so that a repeated word takes four bytes
        filled = 0

        def flush() -> pa.RecordBatch:
            coded = pa.chunked_array(words, pa.dictionary(pa.int32(), pa.large_string())).unify_dictionaries().combine_chunks()
            codes = coded.indices.to_numpy()
            learn = ~np.repeat(np.array(held_out, bool), lengths)
            train = np.bincount(codes[learn], minlength=len(coded.dictionary))
            values = [part << 32 | number, ids, held_out, lengths, _packed(codes), None, train]
            arrays = [pa.array([v], k) for v, k in zip(values, kinds, strict=True)]
            flat = coded.dictionary.cast(pa.string())
            arrays[5] = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in small_batches(batches, "text", 2 << 20):
            listed = pc.ascii_split_whitespace(pc.ascii_lower(column(batch, "text").cast(pa.large_string())))
            flat, owner = listed.flatten(), pc.list_parent_indices(listed).to_numpy()
            solid = pc.greater(pc.binary_length(flat), 0)
            words.append(flat.filter(solid).dictionary_encode())
            counts = np.bincount(owner[solid.to_numpy(zero_copy_only=False)], minlength=batch.num_rows)
            lengths += counts.tolist()
            ids += column(batch, "id").to_pylist()
            held_out += column(batch, "held").to_pylist()
            filled += len(words[-1])
            if filled >= CHUNK:
                yield flush()
                number += 1
                ids, held_out, lengths, words, filled = [], [], [], [], 0
        if ids:
            yield flush()

    schema = "chunk long, ids array<long>, held array<boolean>, lengths array<int>, codes binary, words array<string>, train array<long>"
    return rows.mapInArrow(run, schema)


def _counts(words: DataFrame) -> DataFrame:
    """``(h4, .., h1, symbol, n)``: training counts of each (context, symbol) of ``words(word, c)``; zero where only met."""
    names = [*CONTEXTS, "symbol", "n"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            word, contexts, symbol = grams(texts)
            _, first, inverse = np.unique(key_of(contexts[0], symbol), return_index=True, return_inverse=True)
            n = np.bincount(inverse, weights=np.array(times, float)[word]).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x[first]) for x in (*contexts, symbol)] + [pa.array(n)], names=names)

        texts: list[str] = []
        times: list[int] = []
        for batch in batches:  # a batch's memory is used again for the next: take copies
            texts += column(batch, "word").to_pylist()
            times += column(batch, "c").to_pylist()
            if len(texts) >= 50_000:
                yield flush()
                texts, times = [], []
        if texts:
            yield flush()

    found = words.select("word", "c").mapInArrow(run, ", ".join(f"{c} long" for c in names))
    return found.groupBy(*names[:-1]).agg(F.sum("n").alias("n"))


def _sampled(counts: DataFrame, root: dict[int, float], unseen: float, tables_only: bool, seed: int) -> DataFrame:
    """Sample each subtree: ``(symbol, tables)`` of its top restaurant, or ``(key, p)`` of each row, averaged."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*CONTEXTS, "symbol"])
        symbol = rows["symbol"].to_numpy()
        tree = Subtree([rows[c].to_numpy() for c in CONTEXTS], symbol, rows["n"].to_numpy(), seed + int(rows["h1"].iloc[0]))
        base = np.array([root.get(s, unseen) for s in symbol[tree.top].tolist()])
        tree.start(base)
        tables, p = np.zeros(len(tree.top)), np.zeros(len(rows))
        for number in range(BURN_IN + SAMPLES):
            tree.sweep(base, MOVES)
            if number >= BURN_IN:
                tables += tree.levels[-1].tables
                p += tree.probabilities(base)
        if tables_only:
            return pd.DataFrame({"symbol": symbol[tree.top], "tables": np.ceil(tables / SAMPLES).astype(np.int64)})
        return pd.DataFrame({"key": key_of(rows[CONTEXTS[0]].to_numpy(), symbol), "p": p / SAMPLES})

    schema = "symbol long, tables long" if tables_only else "key long, p double"
    return counts.groupBy("h1").applyInPandas(run, schema)


def _root(tables: dict[int, int], symbols: int, seed: int) -> tuple[dict[int, float], float]:
    """Predictive probability of each symbol at the root, averaged over samples, and of any other symbol."""
    names = sorted(tables)
    level = Restaurants(np.zeros(len(names), np.int64), 1, np.random.default_rng(seed))
    uniform = 1 / max(symbols, 1)
    base = np.full(len(names), uniform)
    if not names:
        return {}, uniform
    level.seat(np.array([tables[s] for s in names]), base)
    p, rest = np.zeros(len(names)), 0.0
    for _ in range(SAMPLES):
        for _ in range(MOVES):
            level.move(base)
        p += level.predictive(base)
        rest += level.predictive(np.zeros(len(names))).sum()
    return dict(zip(names, (p / SAMPLES).tolist(), strict=True)), (1 - rest / SAMPLES) * uniform


def probabilities(words: DataFrame, n_texts: int, seed: int = 5) -> DataFrame:
    """``(key, p)``: the predictive probability of each (context, symbol) of ``words(word, c)`` and of the text end."""
    spark = words.sparkSession
    end = spark.createDataFrame([(*_end_contexts(), END, n_texts)], ", ".join(f"{c} long" for c in [*CONTEXTS, "symbol", "n"]))
    counts = cut(_counts(words).union(end), "gram-counts")
    # at first a symbol is as likely at the root as the number of contexts that have it says
    first = counts.groupBy("symbol").agg(F.count(F.when(F.col("n") > 0, 1)).alias("n")).collect()  # at most one row a character
    symbols = len(first) + 1
    root, unseen = _root({r["symbol"]: r["n"] for r in first if r["n"]}, symbols, seed)
    tables = _sampled(counts, root, unseen, True, seed).groupBy("symbol").agg(F.sum("tables").alias("n"))
    root, unseen = _root({r["symbol"]: r["n"] for r in tables.collect() if r["n"]}, symbols, seed)
    found = cut(_sampled(counts, root, unseen, False, seed + 1), "gram-probabilities")
    durable.discard(counts)
    return found


def _word_scores(words: DataFrame, table: DataFrame) -> DataFrame:
    """``(w, spelling)``: log10 probability of the spelling of each distinct word of ``words(w, word)``."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                word, contexts, symbol = grams(column(batch, "word").to_pylist())
                w = column(batch, "w").to_numpy()[word]
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(key_of(contexts[0], symbol))], names=["w", "key"])

    spelt = words.select("w", "word").mapInArrow(run, "w long, key long")
    table = table.select("key", F.log10("p").alias("l"))
    small = table.count() <= BROADCAST_ROWS
    return spelt.join(F.broadcast(table) if small else table, "key").groupBy("w").agg(F.sum("l").alias("spelling"))


def _seated(words: DataFrame, served: int, seed: int) -> DataFrame:
    """``(w, c, spelling, tables)`` of ``words(w, c, spelling)``: each word's mean number of tables over Gibbs samples."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c = column(batch, "c").to_numpy()
                base = np.power(10.0, column(batch, "spelling").to_numpy())
                part = Share(column(batch, "w").to_numpy(), served, seed)
                part.seat(c, base)
                tables = np.zeros(len(c))
                for number in range(BURN_IN + SAMPLES):
                    for _ in range(MOVES):
                        part.move(base)
                    tables += part.tables if number >= BURN_IN else 0
                yield pa.RecordBatch.from_arrays([*(column(batch, n) for n in ("w", "c", "spelling")), pa.array(tables / SAMPLES)], names=["w", "c", "spelling", "tables"])

    return words.select("w", "c", "spelling").mapInArrow(run, "w long, c long, spelling double, tables double")


def _steps(codes: np.ndarray, lengths: np.ndarray, n_words: int) -> np.ndarray:
    """``before * (n_words + 1) + word`` of each token, text ends included; ``n_words`` is a text's begin and its end."""
    word = np.full(len(codes) + len(lengths), n_words, np.int32)
    inside = np.ones(len(word), bool)
    inside[np.cumsum(lengths.astype(np.int64) + 1) - 1] = False
    word[inside] = codes
    steps = np.full(len(word), n_words * (n_words + 1), np.int64)
    np.multiply(word[:-1], n_words + 1, out=steps[1:], dtype=np.int64)
    steps += word
    return steps


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.unique`` with the inverse, in less memory: values are overwritten, and places are 32 bits."""
    order = np.argsort(values)
    values[:] = values[order]
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    number = np.cumsum(new, dtype=np.int32)
    number -= 1
    inverse = np.empty(len(values), np.int32)
    inverse[order] = number
    return values[new], inverse


def _squeezed(values: np.ndarray) -> bytes:
    """Integers as bytes of equal weight side by side, compressed, after their count."""
    flat = np.ascontiguousarray(values.astype("<i8")).view(np.uint8).reshape(-1, 8).T
    return len(values).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(flat).tobytes(), codec="zstd", asbytes=True)


def _restored(data: bytes) -> np.ndarray:
    count = int.from_bytes(data[:8], "little")
    if not count:
        return np.zeros(0, np.int64)
    flat = np.frombuffer(pa.decompress(data[8:], decompressed_size=8 * count, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, count).T).view("<i8").reshape(-1)


def _squeezed_steps(ascending: np.ndarray) -> bytes:
    return _squeezed(np.diff(ascending, prepend=ascending.dtype.type(0)).view(np.int64))


def _text_pieces(lengths: np.ndarray) -> list[tuple[int, int]]:
    """Where texts begin and end that have about ``PIECE`` tokens together, or are one text."""
    piece = np.cumsum(lengths.astype(np.int64) + 1) // PIECE
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(lengths)]
    return list(zip(cuts, cuts[1:], strict=False)) if len(lengths) else []


class _ChunkPairs:
    """A chunk's distinct pairs of words that follow each other, in the order of their keys.

    ``first`` and ``then`` are places among the chunk's words, the text's begin and end last; ``n`` is a pair's
    training count here, and ``of_step`` the place of each token's pair.
    """

    def __init__(self, chunk: pa.Table | pa.RecordBatch, i: int):
        self.lengths = chunk["lengths"][i].values.to_numpy()
        self.codes = _unpacked(chunk["codes"][i].as_py(), int(self.lengths.sum()))
        self.hashes = np.append(chunk["hashes"][i].values.to_numpy(), EDGE).astype(np.int64)
        size = len(self.hashes)
        ids, inverse = _distinct(_steps(self.codes, self.lengths, size - 1))
        first, then = ((f(ids, size)).astype(np.int32) for f in (np.floor_divide, np.remainder))
        del ids
        keys = pair_key(self.hashes[first], self.hashes[then])
        order = np.argsort(keys)
        back = np.empty(len(order), np.int32)
        back[order] = np.arange(len(order), dtype=np.int32)
        self.keys, self.first, self.then, self.of_step = keys[order], first[order], then[order], back[inverse]
        del keys, order, back, inverse, first, then
        learn = ~np.repeat(chunk["held"][i].values.to_numpy(zero_copy_only=False).astype(bool), self.lengths + 1)
        self.n = np.bincount(self.of_step[learn], minlength=len(self.keys))

    def starts(self, bits: int) -> np.ndarray:
        """Where each bucket's pairs begin, and the end."""
        return np.searchsorted(_bucket(self.keys, bits), np.arange((1 << bits) + 1))


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _hash(a.view(np.uint64), b.view(np.uint64))


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    """The first ``bits`` bits of keys."""
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _hashed(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk", "ids", "held", "lengths", "codes", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))


def _pairs(chunks: DataFrame, bits: int) -> DataFrame:
    """``(bucket, chunk, keys, n)``: each chunk's distinct pairs of a bucket and their training counts, packed."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, chunk = _ChunkPairs(batch, i), column(batch, "chunk")[i].as_py()
                starts = own.starts(bits)
                for bucket in np.flatnonzero(np.diff(starts)).tolist():
                    part = slice(starts[bucket], starts[bucket + 1])
                    values = [bucket, chunk, _squeezed_steps(own.keys[part]), _squeezed(own.n[part])]
                    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["bucket", "chunk", "keys", "n"])

    return _hashed(chunks).mapInArrow(run, "bucket long, chunk long, keys binary, n binary")


def _known(pairs: DataFrame) -> DataFrame:
    """``(bucket, chunk, places, c, numbers, owned)``: what a chunk can't tell of its pairs by itself.

    ``places`` among its pairs of the bucket, for those met more than once or only in another chunk, with their counts
    over all chunks, their numbers among the bucket's pairs met more than once, and whether the chunk is the one that owns them.
    """
    names = ["bucket", "chunk", "places", "c", "numbers", "owned"]

    @tidy_group
    def run(table: pa.Table) -> pa.Table:
        blocks = [np.cumsum(_restored(k.as_py()).view(np.uint64)) for k in table["keys"]]
        sizes, keys = [len(b) for b in blocks], np.concatenate(blocks)
        del blocks
        keys, inverse = _distinct(keys)
        n = np.concatenate([_restored(v.as_py()) for v in table["n"]])
        total = np.bincount(inverse, weights=n, minlength=len(keys)).astype(np.int64)
        del keys
        owner, owned = np.empty(len(total), np.int64), np.zeros(len(n), np.int64)
        owner[inverse] = np.arange(len(n))
        owned[owner] = 1
        c, number = total[inverse], (np.cumsum(total > 1) - 1)[inverse]
        found, begin = [[] for _ in names], 0
        for i, size in enumerate(sizes):
            own = slice(begin, begin + size)
            begin += size
            at = np.flatnonzero((c[own] > 1) | ((n[own] == 0) & (c[own] > 0)))
            if len(at):
                values = [table["bucket"][i].as_py(), table["chunk"][i].as_py(), _squeezed_steps(at), _squeezed(c[own][at]), _squeezed_steps(number[own][at]), _squeezed(owned[own][at])]
                for to, value in zip(found, values, strict=True):
                    to.append(value)
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
        return pa.table([pa.array(v, k) for v, k in zip(found, kinds, strict=True)], names=names)

    return pairs.groupBy("bucket").applyInArrow(run, "bucket long, chunk long, places binary, c binary, numbers binary, owned binary")


def _met(chunks: DataFrame, known: DataFrame, bits: int) -> DataFrame:
    """``(a, b, c, dishes, once, ends)``: pairs met more than once, by the chunk that owns them; and where ``b`` is
    null, of a chunk's word, the pairs that it begins, those of them met once, and those met once that it ends."""
    names = ["a", "b", "c", "dishes", "once", "ends"]

    @tidy_cogroup
    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        found = [[np.zeros(0, np.int64)] for _ in names]
        for i in range(len(texts)):
            own = _ChunkPairs(texts, i)
            starts, c, owned = own.starts(bits), own.n.copy(), np.zeros(len(own.n), bool)
            for j in range(len(known)):
                at = starts[known["bucket"][j].as_py()] + np.cumsum(_restored(known["places"][j].as_py()))
                c[at] = _restored(known["c"][j].as_py())
                owned[at] = _restored(known["owned"][j].as_py()) > 0
            many, once = np.flatnonzero(owned & (c > 1)), (c == 1) & (own.n == 1)
            size = len(own.hashes)
            singles = [np.bincount(x, minlength=size) for x in (own.first[once], own.then[once])]
            dishes = singles[0] + np.bincount(own.first[many], minlength=size)
            some = np.flatnonzero(dishes + singles[1])
            rest = np.full(len(some), -1)
            for to, values in zip(found, (own.hashes[some], rest, rest, dishes[some], singles[0][some], singles[1][some]), strict=True):
                to.append(values)
            rest = np.full(len(many), -1)
            for to, values in zip(found, (own.hashes[own.first[many]], own.hashes[own.then[many]], c[many], rest, rest, rest), strict=True):
                to.append(values)
        columns = [np.concatenate(x) for x in found]
        of_pair = columns[3] < 0
        gone = [None, ~of_pair, ~of_pair, of_pair, of_pair, of_pair]
        return pa.table([pa.array(v, pa.int64(), mask=m) for v, m in zip(columns, gone, strict=True)], names=names)

    own = _hashed(chunks).drop("ids").groupBy("chunk").cogroup(known.groupBy("chunk"))
    return own.applyInArrow(run, ", ".join(f"{n} long" for n in names))


def _pair_seats(met: DataFrame, dishes: DataFrame, words: DataFrame, n_texts: int, total: int, seed: int, bits: int) -> DataFrame:
    """``(a, b, c, tables, key, bucket)`` of ``met(a, b, c)``, pairs met more than once: their mean number of tables over Gibbs samples."""
    names = ["a", "b", "c", "tables", "key", "bucket"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c, base = column(batch, "c").to_numpy(), column(batch, "base").to_numpy()
                pair = pair_key(column(batch, "a").to_numpy(), column(batch, "b").to_numpy())
                part = Spread(pair.view(np.int64), column(batch, "dishes").to_numpy(), seed)
                part.seat(c, base)
                tables = np.zeros(len(c))
                for step in range(BURN_IN + SAMPLES):
                    for _ in range(MOVES):
                        part.move(base)
                    tables += part.tables if step >= BURN_IN else 0
                more = [pa.array(v) for v in (tables / SAMPLES, pair.view(np.int64), _bucket(pair, bits))]
                yield pa.RecordBatch.from_arrays([*(column(batch, n) for n in "abc"), *more], names=names)

    base = words.filter("c > 0").select(F.col("w").alias("b"), (F.col("c") / float(max(total, 1))).alias("base"))
    base = base.union(met.sparkSession.createDataFrame([(EDGE, n_texts / max(total, 1))], "b long, base double"))
    rows = met.join(base, "b").join(dishes, "a")
    return rows.select("a", "b", "c", "dishes", "base").mapInArrow(run, "a long, b long, c long, tables double, key long, bucket long")


def _masses(known: DataFrame, seats: DataFrame) -> DataFrame:
    """``(chunk, bucket, places, masses)``: what each pair of ``known`` has beside its context's share of the words, packed."""
    names = ["chunk", "bucket", "places", "masses"]

    @tidy_cogroup
    def run(known: pa.Table, seats: pa.Table) -> pa.Table:
        _, first = np.unique(seats["key"].to_numpy().view(np.uint64), return_index=True)
        tables = np.append(seats["tables"].to_numpy()[first], 1.0)
        masses = []
        for j in range(len(known)):
            c, number = _restored(known["c"][j].as_py()), np.cumsum(_restored(known["numbers"][j].as_py()))
            masses.append((c - DISCOUNT * tables[np.where(c > 1, number, -1)]).astype("<f4").tobytes())
        return pa.table([*(known[n] for n in names[:3]), pa.array(masses, pa.binary())], names=names)

    own = known.select("bucket", "chunk", "places", "c", "numbers").groupBy("bucket")
    return own.cogroup(seats.select("bucket", "key", "tables").groupBy("bucket")).applyInArrow(run, "chunk long, bucket long, places binary, masses binary")


def _word_places(chunks: DataFrame, bits: int) -> DataFrame:
    """``(bucket, chunk, keys)``: the hashes of each chunk's words of a bucket, ascending, packed."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys = np.sort(column(batch, "hashes")[i].values.to_numpy().astype(np.int64).view(np.uint64))
                starts, chunk = np.searchsorted(_bucket(keys, bits), np.arange((1 << bits) + 1)), column(batch, "chunk")[i].as_py()
                some = np.flatnonzero(np.diff(starts)).tolist()
                packed = [_squeezed_steps(keys[starts[b] : starts[b + 1]]) for b in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([chunk] * len(some), pa.int64()), pa.array(packed, pa.binary())], names=["bucket", "chunk", "keys"])

    return _hashed(chunks).select("chunk", "hashes").mapInArrow(run, "bucket long, chunk long, keys binary")


def _values(places: DataFrame, words: DataFrame, bits: int) -> DataFrame:
    """``(chunk, bucket, c, logp, tables, customers)``: those columns of ``words(w, ..)`` for the words of ``places``, packed."""

    @tidy_cogroup
    def run(places: pa.Table, words: pa.Table) -> pa.Table:
        keys = words["w"].to_numpy().view(np.uint64)
        order = np.argsort(keys, kind="stable")
        keys, columns = keys[order], {n: words[n].to_numpy()[order] for n in ("c", "logp", "tables", "customers")}
        found: dict[str, list] = {n: [] for n in columns}
        for packed in places["keys"]:
            at = np.searchsorted(keys, np.cumsum(_restored(packed.as_py()).view(np.uint64)))
            for name, values in columns.items():
                own = values[at]
                found[name].append(_squeezed(own if own.dtype.kind == "i" else own.astype("<f4").view("<i4")))
        return pa.table([places["chunk"], places["bucket"], *(pa.array(v, pa.binary()) for v in found.values())], names=["chunk", "bucket", *found])

    bucket = F.shiftrightunsigned("w", 64 - bits) if bits else F.lit(0).cast("long")
    own = words.withColumn("bucket", bucket).groupBy("bucket")
    return places.groupBy("bucket").cogroup(own).applyInArrow(run, "chunk long, bucket long, c binary, logp binary, tables binary, customers binary")


def scored(docs: DataFrame, held: Column, id_column: str = "doc_id", text_column: str = "text", seed: int = 5) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row of ``docs``.

    ``held`` marks rows that the model doesn't learn from.
    """
    chunks = cut(_chunks(docs, id_column, text_column, held), "chunks")
    entries = chunks.select(F.explode(F.arrays_zip("words", "train")).alias("e"))
    words = entries.groupBy(F.col("e.words").alias("word")).agg(F.sum("e.train").alias("c"))
    words = cut(words.withColumn("w", F.xxhash64("word")), "words")
    sums = words.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n_texts = chunks.select(F.size(F.filter("held", lambda h: ~h)).cast("long").alias("n")).agg(F.sum("n")).first()[0] or 0
    total, distinct = (sums["n"] or 0) + n_texts, sums["v"] + (n_texts > 0)

    tokens = chunks.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda t, x: t + x + 1))).first()[0] or 0
    bits = int(tokens // BUCKET_PAIRS).bit_length()
    shared = cut(_known(_pairs(chunks, bits)), "known-pairs")
    met = cut(_met(chunks, shared, bits), "pairs")
    of_word = met.filter("b is null").groupBy("a").agg(*(F.sum(n).alias(n) for n in ("dishes", "once", "ends")))
    of_word = cut(of_word, "pairs-of-words")
    pair_seats = cut(_pair_seats(met.filter("b is not null").select("a", "b", "c"), of_word.select("a", "dishes"), words, n_texts, total, seed, bits), "pair-seats")
    seats = of_word.select("a", F.col("once").cast("double").alias("tables"), F.col("once").alias("c")).union(pair_seats.select("a", "tables", "c"))
    contexts = cut(seats.groupBy("a").agg(F.sum("tables").alias("tables"), F.sum("c").alias("customers")), "contexts")
    seats = of_word.select(F.col("a").alias("b"), F.col("ends").cast("double").alias("tables")).union(pair_seats.select("b", "tables"))
    customers = cut(seats.groupBy("b").agg(F.round(F.sum("tables")).cast("long").alias("k")), "customers")
    for done in (met, of_word):
        durable.discard(done)
    edge = contexts.filter(F.col("a") == EDGE).first()
    edge = (edge["tables"], edge["customers"]) if edge else (0.0, 0)
    ends = customers.filter(F.col("b") == EDGE).first()
    ends, all_customers = ends["k"] if ends else 0, customers.agg(F.sum("k")).first()[0] or 0

    table = probabilities(words.select("word", F.least("c", F.lit(1).cast("long")).alias("c")), min(n_texts, 1), seed)
    end_key = int(key_of(np.array(_end_contexts()[:1]), np.array([END]))[0])
    end_spelt = float(table.filter(F.col("key") == end_key).first()["p"])
    drawn = words.select("w").join(customers, F.col("w") == F.col("b"), "left").select("w", F.coalesce("k", F.lit(0)).cast("long").alias("c"))
    seated = cut(_seated(drawn.join(_word_scores(words, table), "w"), distinct, seed), "seats")
    served = DISCOUNT * ((seated.agg(F.sum("tables")).first()[0] or 0) + (n_texts > 0)) + STRENGTH
    end_p = float(np.log10((ends - DISCOUNT * (n_texts > 0) + served * end_spelt) / (STRENGTH + all_customers)))
    mass = F.col("c") - DISCOUNT * F.col("tables") + served * F.pow(F.lit(10.0), "spelling")
    logp = F.when(F.col("c") > 0, F.log10(mass)).otherwise(F.lit(float(np.log10(served))) + F.col("spelling")) - float(np.log10(STRENGTH + all_customers))
    known = seated.select("w", logp.alias("logp")).join(words.select("w", "c"), "w").join(contexts.withColumnRenamed("a", "w"), "w", "left")
    known = known.select("w", "c", "logp", F.coalesce("tables", F.lit(0.0)).alias("tables"), F.coalesce("customers", F.lit(0)).cast("long").alias("customers"))
    known = cut(known, "word-values")
    for done in (words, customers, contexts, seated, table):
        durable.discard(done)
    looked = cut(_values(_word_places(chunks, bits), known, bits), "chunk-values")
    looked = looked.unionByName(_masses(shared, pair_seats), allowMissingColumns=True)
    floor = np.log10(total + 0.5 * (distinct + 1))
    names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    @tidy_cogroup
    def run(texts: pa.Table, entries: pa.Table) -> pa.Table:
        of_words = entries.filter(pc.is_valid(entries["c"]))
        of_pairs = entries.filter(pc.is_null(entries["c"]))
        found = [[] for _ in names]
        for i in range(len(texts)):
            row = {n: texts[n][i].values for n in ("ids", "held")}
            pairs = _ChunkPairs(texts, i)
            lengths, codes, first, then, starts = pairs.lengths, pairs.codes, pairs.first, pairs.then, pairs.starts(bits)
            size = len(pairs.hashes) - 1
            c, logp, tables, customers = np.zeros(size), np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
            logp[size], tables[size], customers[size] = end_p, *edge
            order = np.argsort(pairs.hashes[:size].view(np.uint64), kind="stable")
            begins = np.searchsorted(_bucket(pairs.hashes[:size].view(np.uint64)[order], bits), np.arange((1 << bits) + 1))
            for j in range(len(of_words)):
                bucket = of_words["bucket"][j].as_py()
                at = order[begins[bucket] : begins[bucket + 1]]
                c[at], customers[at] = (_restored(of_words[n][j].as_py()) for n in ("c", "customers"))
                logp[at], tables[at] = (_restored(of_words[n][j].as_py()).astype("<i4").view("<f4") for n in ("logp", "tables"))
            masses = (1 - DISCOUNT) * (pairs.n > 0)
            for j in range(len(of_pairs)):
                place = starts[of_pairs["bucket"][j].as_py()] + np.cumsum(_restored(of_pairs["places"][j].as_py()))
                masses[place] = np.frombuffer(of_pairs["masses"][j].as_py(), "<f4")
            steps = masses  # overwritten bit by bit
            for begin in range(0, len(masses), PIECE):
                part = slice(begin, begin + PIECE)
                left = np.log10(STRENGTH + DISCOUNT * tables[first[part]]) + logp[then[part]]
                some = masses[part] > 0
                total_mass = np.log10(np.where(some, masses[part], 1) + np.power(10.0, left))
                steps[part] = np.where(some, total_mass, left) - np.log10(STRENGTH + customers[first[part]])
            met, smooth = (c > 0).astype(float), np.log10(c + 0.5)
            sums, score = [np.zeros(len(lengths)), np.zeros(len(lengths))], np.zeros(len(lengths))
            ends = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
            for begin, stop in _text_pieces(lengths):
                own, texts_there = codes[ends[begin] : ends[stop]], np.arange(stop - begin)
                owner = np.repeat(texts_there, lengths[begin:stop])
                for to, v in zip(sums, (met, smooth), strict=True):
                    to[begin:stop] = np.bincount(owner, weights=v[own], minlength=stop - begin)
                owner = np.repeat(texts_there, lengths[begin:stop] + 1)
                score[begin:stop] = np.bincount(owner, weights=steps[pairs.of_step[ends[begin] + begin : ends[stop] + stop]], minlength=stop - begin)
            found[0] += row["ids"].to_pylist()
            found[1] += row["held"].to_pylist()
            found[2] += (lengths.astype(np.int64) + 1).tolist()
            found[3] += (sums[0].astype(np.int64) + int(n_texts > 0)).tolist()
            found[4] += [int(total)] * len(lengths)
            found[5] += (sums[1] + np.log10(n_texts + 0.5) - (lengths + 1) * floor).tolist()
            found[6] += score.tolist()
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(v, k) for v, k in zip(found, kinds, strict=True)], names=names)

    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _hashed(chunks).groupBy("chunk").cogroup(looked.groupBy("chunk")).applyInArrow(run, schema)


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity per token of held-out and training texts."""
    per_token = -F.sum("score") / F.sum("n_tokens")
    return scores.groupBy("held_out").agg(F.pow(F.lit(10.0), per_token).alias("perplexity"))


def held_out(id_column: str = "doc_id") -> Column:
    return id_remainder(id_column, 5) == 1
