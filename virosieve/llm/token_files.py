"""Token ids of texts as compressed files, in ascending order of the documents' ids.

Texts are cut at white space, and words from the marks they end in; distinct ones go through the tokenizer, and
ids are taken by number: no token reaches across these cuts. The files (``write``) are a Parquet folder each:

* ``blocks``: ``part, block, first, doc_ids, lengths, payload``: whole documents of ``BLOCK`` ids or a little more, a
  longer document being a block of its own; the payload is in the format of ``rans``. Any task can decode any
  block, and check it by its checksum. ``first`` counts the part's ids ahead of the block.
* ``table``: the shared frequency of each id, from the counts of all documents.
* ``parts``: how many ids precede each part. Parts are ranges of document ids.

Spark writes the folders, so a lost executor's attempt leaves nothing behind.

Nulls: a null text counts as empty and has the end id alone. A null document id sorts first. Repeated rows
stay repeated, next to each other. An empty table gives empty folders and reads back as no rows. Only the id
and text columns are read.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from virosieve.llm import rans
from virosieve.llm.text import column, small_batches
from virosieve.plans.durable import cut

BLOCK = 1 << 16
END_ID = 1
_TOGETHER = 32  # blocks coded at once
#: Marks that a word may end in. They stand in no special token, and the tokenizer cuts before a run of them.
_TAIL = ".,;:!?#$%&*"
_CACHE = 700_000
#: Bytes of text encoded at once.
BATCH = 10 << 20


#: Letters below this one (the end of Latin Extended-B) are composed already, and keep their case in every version.
_PLAIN = "\u0250"
#: How the tokenizer's model shows bytes: those without a sign of their own as the letters from 256 on, in order.
_HIDDEN = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
_SHOWN = {b: 256 + i for i, b in enumerate(_HIDDEN)}


class WordTable:
    """Ids of the words that a worker has met; it starts anew when ``_CACHE`` is reached, which costs time only."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _check(definition)
        self.library = Tokenizer.from_str(definition)
        self.model = self.library.model
        self.known: dict[bytes, bytes] = {b"": b""}

    def ids(self, words: pa.Array) -> pa.Array:
        """The ids of each of the distinct lower-cased words as little-endian unsigned 32-bit integers in a binary value."""
        data, ends = words.buffers()[2], np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1].tolist()
        raw = data.to_pybytes() if data is not None else b""
        listed = [raw[i:j] for i, j in zip(ends, ends[1:], strict=False)]
        if len(self.known) + len(listed) > _CACHE:
            self.known = {b"": b""}
        found = list(map(self.known.get, listed))
        fresh = [i for i, ids in enumerate(found) if ids is None]
        for start in range(0, len(fresh), 20_000):
            piece = fresh[start : start + 20_000]
            for i, ids in zip(piece, self._spelt([listed[i].decode() for i in piece]), strict=True):
                found[i] = self.known[listed[i]] = ids
        return pa.array(found, pa.large_binary())


    def _spelt(self, words: list[str]) -> list[bytes]:
        """The ids of each word.

        A word of plain lower-case letters is in the form that the library's normaliser gives and is one of its words,
        so its bytes go to the library's model at once, which takes a fifth of the time; others go the whole way.
        """
        out: list = [None] * len(words)
        rest = []
        for i, word in enumerate(words):
            if word.isalpha() and max(word) < _PLAIN and word.lower() == word:
                shown = word if word.isascii() else word.encode().decode("latin-1").translate(_SHOWN)
                out[i] = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
            else:
                rest.append(i)
        for i, encoding in zip(rest, self.library.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = array("I", encoding.ids).tobytes()
        return out


def _check(definition: str) -> None:
    """Raise if the tokenizer may join what is cut here: it must lower-case, and cut at blanks and around letters."""
    parts = json.loads(definition)
    steps = (parts["normalizer"] or {}).get("normalizers", [])
    cutters = (parts["pre_tokenizer"] or {}).get("pretokenizers", [])
    patterns = [c["pattern"].get("Regex", "") for c in cutters if c["type"] == "Split" and c["behavior"] == "Removed" and c["invert"]]
    fits = (
        {"type": "Lowercase"} in steps
        and {s["type"] for s in steps} <= {"NFC", "Replace", "Lowercase"}
        and len(patterns) == 1
        and r"[^\s\p{L}\p{N}]+" in patterns[0]
        and all(c["type"] != "ByteLevel" or not (c["add_prefix_space"] or c["use_regex"]) for c in cutters)
        and [c["type"] for c in cutters] == ["Split", "ByteLevel"]
        and parts["model"]["type"] == "BPE"
        and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in parts["added_tokens"])
    )
    if not fits or array("I").itemsize != 4:
        raise ValueError("this tokenizer can't be applied word by word: it must lower-case and cut words at blanks and marks")


_tables: dict[str, WordTable] = {}


def _table_of(definition: str) -> WordTable:
    if definition not in _tables:
        _tables[definition] = WordTable(definition)
    return _tables[definition]


#: What the tokenizer lower-cases in ASCII, and the bytes that part words.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_ALNUM = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
_MARK = np.isin(np.arange(256), [ord(c) for c in _TAIL])


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of some texts, and which are in words; where each piece of a word starts and stops in
    them; the text of each piece.

    A word's pieces are the word without the marks it ends in, and these marks, which the tokenizer cuts apart;
    a word whose marks follow another mark is one piece.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    low = _LOWER[raw]
    inside = ~_BLANK[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(raw)]
    first[begins] = inside[begins]
    start = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= first[1:] | ~inside[1:]
    stop = np.flatnonzero(last) + 1
    if not len(start):
        return low, inside, start, stop, np.zeros(0, np.int64)
    # the run of marks that ends at a byte: how far back the last byte that is none lies
    at = np.where(_MARK[raw], 0, np.arange(1, len(raw) + 1))
    body = np.maximum(np.maximum.accumulate(at)[stop - 1], start)  # where the run at the word's end begins
    plain = (body == start) | _ALNUM[raw[np.maximum(body - 1, 0)]]
    body = np.where(plain, body, stop)
    starts, stops = np.stack([start, body], 1).ravel(), np.stack([body, stop], 1).ravel()
    keep = stops > starts
    text = np.repeat(np.searchsorted(offsets, start, side="right") - 1, 2)
    return low, inside, starts[keep], stops[keep], text[keep]


def _encoded(definition: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in a row, and how many each text has."""
    low, inside, start, stop, text = _words(texts)
    sizes = stop - start
    ends = np.concatenate([[0], np.cumsum(sizes)])
    # every byte that is no blank is in one piece
    coded = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(low[inside])).dictionary_encode()
    spelt = _table_of(definition).ids(coded.dictionary).take(coded.indices)
    if not len(spelt):
        return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
    at = np.frombuffer(spelt.buffers()[1], np.int64)[spelt.offset : spelt.offset + len(spelt) + 1]
    ids = np.frombuffer(spelt.buffers()[2] or b"", "<u4")[at[0] // 4 : at[-1] // 4]
    return ids, np.bincount(text, np.diff(at) // 4, len(texts)).astype(np.int64)


def _with_ends(ids: np.ndarray, counts: np.ndarray, end_id: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids with the end id after each text, and where each text ends."""
    ends = np.cumsum(counts + 1)
    out = np.empty(len(ids) + len(counts), kind)
    body = np.ones(len(out), bool)
    body[ends - 1] = False
    out[body] = ids
    out[ends - 1] = end_id
    return out, ends


def encode_texts(definition: str, texts: pa.Array, end_id: int) -> list[np.ndarray]:
    """Ids of each text, with the end id, as unsigned 32-bit integers."""
    out, ends = _with_ends(*_encoded(definition, texts), end_id, "<u4")
    return np.split(out, ends[:-1]) if len(ends) else []


def tokenized(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = END_ID) -> DataFrame:
    """``(doc_id, ids)`` per row, ids as little-endian integers of ``_width`` in a binary value.

    Each task adds one row without ids, whose ``counts`` tells how often it has met each id; other rows have none.
    """
    with open(tokenizer_path, encoding="utf-8") as file:  # a few megabytes; travels with the tasks
        definition = docs.sparkSession.sparkContext.broadcast(file.read())
    size = _vocabulary_size(definition.value, end_id)
    kind = _width(size)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in small_batches(batches, "text", BATCH):
            out, ends = _with_ends(*_encoded(definition.value, column(batch, "text")), end_id, kind)
            at = np.concatenate([[0], ends]) * out.itemsize
            ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(out)])
            total += np.bincount(out, minlength=size)
            none = pa.nulls(batch.num_rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), ids.cast(pa.binary()), none], names=["doc_id", "ids", "counts"])
        if total.any():
            last = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(last, names=["doc_id", "ids", "counts"])

    return rows.mapInArrow(run, "doc_id long, ids binary, counts array<long>")


def _vocabulary_size(definition: str, end_id: int) -> int:
    return max(_table_of(definition).library.get_vocab_size(), end_id + 1)


def _width(vocabulary: int) -> str:
    """Integers between the jobs are as narrow as the vocabulary allows."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _counts(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id below ``size`` occurs in all documents, from the tasks' counts."""
    each = tokens.filter("counts is not null").select(F.posexplode("counts").alias("token", "n")).filter("n > 0")
    counts = np.zeros(size, np.int64)
    for row in each.groupBy("token").agg(F.sum("n").alias("n")).collect():  # at most one row for each id of the vocabulary
        counts[row["token"]] = row["n"]
    return counts


def write(docs: DataFrame, tokenizer_path: str, path: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = END_ID) -> str:
    """Tokenise ``docs`` and write the files below ``path``; returns ``path``."""
    spark = docs.sparkSession
    tokens = cut(tokenized(docs, tokenizer_path, id_column, text_column, end_id), "tokens")
    with open(tokenizer_path, encoding="utf-8") as file:
        size = _vocabulary_size(file.read(), end_id)
    kind = _width(size)
    frequency = rans.Table.of_counts(_counts(tokens, size)).frequency.astype(np.int64)
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(frequency)], "token int, frequency int").coalesce(1).write.parquet(f"{path}/table")
    held = spark.sparkContext.broadcast(frequency.astype(np.uint32))
    names = ["part", "block", "first", "doc_ids", "lengths", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(held.value)
        part, number, before = 0, 0, 0
        blocks: list[tuple[list, list, list]] = []
        ids: list = []
        docs_in: list = []
        filled = 0

        def coded() -> pa.RecordBatch:
            nonlocal number, before
            sizes = [sum(map(len, b[1])) for b in blocks]
            firsts = (before + np.cumsum(sizes) - sizes).tolist()
            payloads = rans.encode([np.concatenate(b[1]) for b in blocks], table)
            arrays = [
                pa.array([part] * len(blocks), pa.int32()),
                pa.array(range(number, number + len(blocks)), pa.int32()),
                pa.array(firsts, pa.int64()),
                pa.array([b[0] for b in blocks], pa.list_(pa.int64())),
                pa.array([[len(x) for x in b[1]] for b in blocks], pa.list_(pa.int32())),
                pa.array(payloads, pa.binary()),
            ]
            number += len(blocks)
            before += sum(sizes)
            blocks.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            for doc_id, value, part in zip(column(batch, "doc_id").to_pylist(), column(batch, "ids"), column(batch, "part").to_pylist(), strict=True):
                docs_in.append(doc_id)
                ids.append(np.frombuffer(value.as_py(), kind))
                filled += len(ids[-1])
                if filled >= BLOCK:
                    blocks.append((docs_in, ids))
                    docs_in, ids, filled = [], [], 0
                    if len(blocks) == _TOGETHER:
                        yield coded()
        if docs_in:
            blocks.append((docs_in, ids))
        if blocks:
            yield coded()

    # ids that are null or repeated are dealt by a digest of their tokens, too
    texts = tokens.filter("ids is not null").select("doc_id", "ids")
    ordered = texts.repartitionByRange("doc_id", F.xxhash64("ids")).sortWithinPartitions("doc_id", F.xxhash64("ids"), "ids").withColumn("part", F.spark_partition_id())
    ordered.mapInArrow(run, "part int, block int, first long, doc_ids array<long>, lengths array<int>, payload binary").write.parquet(f"{path}/blocks")
    sizes = spark.read.parquet(f"{path}/blocks").select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n).alias("n"))
    sums = sizes.groupBy("part").agg(F.sum("n").alias("n"))  # a row for each part
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums.select("part", F.coalesce(before, F.lit(0).cast("long")).alias("start")).coalesce(1).write.parquet(f"{path}/parts")
    return path


def read(spark: SparkSession, path: str, digests: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of each document, or ``ids_crc32`` in place of ids, from the files."""
    table = spark.read.parquet(f"{path}/table").orderBy("token").collect()  # the vocabulary
    held = spark.sparkContext.broadcast(np.array([r["frequency"] for r in table], np.uint32))
    blocks, parts = spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/parts")
    # one row for each part, which is a partition of the writer: at most as many as its tasks
    rows = blocks.join(F.broadcast(parts), "part").withColumn("start", F.col("start") + F.col("first")).drop("first")
    names = ["doc_id", "start", "n_tokens", "ids_crc32" if digests else "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(held.value)
        for whole in batches:
            for at in range(0, whole.num_rows, _TOGETHER):
                batch = whole.slice(at, _TOGETHER)
                found = rans.decode([p.as_py() for p in column(batch, "payload")], table)
                doc_ids, starts_out, counts, values = [], [], [], []
                for ids, start, own, lengths in zip(found, column(batch, "start").to_pylist(), column(batch, "doc_ids").to_pylist(), column(batch, "lengths").to_pylist(), strict=True):
                    ends = np.cumsum(lengths)
                    doc_ids += own
                    counts += lengths
                    starts_out += (start + ends - lengths).tolist()
                    for piece in np.split(ids, ends[:-1]):
                        values.append(zlib.crc32(piece.astype("<u4").tobytes()) if digests else piece.astype(np.int32))
                kind = pa.int64() if digests else pa.list_(pa.int32())
                arrays = [pa.array(doc_ids, pa.int64()), pa.array(starts_out, pa.int64()), pa.array(counts, pa.int64()), pa.array(values, kind)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    last = "ids_crc32 long" if digests else "ids array<int>"
    return rows.mapInArrow(run, f"doc_id long, start long, n_tokens long, {last}")
