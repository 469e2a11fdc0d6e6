"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

A text is escaped (blanks become U+2581, one is put in front) and cut where no piece of the vocabulary can
reach across: around line feeds, ahead of a run of blanks, and between any two characters that stand side by
side in no piece. Such units are merged independently. All distinct new units of a batch lie in one flat
array of symbols. A round finds each unit's best pair rank (a segmented minimum), merges its leftmost pair of
that rank in all units at once, and drops units without a pair left. The library takes the best pair of the
whole text, leftmost first among equals; cut into units that is the same, unit by unit.

Characters outside the vocabulary become their UTF-8 bytes' pieces. Arrow cuts a batch of texts into units and
numbers the distinct ones; only these are merged, and their ids are then taken by number. Nothing is kept from
batch to batch. No shuffle; whole texts.

Nulls: a null text counts as empty and has the end id alone. Repeated rows stay repeated. An empty table gives
an empty result. Other columns are carried along untouched in ``row``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from virosieve.llm.text import column, small_batches, tidy

_BLANK = "▁"
_NONE = np.iinfo(np.int32).max


class Encoder:
    """Vocabulary tables of one model."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        lib, size = self.library, self.library.get_piece_size()
        self.end = lib.eos_id()
        pieces = {}
        for i in range(size):
            if not (lib.is_unknown(i) or lib.is_control(i) or lib.is_byte(i)):
                pieces.setdefault(lib.id_to_piece(i), i)
        self.byte_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        # single characters that stand in pieces without being one take symbols after the vocabulary
        symbols = dict(pieces)
        for c in sorted({c for p in pieces for c in p}):
            symbols.setdefault(c, len(symbols) + size)
        self.span = max(symbols.values(), default=0) + 1
        self.size = size
        self.symbol_of = np.full(0x110000, -1, np.int64)
        for s, i in symbols.items():
            if len(s) == 1:
                self.symbol_of[ord(s)] = i
        order = {score: rank for rank, score in enumerate(sorted({lib.get_score(i) for i in pieces.values()}, reverse=True))}
        pairs = {}
        for p, i in pieces.items():
            for at in range(1, len(p)):
                left, right = symbols.get(p[:at]), symbols.get(p[at:])
                if left is not None and right is not None:
                    pairs[left * self.span + right] = (order[lib.get_score(i)], i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        self.beside = np.array(sorted({ord(a) << 21 | ord(b) for p in pieces for a, b in zip(p, p[1:], strict=False)}), np.int64)
        if any(_BLANK in p.lstrip(_BLANK) or ("\n" in p and len(p) > 1) for p in pieces):
            raise ValueError("pieces of this model reach across blanks or lines")
        self.units = re.compile(f"\n|{_BLANK}*[^{_BLANK}\n]+|{_BLANK}+")
        self.shown = pa.array([f"{i} " for i in range(size)], pa.large_binary())

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or ``_NONE``) and merged symbol of each pair."""
        if not len(self.keys):
            return np.full(len(left), _NONE, np.int32), np.zeros(len(left), np.int64)
        key = np.where((left < 0) | (right < 0), -1, left * self.span + right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE).astype(np.int32), self.merged[at]

    def merge(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(symbols, places, unit, points)``: final symbols in order, the point each begins at, its unit, all points."""
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        unit = np.repeat(np.arange(len(units)), [len(u) for u in units])
        symbol = self.symbol_of[points]
        fits = np.zeros(len(points), bool)  # may be merged with the next
        if len(points) > 1 and len(self.beside):
            both = points[:-1] << 21 | points[1:]
            at = np.minimum(np.searchsorted(self.beside, both), len(self.beside) - 1)
            fits[:-1] = (self.beside[at] == both) & (unit[:-1] == unit[1:])
        group = np.concatenate([[0], np.cumsum(~fits[:-1])]) if len(points) else np.zeros(0, np.int64)
        place = np.arange(len(points))
        done = []
        rank, merged = np.full(len(points), _NONE, np.int32), np.zeros(len(points), np.int64)
        if fits.any():
            rank[:-1], merged[:-1] = self._pairs(symbol[:-1], symbol[1:])
            rank[~fits] = _NONE
        while len(symbol):
            begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            best = np.minimum.reduceat(rank, begin)
            sizes = np.diff(np.append(begin, len(group)))
            live = np.repeat(best != _NONE, sizes)
            if not live.all():  # compaction: what has no pair left is final
                done.append((place[~live], symbol[~live]))
                place, symbol, group, rank, merged = (x[live] for x in (place, symbol, group, rank, merged))
                if not len(symbol):
                    break
                sizes, best = sizes[best != _NONE], best[best != _NONE]
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            hit = hit[np.concatenate([[True], group[hit][1:] != group[hit][:-1]])]  # leftmost of each unit
            symbol[hit] = merged[hit]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))  # where the merged symbols are once their right parts are gone
            place, symbol, group, rank, merged = (x[keep] for x in (place, symbol, group, rank, merged))
            for left in (at, at[at > 0] - 1):  # only pairs beside a merge are new
                inside = left + 1 < len(symbol)
                rank[left[~inside]] = _NONE
                left = left[inside]
                new_rank, new_merged = self._pairs(symbol[left], symbol[left + 1])
                rank[left] = np.where(group[left] == group[left + 1], new_rank, _NONE)
                merged[left] = new_merged
        if done:
            place, symbol = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
            order = np.argsort(place, kind="stable")
            place, symbol = place[order], symbol[order]
        return symbol, place, unit, points

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All units of the texts in order, and how many each text has."""
        texts = texts.cast(pa.large_string())
        # runs of blanks, a blank in front, or the escape character itself: cut by the pattern instead
        odd = pc.match_substring_regex(texts, f"  |^ |{_BLANK}").to_numpy(zero_copy_only=False).astype(bool)
        marked = pc.replace_substring(pc.replace_substring(texts, " ", f" {_BLANK}"), "\n", " \n ")
        some = pc.greater(pc.binary_length(texts), 0)
        none, first = pa.scalar("", pa.large_string()), pa.scalar(_BLANK, pa.large_string())
        marked = pc.binary_join_element_wise(first, marked, none)
        listed = pc.split_pattern(pc.if_else(pc.and_not(some, pa.array(odd, pa.bool_())), marked, none), " ")
        counts = pc.list_value_length(listed).to_numpy().astype(np.int64)
        units = listed.flatten()
        if odd.any():
            rows = units.to_pylist()
            ends = np.cumsum(counts)
            mixed: list[str] = []
            for i, one in enumerate(odd.tolist()):
                if one:
                    found = self.units.findall(_BLANK + texts[i].as_py().replace(" ", _BLANK))
                else:
                    found = rows[ends[i] - counts[i] : ends[i]]
                counts[i] = len(found)
                mixed += found
            units = pa.array(mixed, pa.large_string())
        return units, counts

    def _ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in a row, and how many each unit has."""
        symbol, place, unit, points = self.merge(units)
        owner = unit[place]
        strange = np.flatnonzero((symbol < 0) | (symbol >= self.size))
        if len(strange):
            spelt = [[self.byte_ids[b] for b in chr(c).encode()] for c in points[place[strange]].tolist()]
            width = np.ones(len(symbol), np.int64)
            width[strange] = [len(x) for x in spelt]
            begin = (np.cumsum(width) - width)[strange]
            symbol, owner = np.repeat(symbol, width), np.repeat(owner, width)
            for at, x in zip(begin.tolist(), spelt, strict=True):
                symbol[at : at + len(x)] = x
        return symbol.astype(np.int32), np.bincount(owner, minlength=len(units))

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, bytes]]:
        """Ids with the end id, and the same as decimal text, of each text (none may be null)."""
        units, counts = self._cut(texts)
        coded = units.dictionary_encode()
        ids, width = self._ids(coded.dictionary.to_pylist())
        offsets = pa.array(np.concatenate([[0], np.cumsum(width)]), pa.int64())
        # the ids of each distinct unit, and their decimal text, as binary values to take by number
        as_bytes = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(width), [None, pa.array(offsets.to_numpy() * 4).buffers()[1], pa.py_buffer(ids)])
        decimal = self.shown.take(pa.array(ids))
        ends = np.frombuffer(decimal.buffers()[1], np.int64)[offsets.to_numpy()] if len(ids) else np.zeros(len(width) + 1, np.int64)
        shown = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(width), [None, pa.py_buffer(ends), decimal.buffers()[2]])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        taken = []
        for values in (as_bytes, shown):
            got = values.take(coded.indices)
            at = np.frombuffer(got.buffers()[1], np.int64)[bounds] if len(got) else np.zeros(len(bounds), np.int64)
            taken.append((memoryview(got.buffers()[2] or b""), at.tolist()))
        (id_data, id_at), (text_data, text_at) = taken
        last, end = str(self.end).encode(), np.array([self.end], np.int32)
        for i in range(len(texts)):
            own = np.frombuffer(id_data[id_at[i] : id_at[i + 1]], np.int32)
            yield np.concatenate([own, end]), bytes(text_data[text_at[i] : text_at[i + 1]]) + last


#: Bytes of text encoded at once.
BATCH = 2 << 20

_encoders: dict[bytes, Encoder] = {}


def encoder(model: bytes) -> Encoder:
    """One encoder for each worker process and model."""
    key = hashlib.sha256(model).digest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(model)
    return _encoders[key]


def encoded(docs: DataFrame, model_path: str, text_column: str = "text", with_ids: bool = True, with_decoded: bool | None = None,
            carried: list[str] | None = None) -> DataFrame:
    """``(row, n_tokens, ids_sha256, decoded_sha256[, ids][, decoded])`` per row of ``docs``.

    The digests are of the decimal ids joined by one space and of the text that the library decodes from them.
    ``row`` holds the columns in ``carried`` (all by default); leave the text out of them where it isn't needed
    again, so that it crosses to the workers once and doesn't come back.
    """
    with_decoded = with_ids if with_decoded is None else with_decoded
    with open(model_path, "rb") as file:  # under a megabyte; travels with the tasks
        model = file.read()
    text = F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("text")
    packed = docs.select(F.struct(*[docs[c] for c in carried or docs.columns]).alias("row"), text)
    schema = packed.select("row").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType()))
    if with_decoded:
        schema = schema.add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in small_batches(batches, "text", BATCH):
            counts, digests, plain, all_ids, all_texts = [], [], [], [], []
            for ids, shown in enc.encode(column(batch, "text")):
                text = enc.library.decode(ids.tolist())
                counts.append(len(ids))
                digests.append(sha(shown))
                plain.append(sha(text.encode()))
                if with_ids:
                    all_ids.append(ids)
                if with_decoded:
                    all_texts.append(text)
            arrays = [column(batch, "row"), pa.array(counts, pa.int64()), pa.array(digests), pa.array(plain)]
            if with_ids:
                arrays.append(pa.array(all_ids, pa.list_(pa.int32())))
            if with_decoded:
                arrays.append(pa.array(all_texts, pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return packed.mapInArrow(tidy(run), schema)
