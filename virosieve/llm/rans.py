"""Static range asymmetric numeral coding of token ids, in independent blocks of interleaved lanes.

Id ``i`` of a block belongs to lane ``i % LANES``; all lanes of all blocks at hand advance together, one id a
step. Lane states lie in [2^31, 2^63); a state that leaves the range passes 32 bits to the block's stream.
A block is self-contained but for the shared frequency table::

    magic, lanes, ids, steps between checkpoints, checkpoints, words      (six little-endian 32-bit integers)
    each checkpoint: words read so far (8 bytes), the lanes' states (8 bytes each); the first is the start
    the stream: 32-bit words
    CRC-32 of all of the above

Decoding may begin at any checkpoint.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

LANES = 64
BITS = 20
CHECKPOINT = 512
MAGIC = 0x534E4152
_LOW = np.uint64(1 << 31)
_MASK = np.uint64((1 << BITS) - 1)
_WORD = np.uint64(32)


@dataclass
class Table:
    """Frequencies of all ids, which sum to ``2 ** BITS``; each is at least 1, so any id can be coded."""

    frequency: np.ndarray

    def __post_init__(self):
        self.frequency = self.frequency.astype(np.uint64)
        self.first = np.cumsum(self.frequency) - self.frequency
        self.symbol_at = np.repeat(np.arange(len(self.frequency), dtype=np.uint32), self.frequency.astype(np.int64))

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        """Proportional to ``counts`` as far as whole numbers go; what is left goes to the commonest id."""
        free = (1 << BITS) - len(counts)
        if free < 0:
            raise ValueError("more ids than the table has slots")
        total = max(int(counts.sum()), 1)
        frequency = np.array([1 + int(c) * free // total for c in counts.tolist()], np.int64)
        frequency[int(np.argmax(counts))] += (1 << BITS) - int(frequency.sum())
        return cls(frequency)


def _steps(sizes: np.ndarray) -> np.ndarray:
    return -(-sizes // LANES)


def encode(blocks: list[np.ndarray], table: Table) -> list[bytes]:
    """Each block's bytes."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    sizes = np.array([len(blocks[i]) for i in order], np.int64)
    steps = _steps(sizes)
    begin = np.cumsum(sizes) - sizes
    ids = np.concatenate([blocks[i] for i in order]).astype(np.int64) if len(blocks) else np.zeros(0, np.int64)
    lane = np.arange(LANES)
    state = np.full((len(blocks), LANES), _LOW, np.uint64)
    words, owners, marks = [], [], []
    for step in range(int(steps.max(initial=0)) - 1, -1, -1):
        k = int(np.searchsorted(-steps, -step, side="left"))  # blocks that reach this step come first
        at = step * LANES + lane[None, :]
        valid = at < sizes[:k, None]
        symbol = ids[np.minimum(begin[:k, None] + at, len(ids) - 1)]
        f, c, x = table.frequency[symbol], table.first[symbol], state[:k]
        full = valid & (x >= f << np.uint64(63 - BITS))
        out = np.nonzero(full)
        words.append((x[out] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        owners.append(out[0])
        x = np.where(full, x >> _WORD, x)
        state[:k] = np.where(valid, ((x // f) << np.uint64(BITS)) + x % f + c, x)
        if step % CHECKPOINT == 0:
            marks.append((step, k, state[:k].copy()))
    owner = np.concatenate(owners[::-1]) if owners else np.zeros(0, np.int64)
    word = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    stable = np.argsort(owner, kind="stable")
    word = word[stable]
    n_words = np.bincount(owner, minlength=len(blocks))
    word_at = np.cumsum(n_words) - n_words
    # words that the steps before each checkpoint consume
    used = {}
    seen = np.zeros(len(blocks), np.int64)
    for step, found in enumerate(reversed(owners)):
        if step % CHECKPOINT == 0:
            used[step] = seen.copy()
        seen += np.bincount(found, minlength=len(blocks))
    result: list[bytes] = [b""] * len(blocks)
    marks.sort(key=lambda m: m[0])
    for b, original in enumerate(order):
        own = [(used[step][b], states[b]) for step, k, states in marks if b < k]
        parts = [np.array([MAGIC, LANES, sizes[b], CHECKPOINT, len(own), n_words[b]], "<u4").tobytes()]
        parts += [np.uint64(at).tobytes() + states.astype("<u8").tobytes() for at, states in own]
        parts.append(word[word_at[b] : word_at[b] + n_words[b]].astype("<u4").tobytes())
        body = b"".join(parts)
        result[original] = body + zlib.crc32(body).to_bytes(4, "little")
    return result


def _open(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Header, words read and states at each checkpoint, and the stream of one block."""
    if len(data) < 28 or zlib.crc32(data[:-4]) != int.from_bytes(data[-4:], "little"):
        raise ValueError("a block's checksum is wrong")
    head = np.frombuffer(data, "<u4", 6)
    if head[0] != MAGIC or head[1] != LANES:
        raise ValueError("not a block of this format")
    rows = np.frombuffer(data, "<u8", int(head[4]) * (1 + LANES), 24).reshape(-1, 1 + LANES)
    stream = np.frombuffer(data, "<u4", int(head[5]), 24 + rows.size * 8)
    return head, rows[:, 0], rows[:, 1:], stream


def decode(blocks: list[bytes], table: Table, checkpoint: int = 0) -> list[np.ndarray]:
    """The ids of each block, from the given checkpoint on."""
    opened = [_open(b) for b in blocks]
    skip = checkpoint * CHECKPOINT * LANES
    sizes_in = [max(0, int(o[0][2]) - skip) for o in opened]
    order = sorted(range(len(blocks)), key=lambda i: -sizes_in[i])
    order = [i for i in order if sizes_in[i]]
    result = [np.zeros(0, np.uint32) for _ in blocks]
    if not order:
        return result
    sizes = np.array([sizes_in[i] for i in order], np.int64)
    steps = _steps(sizes)
    streams = [opened[i][3][int(opened[i][1][checkpoint]) :] for i in order]
    lengths = np.array([len(s) for s in streams], np.int64)
    read = np.cumsum(lengths) - lengths
    stream = np.append(np.concatenate(streams), [0]).astype(np.uint64)
    state = np.stack([opened[i][2][checkpoint] for i in order]).astype(np.uint64)
    begin = np.cumsum(sizes) - sizes
    ids = np.zeros(int(sizes.sum()), np.uint32)
    lane = np.arange(LANES)
    for step in range(int(steps[0])):
        k = int(np.searchsorted(-steps, -step, side="left"))
        at = step * LANES + lane[None, :]
        valid = at < sizes[:k, None]
        x = state[:k]
        slot = x & _MASK
        symbol = table.symbol_at[slot]
        ids[(begin[:k, None] + at)[valid]] = symbol[valid]
        x = np.where(valid, table.frequency[symbol] * (x >> np.uint64(BITS)) + slot - table.first[symbol], x)
        low = valid & (x < _LOW)
        rank = np.cumsum(low, axis=1)
        where = np.minimum(read[:k, None] + rank - 1, len(stream) - 1)
        state[:k] = np.where(low, x << _WORD | stream[where], x)
        read[:k] += rank[:, -1]
    for row, original in enumerate(order):
        result[original] = ids[begin[row] : begin[row] + sizes[row]]
    return result
