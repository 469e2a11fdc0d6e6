"""Vectors of the passages of texts, computed for a whole Arrow batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WORDS = 64
BUCKETS = 32
#: Byte classes, in order: each of these marks on its own, then the ranges of ``_byte_classes``.
MARKS = "#*$%&|<>!\n"
_RANGES = 7
CLASSES = len(MARKS) + _RANGES
#: Class shares, word length, distinct share, passage and text size, hashed words.
DIMENSION = CLASSES + 4 + BUCKETS


def _byte_classes() -> np.ndarray:
    table = np.full(256, len(MARKS) + 5, np.int32)  # other marks
    table[128:] = len(MARKS) + 6
    table[:32] = len(MARKS)
    for first, last, number in ((97, 122, 1), (65, 90, 2), (48, 57, 3), (9, 13, 4), (32, 32, 4)):
        table[first : last + 1] = len(MARKS) + number
    for number, mark in enumerate(MARKS):
        table[ord(mark)] = number
    return table


_CLASS_OF = _byte_classes()
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Random values by place in the word (places repeat from 16 on) and byte; their sum is the word's hash.
_MIX = np.random.default_rng(7).integers(0, 1 << 62, (16, 256), dtype=np.int64)


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(vectors, first)``: a row per passage of ``WORDS`` words, and the first row of each text.

    A text without words, or null, has one passage of zeros. All words of all texts are covered.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lengths = np.diff(offsets)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    begins = offsets[:-1] - offsets[0]

    solid = ~_SPACE[data]
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    at = begins[lengths > 0]
    starts[at] = solid[at]
    word_at = np.flatnonzero(starts)
    text_of_word = np.searchsorted(begins + lengths, word_at, side="right")
    n_words = np.bincount(text_of_word, minlength=len(texts))
    sizes = np.maximum(1, -(-n_words // WORDS))
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    count = int(first[-1])
    vectors = np.zeros((count, DIMENSION), np.float32)
    if not len(word_at):
        return vectors, first[:-1]

    place = np.arange(len(word_at)) - (np.cumsum(n_words) - n_words)[text_of_word]
    passage_of_word = first[text_of_word] + place // WORDS
    # every byte belongs to the word before it; bytes ahead of a text's first word to its first passage
    word_of_byte = np.cumsum(starts, dtype=np.int32) - 1
    text_of_byte = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    ahead = (word_of_byte < 0) | (text_of_word[word_of_byte] != text_of_byte)
    passage_of_byte = np.where(ahead, first[text_of_byte], passage_of_word[word_of_byte])
    by_class = np.bincount(passage_of_byte * CLASSES + _CLASS_OF[data], minlength=count * CLASSES).reshape(count, CLASSES)
    n_bytes = np.maximum(by_class.sum(axis=1), 1)
    in_passage = np.maximum(np.bincount(passage_of_word, minlength=count), 1)

    inside = np.arange(len(data), dtype=np.int64) - word_at[word_of_byte]
    values = np.where(solid, _MIX[inside & 15, data], 0)
    hashes = np.add.reduceat(values, word_at)
    # the last word before a text's end also sums the blanks after it, which are zero
    pairs = np.sort((passage_of_word.astype(np.int64) << 40) | (hashes >> 22 & ((1 << 40) - 1)))
    distinct = np.concatenate([[True], pairs[1:] != pairs[:-1]])
    n_distinct = np.bincount((pairs >> 40)[distinct], minlength=count)
    bucket = (hashes >> 5) % BUCKETS
    sign = np.where(hashes >> 12 & 1, 1.0, -1.0)
    bags = np.bincount(passage_of_word * BUCKETS + bucket, weights=sign, minlength=count * BUCKETS).reshape(count, BUCKETS)

    vectors[:, :CLASSES] = by_class / n_bytes[:, None]
    vectors[:, CLASSES] = n_bytes / in_passage / 10
    vectors[:, CLASSES + 1] = n_distinct / in_passage
    vectors[:, CLASSES + 2] = in_passage / WORDS
    vectors[:, CLASSES + 3] = np.log1p(n_words).repeat(sizes) / 10
    vectors[:, CLASSES + 4 :] = bags / np.sqrt(in_passage)[:, None]
    return vectors, first[:-1]
