"""Small helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, as a regular-expression class body.
SPACES = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; operators take the path as a parameter."""
    return public_tokenizers.path(name)


def id_remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % modulus


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased, as UTF-8: bytes.split() cuts at exactly 0x20 and 0x09-0x0D."""
    return text.encode().lower().split() if text else []


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def give_back() -> None:
    """Hand memory that is no longer used back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def tidy(run):
    """An Arrow function that gives its memory back when it ends: workers are reused by the next stage."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        give_back()

    return wrapped


def tidy_group(run):
    """Like ``tidy``, for an Arrow function of a group; a group's memory goes back before the next one comes."""

    def wrapped(table: pa.Table) -> pa.Table:
        found = run(table)
        give_back()
        return found

    return wrapped


def tidy_cogroup(run):
    """Like ``tidy_group``, for an Arrow function of two groups."""

    def wrapped(left: pa.Table, right: pa.Table) -> pa.Table:
        found = run(left, right)
        give_back()
        return found

    return wrapped


def small_batches(batches: Iterator[pa.RecordBatch], name: str, most: int = 16 << 20, field: str | None = None) -> Iterator[pa.RecordBatch]:
    """Split batches so that each holds about ``most`` bytes of column ``name`` (or a field of it), or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        texts = column(batch, name) if field is None else column(batch, name).field(field).cast(pa.string())
        sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            # a copy: some kernels (ascii_lower) misread strings whose offsets don't begin at zero
            yield batch if stop - start == batch.num_rows else batch.take(pa.array(np.arange(start, stop)))
