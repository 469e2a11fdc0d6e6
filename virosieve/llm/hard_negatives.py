"""Hard negatives: exact integer inner products by Strassen's multiplication, kept in mergeable heaps.

Components are whole numbers, ``floor(scale * x)``. Anchors are multiplied with all rows in int64 tiles: Strassen's
seven products of halves, recursively, halves padded with zeros to an even size, down to tiles of ``LEAF``. All
additions are exact; a leaf is multiplied in floating point only where its largest possible sum stays below 2**53.
Each task keeps, for an anchor, a heap of its best positives over all tiles it has seen; the tasks' heaps are merged
by Spark. The merged positives give score windows, and a second pass over all rows keeps one heap of negatives for
each (anchor, positive), merged in the same way. A heap is a sorted run of at most ``k`` (score, id), so two of them
merge by sorting; ties go to the lesser id.

Anchors are numbered and taken in slabs of at most ``SLAB_BYTES``; one slab at a time is sent to the tasks, with the
at most ``positives`` scores of each of its anchors. All rows are scanned twice for each slab and are never shuffled;
what is shuffled are the heaps, at most ``positives * negatives`` rows of a task for an anchor. Every slab's heaps are
written before the next slab starts.

Nulls: a row with a null id, label or vector, or with a null or non-finite component, takes no part. Vectors of
different lengths are padded with zeros; an empty vector has the product 0 with all. An anchor's id never is its own
positive. Repeated rows are rows of their own (equal ones take ranks of their own), but an id that is an anchor
several times is one anchor, with its least (label, vector). An anchor without positives, or whose window holds no
row, has no rows. Products that may not fit 64 bits raise an error. Only the id, label and vector columns are read.
Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from virosieve.llm.text import column
from virosieve.plans.durable import cut, delete_at_end, fresh_path
from virosieve.plans.ids import assign_ids

SLAB_BYTES = 16 << 20
#: Anchors and rows of one tile, and the size down to which products are split.
TILE_ANCHORS, TILE_ROWS, LEAF = 1024, 2048, 16


@dataclass(frozen=True)
class Mining:
    """``least`` and ``most`` bound a negative's score, in hundredths of the positive's."""

    positives: int = 5
    negatives: int = 10
    least: int = 30
    most: int = 90
    scale: int = 256


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact product of two small int64 matrices."""
    if not a.size or not b.size:
        return np.zeros((a.shape[0], b.shape[1]), np.int64)
    if a.shape[1] * _largest(a) * _largest(b) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def _largest(a: np.ndarray) -> int:
    return max(abs(int(a.min())), abs(int(a.max()))) if a.size else 0


def _halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rows, cols = a.shape
    if rows % 2 or cols % 2:
        a = np.pad(a, ((0, rows % 2), (0, cols % 2)))
    r, c = a.shape[0] // 2, a.shape[1] // 2
    return a[:r, :c], a[:r, c:], a[r:, :c], a[r:, c:]


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 matrices; sums may wrap around on the way, which cancels out where the result fits 64 bits."""
    if min(*a.shape, b.shape[1]) <= leaf:
        return product(a, b)
    a11, a12, a21, a22 = _halves(a)
    b11, b12, b21, b22 = _halves(b)
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    top, bottom = np.hstack([p1 + p4 - p5 + p7, p3 + p5]), np.hstack([p2 + p4, p1 - p2 + p3 + p6])
    return np.vstack([top, bottom])[: a.shape[0], : b.shape[1]]


class Heaps:
    """The best ``k`` (score, id) of each of ``n`` keys, higher scores first, then lesser ids."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.key = self.score = self.id = np.zeros(0, np.int64)
        self.floor = np.full(n, np.iinfo(np.int64).min)

    def push(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Merge rows into the heaps."""
        key, score, ids = np.concatenate([self.key, key]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        # ~score falls as score rises, and has no overflow
        order = np.lexsort((ids, ~score, key))
        key = key[order]
        start = np.searchsorted(key, key)
        kept = np.arange(len(key)) - start < self.k
        order = order[kept]
        self.key, self.score, self.id = key[kept], score[order], ids[order]
        last = np.flatnonzero(np.arange(len(self.key)) - np.searchsorted(self.key, self.key) == self.k - 1)
        self.floor[self.key[last]] = self.score[last]

    def push_tile(self, keys: np.ndarray, scores: np.ndarray, wanted: np.ndarray, ids: np.ndarray) -> None:
        """Merge the wanted cells of a tile whose rows belong to ``keys`` and whose columns belong to ``ids``."""
        wanted = wanted & (scores >= self.floor[keys][:, None])
        if scores.shape[1] > self.k and np.count_nonzero(wanted) > 4 * self.k * len(keys):
            shown = np.where(wanted, scores, np.iinfo(np.int64).min)
            least = np.partition(shown, -self.k, axis=1)[:, -self.k]
            wanted &= shown >= least[:, None]
        row, col = np.nonzero(wanted)
        if len(row):
            self.push(keys[row], scores[row, col], ids[col])


def integers(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and zero-padded whole-number vectors of the rows of ``(id, label, vector)`` that take part."""
    vectors = column(batch, "vector")
    known = np.ones(batch.num_rows, bool)
    for name in ("id", "label", "vector"):
        known &= column(batch, name).is_valid().to_numpy(zero_copy_only=False)
    sizes = np.where(known, np.diff(vectors.offsets.to_numpy()), 0)
    batch = batch.filter(pa.array(known))
    sizes = sizes[known]
    flat = column(batch, "vector").flatten()
    values = np.floor(scale * flat.to_numpy(zero_copy_only=False).astype(np.float64))  # nulls become nan
    row = np.repeat(np.arange(len(sizes)), sizes)
    taken = np.ones(len(sizes), bool)
    taken[row[~np.isfinite(values)]] = False
    if np.abs(values, where=np.isfinite(values), out=np.zeros(len(values))).max(initial=0) >= 2.0**62:
        raise ValueError("components are too large for 64-bit inner products")
    matrix = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    matrix[row, place] = np.where(np.isfinite(values), values, 0).astype(np.int64)
    ids = column(batch, "id").to_numpy(zero_copy_only=False).astype(np.int64)
    labels = column(batch, "label").to_numpy(zero_copy_only=False).astype(np.int64)
    return ids[taken], labels[taken], matrix[taken]


@dataclass(frozen=True)
class Slab:
    """Anchors by number, and for each of their positives (``-1`` where missing) its id, score and window."""

    first: int
    ids: np.ndarray
    labels: np.ndarray
    matrix: np.ndarray
    positive_ids: np.ndarray | None = None
    positive_scores: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def tiles(self, batches: Iterator[pa.RecordBatch], scale: int):
        """``(first, last, scores, labels, ids)`` of every tile of anchors with rows."""
        wide = self.matrix.shape[1]
        for batch in batches:
            ids, labels, matrix = integers(batch, scale)
            matrix = matrix[:, :wide]
            if wide * _largest(self.matrix) * _largest(matrix) >= 1 << 63:
                raise ValueError("components are too large for 64-bit inner products")
            matrix = np.pad(matrix, ((0, 0), (0, wide - matrix.shape[1]))).T
            for a in range(0, len(self.ids), TILE_ANCHORS):
                b = min(a + TILE_ANCHORS, len(self.ids))
                for c in range(0, len(ids), TILE_ROWS):
                    d = c + TILE_ROWS
                    yield a, b, strassen(self.matrix[a:b], matrix[:, c:d]), labels[c:d], ids[c:d]


def _positives(slab: Slab, options: Mining):
    """Arrow function: the task's heap of positives of each anchor, as ``(anchor, score, id)``."""

    def run(batches):
        heaps = Heaps(len(slab.ids), options.positives)
        for a, b, scores, labels, ids in slab.tiles(batches, options.scale):
            wanted = (slab.labels[a:b, None] == labels) & (slab.ids[a:b, None] != ids)
            heaps.push_tile(np.arange(a, b), scores, wanted, ids)
        yield pa.RecordBatch.from_arrays([pa.array(heaps.key + slab.first), pa.array(heaps.score), pa.array(heaps.id)], ["anchor", "score", "id"])

    return run


def _negatives(slab: Slab, options: Mining):
    """Arrow function: the task's heap of negatives of each (anchor, positive)."""

    def run(batches):
        k = options.positives
        heaps = Heaps(len(slab.ids) * k, options.negatives)
        for a, b, scores, labels, ids in slab.tiles(batches, options.scale):
            other = slab.labels[a:b, None] != labels
            for place in range(k):
                wanted = other & (scores >= slab.low[a:b, place, None]) & (scores <= slab.high[a:b, place, None])
                heaps.push_tile(np.arange(a, b) * k + place, scores, wanted, ids)
        anchor, place = heaps.key // k, heaps.key % k
        columns = {
            "anchor_id": slab.ids[anchor],
            "place": place,
            "positive_id": slab.positive_ids[anchor, place],
            "negative_id": heaps.id,
            "positive_score": slab.positive_scores[anchor, place],
            "negative_score": heaps.score,
        }
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns.values()], list(columns))

    return run


FOUND = "anchor_id long, place long, positive_id long, negative_id long, positive_score long, negative_score long"


def _numbered(rows: DataFrame, anchor: Column, options: Mining) -> DataFrame:
    """``(number, id, label, vector)`` of the anchors that take part, with whole-number vectors."""

    def run(batches):
        for batch in batches:
            ids, labels, matrix = integers(batch, options.scale)
            vectors = pa.array(list(matrix), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels), vectors], ["id", "label", "vector"])

    found = rows.filter(anchor).mapInArrow(run, "id long, label long, vector array<long>")
    found = found.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.label", "r.vector")
    return cut(assign_ids(found, ["id"], F.lit(-1), "number"), "anchors")


def _slab(anchors: DataFrame, first: int, last: int) -> Slab:
    got = anchors.filter(F.col("number").between(first, last - 1)).orderBy("number").toArrow()
    vectors = got["vector"].combine_chunks()
    sizes = np.diff(vectors.offsets.to_numpy())
    matrix = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    matrix[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = vectors.flatten().to_numpy()
    return Slab(first, got["id"].to_numpy(), got["label"].to_numpy(), matrix)


def _with_windows(slab: Slab, heaps: DataFrame, options: Mining) -> Slab:
    """The slab with its merged positives and the windows that they open."""
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    best = heaps.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= options.positives)
    got = best.toArrow()
    at = got["anchor"].to_numpy() - slab.first, got["place"].to_numpy() - 1
    shape = (len(slab.ids), options.positives)
    ids, scores = np.full(shape, -1), np.zeros(shape, np.int64)
    low, high = np.ones(shape, np.int64), np.zeros(shape, np.int64)
    ids[at], scores[at] = got["id"].to_numpy(), got["score"].to_numpy()
    exact = [int(s) for s in scores[at]]  # products of Python integers can't overflow
    low[at] = [-(-options.least * s // 100) for s in exact]
    high[at] = [options.most * s // 100 for s in exact]
    return Slab(slab.first, slab.ids, slab.labels, slab.matrix, ids, scores, low, high)


def mined(rows: DataFrame, anchor: Column, options: Mining = Mining(), slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of ``rows(id, label, vector)``.

    ``anchor`` is a condition on ``id`` and ``label`` that tells the anchors. Runs its passes when called.
    """
    spark = rows.sparkSession
    typed = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    anchors = _numbered(typed, anchor, options)
    size = anchors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("wide")).first()
    path = fresh_path(spark, "hard-negatives")
    spark.createDataFrame([], FOUND).write.parquet(path)
    delete_at_end(spark, path)
    step = max(1, slab_bytes // (8 * max(1, size["wide"] or 0)))
    for first in range(0, size["n"], step):
        slab = _slab(anchors, first, first + step)
        heaps = typed.mapInArrow(_positives(slab, options), "anchor long, score long, id long")
        slab = _with_windows(slab, heaps, options)
        typed.mapInArrow(_negatives(slab, options), FOUND).write.mode("append").parquet(path)
    found = spark.read.schema(FOUND).parquet(path)
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= options.negatives)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
