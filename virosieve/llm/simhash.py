"""Near-duplicate groups by SimHash fingerprints and meet-in-the-middle ball hashing.

A text's fingerprint has a bit set where over half of its shingles' XXH64 values (seed 42) have it set.
Two fingerprints within the radius meet at a point that lies within half the radius of either. The radius
of 3 is odd, so a third of the bits is left out in turn: one of the differing bits falls into the part left
out for at least one of the three parts, two remain, and the radius-1 balls around both meet in the rest.

Hence every distinct fingerprint emits ``3 + 128`` variants (part, value); rows are shuffled on them. A
variant shared by exactly two fingerprints is a pair to verify. A variant shared by more comes from a dense
group. There, pairs are not emitted: each member emits its full balls of radius 1 and (members with an odd
number of set bits) radius 2, and everything that meets at a point is linked to the least fingerprint that
has this point in its radius-1 ball. Two members of that ball differ in at most 2 bits, a member of it and
one of the radius-2 ball in at most 3, so each such link holds, and a pair that differs in 3 bits has one
odd member and meets there. A point has at most ``1 + 64 + 2016`` members whatever the input, and the work
is linear in the number of fingerprints.

Copies share a fingerprint, so a group of copies of any size is one fingerprint.

``near_duplicates`` links by fingerprints alone. ``similar_groups`` finds texts whose sets of five-word shingles
have a Jaccard similarity of 0.8 or more, all of them, by a prefix-filter join. Shingles have one order for all
texts: those that a sample shows often come last, the rest by hash. Two sets of similarity ``t`` share one of the
first ``n - ceil(t * n) + 1`` shingles of either, whatever the order; the sample only keeps points from crowding.
Pairs that meet are left out if their sizes, or what follows the shared shingle, rule the similarity out; the
others' sets are compared exactly. At first each text is compared with the least at each of its points, which is
linear. Then all pairs at a point that these links did not already put into one group are compared as well, so
that no pair is left out but those that are known to be in one group.

Nulls: a null text counts as empty; a text without words has fingerprint zero, which is linked like any
other. Rows with a null id are fingerprinted and grouped; a group's id is the least non-null one. Repeated
rows stay repeated. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from virosieve.llm.components import component_roots
from virosieve.llm.text import column, tidy, words_of
from virosieve.plans.durable import cut

RADIUS = 3
#: For ``similar_groups``: words in a shingle, and the least Jaccard similarity of a link.
SIZE, SIMILARITY = 5, 0.8
#: Ids (8 bytes each) that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: The three parts of the fingerprint that are left out in turn.
_PARTS = ((1 << 21) - 1, ((1 << 21) - 1) << 21, ((1 << 22) - 1) << 42)
_PIECE = 1 << 16
#: A bitmap of a shingle set has at most ``64 << _LONGS`` bits.
_LONGS = 7


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Runs of ``size`` words, joined by spaces; shorter texts give their whole sequence, if any."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def fingerprint(parts: list[bytes]) -> int:
    """SimHash of shingles, repeats included, as a signed 64-bit integer."""
    if not parts:
        return 0
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, len(parts), _PIECE):  # bounded memory for very long texts
        hashes = np.array([digest(p, 42) for p in parts[start : start + _PIECE]], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(parts)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 3) -> DataFrame:
    """``(id, fp)`` per row of ``docs``, without a shuffle."""
    picked = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(shingles(words_of(t.as_py()), size)) for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(fps, pa.int64())], names=["id", "fp"])

    return picked.mapInArrow(tidy(run), "id long, fp long")


def _ball(patterns: list[int], fp):
    return F.explode(F.transform(F.lit([_signed(p) for p in patterns]), lambda p: fp.bitwiseXOR(p)))


def links(distinct_fps: DataFrame) -> DataFrame:
    """Edges ``(u, v)`` between fingerprints: all within the radius are connected, none else."""
    bits = [1 << i for i in range(64)]
    variants = None
    for number, part in enumerate(_PARTS):
        kept = F.col("fp").bitwiseAND(F.lit(_signed(~part & ((1 << 64) - 1))))
        one = distinct_fps.select("fp", F.lit(number).alias("part"), _ball([0, *(b for b in bits if not b & part)], kept).alias("at"))
        variants = one if variants is None else variants.union(one)
    met = Window.partitionBy("part", "at")
    shared = cut(variants.withColumn("n", F.count(F.lit(1)).over(met)).filter("n > 1"), "variants")

    pairs = shared.filter("n = 2").groupBy("part", "at").agg(F.min("fp").alias("u"), F.max("fp").alias("v")).select("u", "v").distinct()
    pairs = pairs.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)

    dense = shared.filter("n > 2").select("fp").distinct()
    two = [bits[i] | bits[j] for i in range(64) for j in range(i)]
    near = dense.select("fp", F.lit(True).alias("near"), _ball([0, *bits], F.col("fp")).alias("at"))
    far = dense.filter(F.bit_count("fp") % 2 == 1).select("fp", F.lit(False).alias("near"), _ball(two, F.col("fp")).alias("at"))
    least = F.min(F.when(F.col("near"), F.col("fp"))).over(Window.partitionBy("at"))
    starred = near.union(far).select("fp", least.alias("v")).filter("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.union(starred.distinct())


def _components(rows: DataFrame, least: str) -> DataFrame:
    """``(fp, first)``: for each fingerprint of ``rows``, the least value of a column reachable over links."""
    distinct_fps = rows.groupBy("fp").agg(F.min(least).alias("own"))
    roots = component_roots(links(distinct_fps.select("fp")))
    named = distinct_fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return named.join(named.groupBy("root").agg(F.min("own").alias("first")), "root").select("fp", "first")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 3) -> DataFrame:
    """``(id, fp, component_id)`` per row; component_id is the least id reachable over links."""
    rows = cut(fingerprints(docs, id_column, text_column, size), "fingerprints")
    return rows.join(_components(rows, "id").withColumnRenamed("first", "component_id"), "fp").select("id", "fp", "component_id")


#: Texts that show which shingles are frequent (about), how often one is then met, and how many are put last at most.
_SAMPLE, _OFTEN, _FREQUENT = 20_000, 3, 100_000


def _marked(texts: DataFrame) -> DataFrame:
    """``(id, key, fp)`` of ``texts(id, text)``: the key of ``_keys`` and the SimHash fingerprint of three-word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t.as_py()) for t in column(batch, "text")]
            keys = [xxhash.xxh3_128_digest(b" ".join(w)) for w in words]
            fps = [fingerprint(shingles(w, 3)) for w in words]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(keys, pa.binary()), pa.array(fps, pa.int64())], names=["id", "key", "fp"])

    return texts.mapInArrow(tidy(run), "id long, key binary, fp long")


def _keys(docs: DataFrame, *more: str) -> DataFrame:
    """``docs(id, text)``, and columns ``more``, with a ``key`` that tells word sequences apart."""
    names = ["id", "text", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [xxhash.xxh3_128_digest(b" ".join(words_of(t.as_py()))) for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([*(column(batch, n) for n in names), pa.array(keys, pa.binary())], names=[*names, "key"])

    picked = docs.select(*names)
    return picked.mapInArrow(tidy(run), StructType([*picked.schema.fields, StructField("key", BinaryType())]))


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    """The distinct shingles' 64-bit hashes, ascending."""
    return np.unique(np.array([xxhash.xxh64_intdigest(s) for s in set(shingles(words, size))], np.uint64).view(np.int64))


def _frequent(texts: DataFrame, rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes, ascending, of the shingles that a sample of the texts has most often, and the rank of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_hashes(words_of(t.as_py()), size) for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], names=["at"])

    some = texts.select("text") if rows <= _SAMPLE else texts.select("text").sample(_SAMPLE / rows, seed=1)
    met = some.mapInArrow(run, "at long").groupBy("at").count().filter(F.col("count") >= _OFTEN)
    ranked = met.orderBy(F.desc("count"), "at").limit(_FREQUENT).collect()
    hashes = np.array([r["at"] for r in reversed(ranked)], np.int64)
    order = np.argsort(hashes)
    return hashes[order], order + 1


def _points(texts: DataFrame, size: int, similarity: float, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``(key, at, n, pos)``: the first shingles of each text in the common order; ``n`` is the size of its set."""
    kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int32()]
    names = ["key", "at", "n", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, ranks = frequent
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                keys, ats, sizes, places = [], [], [], []
                for text in column(batch, "text").slice(start, 500):
                    words = words_of(text.as_py())
                    hashes = _hashes(words, size)
                    if not len(hashes):
                        continue
                    rank = np.zeros(len(hashes), np.int64)
                    if len(often):
                        found = np.minimum(np.searchsorted(often, hashes), len(often) - 1)
                        rank = np.where(often[found] == hashes, ranks[found], 0)
                    # a little less than t * n, so that rounding never shortens the prefix
                    first = len(hashes) - math.ceil(similarity * len(hashes) - 1e-6) + 1
                    ats.append(hashes[np.lexsort((hashes, rank))[:first]])
                    keys += [xxhash.xxh3_128_digest(b" ".join(words))] * len(ats[-1])
                    sizes.append(np.full(len(ats[-1]), len(hashes)))
                    places.append(np.arange(len(ats[-1])))
                if ats:
                    values = [keys, *(np.concatenate(x) for x in (ats, sizes, places))]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

    return texts.select("text").mapInArrow(tidy(run), "key binary, at long, n int, pos int")


def _possible(a: str, b: str, similarity: float) -> Column:
    """Whether two sets can be similar enough if the point they meet at is the first one they share."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    most = F.least(n - F.col(f"{a}.pos"), m - F.col(f"{b}.pos"))
    return (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-6) & (most >= similarity * (n + m - most) - 1e-6)


def _parity(hashes: np.ndarray) -> np.ndarray:
    """A set's bitmap, about a bit an element: each element flips the bit that its hash names."""
    longs = 1 << min(max(len(hashes) - 1, 0).bit_length() - 6, _LONGS) if len(hashes) > 64 else 1
    bits = np.bincount(hashes.view(np.uint64) >> np.uint64(20) & np.uint64(64 * longs - 1), minlength=64 * longs) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _parities(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``(unit, bits)``: the bitmap of each of the units ``wanted(unit)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [_parity(_hashes(words_of(t.as_py()), size)) for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([column(batch, "unit"), pa.array(bits, pa.list_(pa.int64()))], names=["unit", "bits"])

    return _texts_of(texts, wanted).mapInArrow(tidy(run), "unit long, bits array<long>").groupBy("unit").agg(F.first("bits").alias("bits"))


def _apart(a: str, b: str, similarity: float) -> Column:
    """Whether the bitmaps of two sets differ in more bits than sets that are similar enough have elements in one alone.

    An element of one set alone flips one bit, so the bitmaps of two sets differ in no more bits than that. The
    larger bitmap is folded to the size of the smaller one, which is the bitmap of that size.
    """

    def folded(bits: Column, size: Column) -> Column:
        half = F.zip_with(F.slice(bits, 1, size), F.slice(bits, size + 1, size), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(bits) > size, half).otherwise(bits)

    own, other = F.col(f"{a}_bits"), F.col(f"{b}_bits")
    size = F.least(F.size(own), F.size(other))
    differing = F.zip_with(folded(own, size), folded(other, size), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    count = F.aggregate(differing, F.lit(0), lambda total, x: total + x)
    # of n + m elements, J of the union are shared: the others are (1 - J) / (1 + J) of n + m at most
    most = (1 - similarity) / (1 + similarity) * (F.col(f"{a}.n") + F.col(f"{b}.n"))
    # sizes that differ by more than one fold are not compared
    return (F.greatest(F.size(own), F.size(other)) <= 2 * size) & (count > most + 1e-6)


def _texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(unit, text)`` of the rows whose unit is one of ``wanted(unit)``."""
    few = wanted.count() <= BROADCAST_ROWS
    return _keys(texts).select(F.xxhash64("key").alias("unit"), "text").join(F.broadcast(wanted) if few else wanted, "unit")


def _shingle_sets(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``(unit, hashes)`` of each of the units ``wanted(unit)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_hashes(words_of(t.as_py()), size) for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([column(batch, "unit"), pa.array(sets, pa.list_(pa.int64()))], names=["unit", "hashes"])

    return _texts_of(texts, wanted).mapInArrow(tidy(run), "unit long, hashes array<long>").groupBy("unit").agg(F.first("hashes").alias("hashes"))


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs(u, v)`` whose sets are similar enough."""
    sides = [sets.select(F.col("unit").alias(n), F.col("hashes").alias(f"{n}_set")) for n in "uv"]
    both = pairs.join(sides[0], "u").join(sides[1], "v")
    common = F.size(F.array_intersect("u_set", "v_set"))
    return both.filter(common >= similarity * (F.size("u_set") + F.size("v_set") - common)).select("u", "v")


def _similar(texts: DataFrame, rows: int, size: int, similarity: float, near: DataFrame | None = None) -> DataFrame:
    """``(node, root)`` of the units that are linked to others; exact, see the module's docstring.

    Links ``near(u, v)`` hold beforehand.
    """
    points = _points(texts, size, similarity, _frequent(texts, rows, size)).select(F.struct("pos", "n", F.xxhash64("key").alias("unit")).alias("m"), "at")
    met = Window.partitionBy("at")
    # the hub has the fewest rare shingles before the point: of edited copies, that is the text they were made of
    shared = points.withColumn("hub", F.min("m").over(met)).withColumn("last", F.max("m").over(met))
    shared = cut(shared.filter("last <> hub").drop("last"), "points")
    hubs = shared.filter("m.unit <> hub.unit").filter(_possible("m", "hub", similarity))
    hubs = cut(hubs.select(F.col("hub.unit").alias("u"), F.col("m.unit").alias("v")).distinct(), "hubs")
    links = _alike(hubs, _shingle_sets(texts, _units(hubs), size), similarity)
    links = cut(links if near is None else links.union(near), "links")
    roots = component_roots(links)

    rooted = shared.select("at", "m", F.col("m.unit").alias("node")).join(roots, "node", "left").select("at", "m", F.coalesce("root", "node").alias("root"))
    rooted = rooted.withColumn("first", F.min("root").over(met)).withColumn("last", F.max("root").over(met))
    rooted = cut(rooted.filter("first <> last").select("at", "m", "root").distinct(), "apart")
    units = cut(rooted.select(F.col("m.unit").alias("unit")).distinct(), "units")
    marked = rooted.withColumn("unit", F.col("m.unit")).join(cut(_parities(texts, units, size), "parities"), "unit").drop("unit")
    a, b = (marked.select("at", F.col("m").alias(n), F.col("root").alias(f"{n}_root"), F.col("bits").alias(f"{n}_bits")) for n in "ab")
    pairs = a.join(b, "at").filter("a.unit < b.unit and a_root <> b_root").filter(_possible("a", "b", similarity) & ~_apart("a", "b", similarity))
    pairs = pairs.select(F.col("a.unit").alias("u"), F.col("b.unit").alias("v")).distinct().join(hubs, ["u", "v"], "left_anti")
    pairs = cut(pairs, "pairs")
    more = _alike(pairs, _shingle_sets(texts, _units(pairs), size), similarity)
    return component_roots(links.union(more))


def _units(pairs: DataFrame) -> DataFrame:
    """``(unit)`` of all units in ``pairs(u, v)``: only texts that are compared need their whole shingle sets."""
    return cut(pairs.select(F.col("u").alias("unit")).union(pairs.select("v")).distinct(), "units")


def _grouped(docs: DataFrame, id_column: str, text_column: str, size: int, similarity: float, by_simhash: bool = False) -> DataFrame:
    """``(id, key, root)`` per row: rows of similar texts share a root, and with ``by_simhash`` those of linked fingerprints."""
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    near = None
    if by_simhash:
        rows = cut(_marked(texts).select("id", "key", "fp", F.xxhash64("key").alias("unit")), "keys")
        units = rows.select("unit", "fp").distinct()
        near = units.join(_components(units, "unit"), "fp").filter("unit <> first").select(F.col("unit").alias("u"), F.col("first").alias("v"))
    else:
        rows = cut(_keys(texts).select("id", "key", F.xxhash64("key").alias("unit")), "keys")
    roots = _similar(texts, rows.count(), size, similarity, near)
    return rows.join(roots, rows["unit"] == roots["node"], "left").select("id", "key", F.coalesce("root", "unit").alias("root"))


def similar_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """``(id, component_id)`` per row: component_id is the least id of the texts linked by their shingles' similarity."""
    rows = cut(_grouped(docs, id_column, text_column, size, similarity), "grouped")
    return rows.join(rows.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("id", "component_id")


def distinct_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of near duplicates, that of the least id, with its own columns.

    Texts are linked by SimHash as in ``near_duplicates``; then the exact join of ``similar_groups`` adds the similar
    texts whose fingerprints differ in more bits than the radius.
    Rows with a null id stay. Rows that share an id are told apart by their words; of those that share both, one stays.
    """
    grouped = cut(_grouped(docs, id_column, text_column, size, similarity, by_simhash=True).filter("id is not null"), "groups")
    least = grouped.groupBy("root").agg(F.min(F.struct("id", "key")).alias("kept"))
    rows = cut(grouped.join(least, "root").select("id", "key", (F.struct("id", "key") != F.col("kept")).alias("gone")), "judged")
    repeated = cut(rows.groupBy("id").count().filter("count > 1").select("id"), "repeated")
    gone = cut(rows.filter("gone").select("id").join(repeated, "id", "left_anti"), "gone")
    number = F.col(id_column).cast("long")
    hint = F.broadcast if gone.count() <= BROADCAST_ROWS else (lambda df: df)
    kept = docs.join(hint(gone), number == gone["id"], "left_anti")
    if not repeated.isEmpty():
        again = kept.join(repeated, number == repeated["id"], "left_semi")
        own = again.select(F.struct("*").alias("row"), number.alias("id"), F.col(text_column).cast("string").alias("text"))
        stay = rows.filter("not gone").join(repeated, "id", "left_semi").select("id", "key").distinct()
        own = _keys(own, "row").dropDuplicates(["id", "key"]).join(stay, ["id", "key"], "left_semi")
        kept = kept.join(repeated, number == repeated["id"], "left_anti").union(own.select("row.*"))
    return kept
