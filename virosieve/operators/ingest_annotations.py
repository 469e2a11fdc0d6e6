"""Ingest of literature markers as annotations of sets of amino-acid changes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from virosieve.functions.changes import mature_to_sequential, parse_change
from virosieve.plans.durable import cut, shuffles_dropped
from virosieve.plans.ids import assign_ids, highest
from virosieve.plans.joins import join_null_safe
from virosieve.tables import Tables

# Protein names of the marker source and the features they stand for.
FEATURE_OF_PROTEIN = {
    "HA1-5": "XAJ25415.1",
    "HA2-5": "XAJ25415.1",
    "M1": "XAJ25416.1",
    "M2": "XAJ25417.1",
    "NA-1": "XAJ25418.1",
    "NP": "XAJ25419.1",
    "NS-1": "XAJ25420.1",
    "NS-2": "unmapped",
    "PA": "XAJ25422.1",
    "PB1": "XAJ25424.1",
    "PB1-F2": "unmapped",
    "PB2": "XAJ25426.1",
}
HA_FEATURE = "XAJ25415.1"

_GROUP = ["marker_id", "effect_detail"]
_READING = ["gff_feature", "position_aa", "ref_aa", "alt_aa"]
_PAPER_KEY = ["authors", "publication_year", "title"]


def _written(df: DataFrame, label: str) -> DataFrame:
    """``cut``, whose shuffle files go as soon as it is written: the loads of one session would add up on disk."""
    with shuffles_dropped(df.sparkSession):
        return cut(df, label)


def marker_changes(rows: DataFrame, features: dict[str, str] | None = None, mature_feature: str = HA_FEATURE) -> DataFrame:
    """(marker, effect) with the change columns that a marker row names; nulls where it names none.
    Sites of the HA feature are renumbered from mature to sequential."""
    mapping = F.create_map(*[F.lit(x) for x in chain.from_iterable((features or FEATURE_OF_PROTEIN).items())])
    parsed = rows.select(*_GROUP, parse_change(F.col("aa_change")).alias("c"))
    named = parsed.select(*_GROUP, F.try_element_at(mapping, F.col("c.feature")).alias("gff_feature"), "c.*")
    position = F.when(F.col("gff_feature") == mature_feature, mature_to_sequential(F.col("position"))).otherwise(
        F.col("position")
    )
    return named.select(
        *_GROUP, "gff_feature", position.alias("position_aa"), F.col("ref").alias("ref_aa"), F.col("alt").alias("alt_aa")
    ).distinct()


def _catalog_parts(amino_acids: DataFrame) -> DataFrame:
    """(change columns, part, id) of the catalog. The ids that read the same form a part, named by its smallest
    id; an id that comes with several readings is a part of its own. So parts have no id in common, and the id
    set of any set of readings is a union of parts. A reading with a null id counts as unknown."""
    ids = amino_acids.select(*_READING, F.col("id").alias("amino_acid_id")).na.drop(subset=_READING).distinct()
    ids = ids.join(ids.filter("amino_acid_id IS NULL").select(*_READING), _READING, "left_anti")
    reading = F.struct(*_READING)
    shared = ids.groupBy("amino_acid_id").agg((F.min(reading) != F.max(reading)).alias("shared")).filter("shared")
    shared = shared.select("amino_acid_id")
    plain = ids.join(shared, "amino_acid_id", "left_anti")
    named = plain.join(plain.groupBy(*_READING).agg(F.min("amino_acid_id").alias("part")), _READING)
    alone = ids.join(shared, "amino_acid_id", "left_semi").withColumn("part", F.col("amino_acid_id"))
    return named.unionByName(alone)


def _complete_sets(changes: DataFrame, parts: DataFrame) -> DataFrame:
    """(marker, effect, part of the catalog, digest of its ids) of the groups all of whose changes are in the catalog."""
    looked_up = changes.join(_fingerprints(parts, [*_READING, "part"]), _READING, "left")
    complete = looked_up.groupBy(*_GROUP).agg(F.bool_and(F.col("part").isNotNull()).alias("ok")).filter("ok")
    return join_null_safe(looked_up, complete.select(*_GROUP), _GROUP, "left_semi").select(
        *_GROUP, "part", "digest"
    ).distinct()


def _digest(n, low, high, x, s) -> Column:
    return F.struct(
        n.alias("n"), low.alias("low"), high.alias("high"), x.alias("x"), s.cast("decimal(38,0)").alias("s")
    ).alias("digest")


def _fingerprints(members: DataFrame, keys) -> DataFrame:
    """A fixed-size digest of each id set. Equal sets have equal digests; whether equal digests mean
    equal sets is checked against the members."""
    id_ = F.col("amino_acid_id")
    hashed = F.xxhash64(id_)
    return members.groupBy(*keys).agg(
        _digest(F.count("*"), F.min(id_), F.max(id_), F.bit_xor(hashed), F.sum(hashed.cast("decimal(20,0)")))
    )


def _joined_fingerprints(members: DataFrame, keys) -> DataFrame:
    """The digests of unions of parts, from those of the parts."""
    of = {name: F.col(f"digest.{name}") for name in ("n", "low", "high", "x", "s")}
    return members.groupBy(*keys).agg(
        _digest(F.sum(of["n"]), F.min(of["low"]), F.max(of["high"]), F.bit_xor(of["x"]), F.sum(of["s"]))
    )


def _same_members(pairs: DataFrame, left: DataFrame, left_keys, right: DataFrame, right_keys) -> DataFrame:
    """Left keys of the pairs of sets, both of ``n`` ids, that really have the same members. ``right`` has
    the number ``found`` of ids that its set has of each part."""
    keys = list(dict.fromkeys([*left_keys, *right_keys]))
    both = pairs.join(left.select(*left_keys, "part"), list(left_keys)).join(right, [*right_keys, "part"])
    common = both.groupBy(*keys, "n").agg(F.sum("found").alias("common"))
    return common.filter(F.col("common") == F.col("n")).select(*left_keys)


def new_annotation_groups(members: DataFrame, parts: DataFrame, tables: Tables) -> DataFrame:
    """The (marker, effect) groups that become annotations: the effect has no annotation with the same
    id set yet, and of several new groups with one set the smallest marker is taken.

    Each group is compared with one representative of its digest, so the work is linear in the
    members however many groups share a set. New groups are compared by parts of the catalog, so their
    ids are never listed. Stored members are shuffled only of annotations whose lowest and highest id are
    those of a group of their effect; tasks find these bounds before they shuffle.
    """
    groups = _written(_joined_fingerprints(members, _GROUP), "marker-digests")

    old_members = tables.annotations_amino_acids.select("annotation_id", "amino_acid_id")
    effects = tables.annotations.select("annotation_id", "effect_detail").distinct()
    id_ = F.col("amino_acid_id")
    bounds = old_members.groupBy("annotation_id").agg(F.min(id_).alias("low"), F.max(id_).alias("high"))
    wanted = groups.select("effect_detail", "digest.low", "digest.high").distinct()
    likely = bounds.join(effects, "annotation_id").join(wanted, ["effect_detail", "low", "high"], "left_semi")
    likely = _written(likely.select("annotation_id", "effect_detail"), "likely-annotations")
    compared = old_members.join(likely.select("annotation_id").distinct(), "annotation_id", "left_semi")
    # one shuffle by annotation serves the distinct ids and the digest
    old = (
        _fingerprints(compared.repartition("annotation_id").distinct(), ["annotation_id"])
        .join(likely, "annotation_id")
        .groupBy("effect_detail", "digest")
        .agg(F.min("annotation_id").alias("annotation_id"))
    )
    candidates = groups.join(old, ["effect_detail", "digest"]).select(*_GROUP, "annotation_id", F.col("digest.n").alias("n"))
    candidates = _written(candidates, "marker-candidates")
    part_of = parts.select("amino_acid_id", "part").distinct()
    held = (
        old_members.join(candidates.select("annotation_id"), "annotation_id", "left_semi")
        .join(part_of, "amino_acid_id")
        .groupBy("annotation_id", "part")
        .agg(F.count_distinct("amino_acid_id").alias("found"))
    )
    known = _same_members(candidates, members, _GROUP, held, ["annotation_id"])

    fresh = _written(groups.join(known, _GROUP, "left_anti"), "marker-groups")
    first = fresh.groupBy("effect_detail", "digest").agg(F.min("marker_id").alias("first_marker"))
    paired = fresh.join(first, ["effect_detail", "digest"]).filter(F.col("marker_id") != F.col("first_marker"))
    first_members = members.select(
        F.col("marker_id").alias("first_marker"), F.col("effect_detail"), "part", F.col("digest.n").alias("found")
    )
    pairs = paired.select(*_GROUP, "first_marker", F.col("digest.n").alias("n"))
    repeated = _same_members(pairs, members, _GROUP, first_members, ["first_marker", "effect_detail"])
    return fresh.select(*_GROUP).join(repeated, _GROUP, "left_anti")


def ingest_annotations(tables: Tables, rows: DataFrame, features: dict[str, str] | None = None,
                       mature_feature: str = HA_FEATURE) -> Tables:
    """Load marker rows (aa_change, effect_detail, title, authors, publication_year, marker_id).

    Rows of one (marker, effect) form one annotation of all their changes. A group with any change
    that cannot be read or is not in the catalog is skipped whole. Effects and papers of the other
    groups are added when new; a group that repeats an id set of its effect adds nothing more. The
    tables that others refer to by id are written first.
    """
    changes = marker_changes(rows, features, mature_feature)
    parts = _written(_catalog_parts(tables.amino_acids), "catalog-parts")
    members = _written(_complete_sets(changes, parts), "marker-members")
    usable = rows.join(members.select(*_GROUP).distinct(), _GROUP, "left_semi")

    details = usable.select(F.col("effect_detail").alias("detail")).distinct()
    effects = tables.effects.select("detail").unionByName(details).distinct()

    cited = usable.select(*_PAPER_KEY).distinct()
    new_papers = join_null_safe(cited, tables.papers.select(*_PAPER_KEY), _PAPER_KEY, "left_anti")
    added_papers = assign_ids(new_papers, _PAPER_KEY, highest(tables.papers))
    papers = _written(tables.papers.unionByName(added_papers), "papers")

    new = new_annotation_groups(members, parts, tables)
    added = assign_ids(new, _GROUP, highest(tables.annotations, "annotation_id"), "annotation_id")
    added = _written(added, "annotations")
    annotations = tables.annotations.unionByName(added.select(*tables.annotations.columns))
    ids = parts.select("part", "amino_acid_id").distinct()
    links = members.join(added, _GROUP).select("annotation_id", "part").join(ids, "part").select("annotation_id", "amino_acid_id")
    paper_ids = papers.select(F.col("id").alias("paper_id"), *_PAPER_KEY)
    citations = (
        join_null_safe(usable.join(added, _GROUP).select("annotation_id", *_PAPER_KEY), paper_ids, _PAPER_KEY)
        .select("annotation_id", "paper_id")
        .distinct()
    )
    return tables.replace(
        effects=effects,
        papers=papers,
        annotations=annotations,
        annotations_amino_acids=tables.annotations_amino_acids.unionByName(links),
        annotations_papers=tables.annotations_papers.unionByName(citations),
    )
