"""Transitive closure of an edge table, and what can be reached from given nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from virosieve.plans.durable import cut


def _joined(left: DataFrame, right: DataFrame, parent: str, child: str) -> DataFrame:
    first = left.select(F.col(parent).alias("__from"), F.col(child).alias("__via"))
    second = right.select(F.col(parent).alias("__via"), F.col(child).alias("__to"))
    return first.join(second, "__via").select(F.col("__from").alias(parent), F.col("__to").alias(child))


def _closed(found: list[DataFrame], parent: str, child: str) -> list[DataFrame]:
    """Add rounds of longer pairs to ``found`` until there are none; its last frame holds the newest pairs.

    Each round joins only the pairs found in the round before with all pairs, on either side, so
    paths about double in length and the number of rounds is the logarithm of the depth.
    """
    while not found[-1].isEmpty():
        seen = reduce(DataFrame.unionByName, found)
        longer = _joined(found[-1], seen, parent, child).unionByName(_joined(seen, found[-1], parent, child))
        found.append(cut(longer.distinct().join(seen, [parent, child], "left_anti"), "closure"))
    return found


def transitive_closure(edges: DataFrame, parent: str = "parent_id", child: str = "child_id") -> DataFrame:
    """All distinct (ancestor, descendant) pairs.

    Only pairs not seen before go on, so diamonds stay one row and a cycle ends with its members
    reaching themselves. Every round's new pairs are written once; the result is the union of the rounds.
    """
    found = _closed([cut(edges.select(parent, child).distinct(), "closure")], parent, child)
    return reduce(DataFrame.unionByName, found)


def maintain_closure(closure: DataFrame, edges: DataFrame, added: DataFrame, dropped: DataFrame,
                     parent: str = "parent_id", child: str = "child_id") -> DataFrame:
    """The stored ``closure`` brought up to ``edges``, which came from its own edges by ``added`` and ``dropped``.

    Dropped edges delete every pair that one of them may have been a part of, from an ancestor of its
    parent to a descendant of its child. Those of these pairs that the remaining edges still give are
    then derived again, from an edge and a pair that was kept or derived again before; a diamond's
    other side, or a cycle, is found so. Added edges extend the pairs in rounds, as a closure's edges do.
    Only pairs near the changed edges are joined; the rest of the closure is only passed on.
    """
    key = [parent, child]
    edges, closure = edges.select(*key).distinct(), closure.select(*key)
    dropped = cut(dropped.select(*key).distinct(), "dropped")
    kept = closure
    if not dropped.isEmpty():
        up = dropped.unionByName(_joined(closure, dropped, parent, child))  # from above each dropped edge
        reach = up.unionByName(_joined(up, closure, parent, child)).distinct()
        lost = cut(closure.join(reach, key, "left_semi"), "lost")
        kept = closure.join(lost, key, "left_anti")
        again = [cut(lost.join(edges.unionByName(_joined(edges, kept, parent, child)).distinct(), key, "left_semi"), "again")]
        while not again[-1].isEmpty():
            left = lost.join(reduce(DataFrame.unionByName, again), key, "left_anti")
            again.append(cut(left.join(_joined(edges, again[-1], parent, child).distinct(), key, "left_semi"), "again"))
        kept = cut(kept.unionByName(reduce(DataFrame.unionByName, again)), "kept")
    new = cut(added.select(*key).distinct().join(kept, key, "left_anti"), "added")
    return reduce(DataFrame.unionByName, _closed([kept, new], parent, child))


def reachable(edges: DataFrame, roots: DataFrame, node: str, parent: str = "parent_id", child: str = "child_id") -> DataFrame:
    """``roots(node)`` and all nodes below them, once each; a round joins the newest nodes with the edges."""
    found = [cut(roots.select(node).distinct(), "reached")]
    while not found[-1].isEmpty():
        seen = reduce(DataFrame.unionByName, found)
        below = found[-1].join(edges, F.col(node) == F.col(parent)).select(F.col(child).alias(node)).distinct()
        found.append(cut(below.join(seen, node, "left_anti"), "reached"))
    return reduce(DataFrame.unionByName, found)
