"""Licence scan: notice phrases and identifier tags by Aho-Corasick, licence expressions by a shunting yard.

A text is read twice by an automaton, once as its words (A-Z lower-cased, one blank between them) for the
phrases of notices, once as it stands for identifier tags such as ``SPDX-License-Identifier:``. What follows a tag
on its line is cut into identifiers, parentheses and the operators ``and``, ``or`` and ``with``; a shunting
yard (``with`` before ``and`` before ``or``) turns the longest part of it that is a whole expression into postfix
order, which is evaluated on a stack: every licence named is a label, ``and`` takes the stricter level of its two
sides, ``or`` the milder, and an exception after ``with`` lowers a copyleft licence by one level.

One pass over whole texts without a shuffle: a row's work depends on its own text alone, and a task holds one
small Arrow batch. Words start at a letter or digit of ASCII or at any other character; overlapping places count.

Nulls: a null text is an empty one, with no words and no places; null ids stay. Very long texts are read
whole, in time in proportion to their length. Repeated rows stay repeated; two labels of one place are two
places, in the order of start, stop and label. Only the id and text columns are read, so other columns may have
any name. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from virosieve.llm.text import column, small_batches

#: The phrases of the base, and the labels they give.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Phrases of further notices, as words, and the label each gives.
NOTICES = {
    "apache license": "apache",
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "isc license": "isc",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons zero": "cc0",
    "cc0": "cc0",
    "public domain": "public-domain",
    "proprietary and confidential": "reserved",
}
#: Tags, lower case, that a licence expression follows.
TAGS = ("spdx-license-identifier:", "license-expression:", "license:", "licence:")
#: Levels: 0 permissive, 1 weak copyleft, 2 copyleft, 3 restricted.
LEVELS = {
    "0bsd": 0, "apache-2.0": 0, "bsd-2-clause": 0, "bsd-3-clause": 0, "bsl-1.0": 0, "cc-by-4.0": 0, "cc0-1.0": 0,
    "isc": 0, "mit": 0, "python-2.0": 0, "unlicense": 0, "zlib": 0,
    "cddl-1.0": 1, "epl-1.0": 1, "epl-2.0": 1, "lgpl-2.1": 1, "lgpl-2.1-only": 1, "lgpl-2.1-or-later": 1,
    "lgpl-3.0": 1, "lgpl-3.0-only": 1, "lgpl-3.0-or-later": 1, "mpl-2.0": 1,
    "agpl-3.0": 2, "agpl-3.0-only": 2, "agpl-3.0-or-later": 2, "cc-by-sa-4.0": 2, "gpl-2.0": 2, "gpl-2.0-only": 2,
    "gpl-2.0-or-later": 2, "gpl-3.0": 2, "gpl-3.0-only": 2, "gpl-3.0-or-later": 2,
    "cc-by-nc-4.0": 3, "cc-by-nc-sa-4.0": 3, "cc-by-nd-4.0": 3,
}
UNKNOWN_LEVEL = 3
#: How sure one kind of place makes that a licence is stated.
WEIGHTS = {"base": 0.6, "notice": 0.7, "tag": 0.9}

_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_PARTS = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*")
_LINE = re.compile(r"[^\r\n]*")
#: ASCII letters and digits stay (A-Z as lower case), other ASCII becomes a blank, the rest stays.
_WORDS = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
_PLACE = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string()), ("kind", pa.string()), ("level", pa.int32())])
SCHEMA = "id long, n_words long, places array<struct<start: long, stop: long, label: string, kind: string, level: int>>"


def whole_part(parts: list[str]) -> list[str]:
    """The longest part from the left that is a whole expression; empty if there is none."""
    depth, operand, whole = 0, True, 0
    for at, part in enumerate(parts):
        operator = part.lower() in _PRECEDENCE
        if operand:
            if operator or part == ")":
                break
            if part == "(":
                depth += 1
            else:
                operand = False
        elif part == ")":
            if not depth:
                break
            depth -= 1
        elif operator:
            operand = True
        else:
            break
        if not operand and not depth:
            whole = at + 1
    return parts[:whole]


def postfix(parts: list[str]) -> list[str]:
    """Shunting yard: a whole expression in postfix order."""
    out, held = [], []
    for part in parts:
        low = part.lower()
        if low in _PRECEDENCE:
            while held and held[-1] != "(" and _PRECEDENCE[held[-1]] >= _PRECEDENCE[low]:
                out.append(held.pop())
            held.append(low)
        elif part == "(":
            held.append(part)
        elif part == ")":
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        else:
            out.append(low)
    return out + held[::-1]


def evaluate(line: str) -> tuple[frozenset[str], int] | None:
    """Licences and level of the expression that ``line`` starts with; None if it starts with none, or names no known licence."""
    parts = whole_part(_PARTS.findall(line))
    if not parts:
        return None
    stack = []
    for part in postfix(parts):
        if part not in _PRECEDENCE:
            name = part.rstrip("+.")
            stack.append((frozenset([name]) if name in LEVELS else frozenset(), LEVELS.get(name, UNKNOWN_LEVEL)))
            continue
        (right, right_level), (left, left_level) = stack.pop(), stack.pop()
        if part == "with":  # the right side names an exception
            stack.append((left, left_level - 1 if left_level in (1, 2) else left_level))
        else:
            stack.append((left | right, max(left_level, right_level) if part == "and" else min(left_level, right_level)))
    found, level = stack[0]
    return (found, level) if found else None


@cache
def _automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for kind, table in (("base", BASE), ("notice", NOTICES)):
        for phrase, label in table.items():
            key = f" {phrase} "
            phrases.add_word(key, [*phrases.get(key, []), (len(key), phrase.count(" ") + 1, label, kind)])
    for tag in TAGS:
        tags.add_word(tag, len(tag))
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def scan(text: str) -> tuple[int, list[tuple]]:
    """Number of words, and the places (first word, word after the last, label, kind, level) of one text."""
    phrases, tags = _automata()
    raw = text.encode()
    spaced = raw.translate(_WORDS)
    words = spaced.split()
    found = []
    # one character a byte, so that places are byte offsets
    line = f" {b' '.join(words).decode('latin-1')} "
    at, word = 0, 0
    for end, hits in phrases.iter(line):
        for length, size, label, kind in hits:
            start = end - length + 1  # the blank before the phrase
            if start < at:  # a phrase that began before the last one
                first = word - line.count(" ", start, at)
            else:
                first = word = word + line.count(" ", at, start)
                at = start
            found.append((first, first + size, label, kind, None))
    low = raw.lower().decode("latin-1")
    at, word = 0, 0
    for end, length in tags.iter(low):
        start = end - length + 1
        if start and spaced[start - 1] != 32:  # a tag inside a longer word, or one that ends another tag's name
            continue
        value = evaluate(_LINE.match(low, end + 1).group())
        word, at = word + len(spaced[at:start].split()), start
        for label in value[0] if value else ():
            found.append((word, word + len(spaced[start : end + 1].split()), label, "tag", value[1]))
    return len(words), sorted(found, key=lambda f: (f[0], f[1], f[2], f[3]))


def scanned(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, n_words, places)`` per row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 4 << 20):
            rows = [scan(t or "") for t in column(batch, "text").to_pylist()]
            places = pa.array([[dict(zip(_PLACE.names, p, strict=True)) for p in found] for _, found in rows], pa.list_(_PLACE))
            sizes = pa.array([n for n, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([column(batch, "id"), sizes, places], ["id", "n_words", "places"])

    picked = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return picked.mapInArrow(run, SCHEMA)


def labels(places: Column, *kinds: str) -> Column:
    """Distinct sorted labels of the places of some kinds, joined by commas."""
    picked = F.filter(places, lambda p: p["kind"].isin(*kinds))
    return F.array_join(F.array_sort(F.array_distinct(F.transform(picked, lambda p: p["label"]))), ",")


def confidence(places: Column) -> Column:
    """How sure it is, from 0 to 1, that a text states a licence: each kind of place adds its weight once."""
    doubt = F.lit(1.0)
    for kind, weight in sorted(WEIGHTS.items()):
        doubt = doubt * F.when(F.exists(places, _of_kind(kind)), 1.0 - weight).otherwise(1.0)
    return F.round(F.lit(1.0) - doubt, 6)


def _of_kind(kind: str):
    return lambda p: p["kind"] == kind
