"""Conversations of many layouts as canonical turns, formatted by a template with a loss mask.

A record's layout is told by its nested field paths: ``schema_of_variant`` gives the nested structure of each
JSON record, the types are dropped, and the rest is hashed. A layout declares the fields it may have and how
they become turns; all allowed combinations of optional fields are hashed beforehand, and a record's hash
selects its layout. Where that finds none, the declared paths are hashed alone, so a record may have further
fields. A record of no known layout has ``layout`` null and no turns; ``rejected`` returns it with the reason.

The template writes a turn as ``[INST]role[/INST]text</s>``. Inside role and text, each ``\\`` is doubled, and a ``\\`` is put after the first character of whatever would
read as a control string, so no text can forge a turn; ``parsed`` takes both back. The mask holds the
positions of the assistant's escaped text in the formatted turn, in code points.

Rows stay one turn each, in order of conversation and turn: a conversation of any size is spread over rows and
never gathered. Only the digests of whole conversations go through a conversation's rows in order, as a stream
that holds one Arrow batch (SHA-256 can't be split). All else is DataFrame functions.

Nulls: a null role or text counts as empty; a null conversation is a conversation of its own; a null turn comes
first. Turns with the same number are ordered by role and text; repeated rows stay repeated. Other columns are
carried in ``row`` under any name, and not read. Texts of any length are formatted whole. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from virosieve.llm.text import column

TURN = "struct<role:string,text:string>"


@dataclass(frozen=True)
class Layout:
    """Field paths that a record must and may have (``[]`` marks array elements), and its turns.

    Each turn is ``(role, path)`` with a fixed role, or ``(list path, role field, text field)`` for a list of
    messages, or ``(None, role path, text path)`` for a record that is one turn.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    turns: tuple[tuple, ...]


#: Role names that other layouts use, and the canonical ones.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LAYOUTS = (
    Layout("turn_row", ("conv_id", "turn", "role", "text"), (), ((None, "role", "text"),)),
    Layout("messages", ("messages[].content", "messages[].role"), ("id", "conv_id", "turn"), (("messages", "role", "content"),)),
    Layout("conversations", ("conversations[].from", "conversations[].value"), ("id", "conv_id", "turn"), (("conversations", "from", "value"),)),
    Layout("prompt", ("prompt", "completion"), ("id", "conv_id", "turn", "system"), (("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Layout("response", ("prompt", "response"), ("id", "conv_id", "turn", "system"), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction", ("instruction", "output"), ("id", "conv_id", "turn", "input"), (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("question", ("question", "answer"), ("id", "conv_id", "turn"), (("user", "question"), ("assistant", "answer"))),
)


def _tree(paths: tuple[str, ...]) -> dict:
    tree: dict = {}
    for path in paths:
        node = tree
        for part in path.split("."):
            node = node.setdefault(part, {})
    return tree


def _shape(tree: dict) -> str:
    """The structure as ``structure`` writes it: names in order, types dropped."""
    parts: dict[str, str] = {}
    lists: dict[str, dict] = {}
    for name, below in tree.items():
        if name.endswith("[]"):
            lists.setdefault(name[:-2], {}).update(below)
        else:
            parts[name] = _shape(below) if below else ""
    for name, below in lists.items():
        parts[name] = f"ARRAY<{_shape(below) if below else ''}>"
    return "OBJECT<" + ",".join(f"{name}:{parts[name]}" for name in sorted(parts)) + ">"


def structure(record: Column) -> Column:
    """The nested field paths of a variant, types dropped."""
    shown = F.schema_of_variant(record)
    types = r"\b(VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|STRING|BINARY|DATE|TIMESTAMP|TIMESTAMP_NTZ|UUID|DECIMAL)(\(\d+,\s*\d+\))?(?=[,>]|$)"
    return F.regexp_replace(F.regexp_replace(shown, types, ""), r"[\s`]+", "")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(structure(record))


def fingerprints(spark: SparkSession, layouts=LAYOUTS) -> dict[str, list[int]]:
    """The hashes of every allowed combination of each layout's fields."""
    shapes = {}
    for layout in layouts:
        for size in range(len(layout.optional) + 1):
            for extra in combinations(layout.optional, size):
                shapes.setdefault(_shape(_tree((*layout.required, *extra))), layout.name)
    return _hashed(spark, shapes)


def _hashed(spark: SparkSession, shapes: dict[str, str]) -> dict[str, list[int]]:
    rows = spark.createDataFrame(list(shapes.items()), "shape string, name string").select("name", F.xxhash64("shape").alias("h")).collect()
    found: dict[str, list[int]] = {}
    for row in rows:
        found.setdefault(row["name"], []).append(row["h"])
    return found


def _message(role: str, text: str):
    return lambda m: F.struct(m[role].alias("role"), m[text].alias("text"))


def _turns(record: Column, layout: Layout) -> Column:
    parts = []
    for turn in layout.turns:
        if turn[0] is None:
            parts.append(F.array(F.struct(_get(record, turn[1]).alias("role"), _get(record, turn[2]).alias("text"))))
        elif len(turn) == 3:
            listed = F.coalesce(F.try_variant_get(record, f"$.{turn[0]}", f"array<struct<{turn[1]}:string,{turn[2]}:string>>"), F.array())
            parts.append(F.transform(listed, _message(turn[1], turn[2])))
        else:
            text = _get(record, turn[1])
            one = F.array(F.struct(F.lit(turn[0]).alias("role"), text.alias("text")))
            needed = turn[1] in layout.required
            parts.append(one if needed else F.when(F.coalesce(text, F.lit("")) != "", one).otherwise(F.array().cast(f"array<{TURN}>")))
    return F.concat(*[p.cast(f"array<{TURN}>") for p in parts])


def _get(record: Column, path: str) -> Column:
    return F.try_variant_get(record, f"$.{path}", "string")


def _declared(layouts) -> list[str]:
    """Every field path that some layout declares."""
    return sorted({p for layout in layouts for p in (*layout.required, *layout.optional)})


def _is_there(record: Column, path: str) -> Column:
    """Whether a record has a value of the right kind (a scalar, or a list of objects with the field) at a declared path."""
    if "[]." not in path:
        kind = F.schema_of_variant(F.try_variant_get(record, f"$.{path}", "variant"))
        return kind.isNotNull() & ~kind.rlike("^(ARRAY|OBJECT)")
    listed, name = path.split("[].")
    return F.try_variant_get(record, f"$.{listed}", f"array<struct<{name}:string>>").isNotNull()


def _declared_shape(record: Column, layouts) -> Column:
    """The declared paths that a record has, as one text; fields that no layout declares don't show."""
    there = [F.when(_is_there(record, p), F.lit(p)) for p in _declared(layouts)]
    return F.array_join(F.array_compact(F.array(*there)), "\n")


def _loose_hashes(spark: SparkSession, layouts) -> dict[str, list[int]]:
    """As ``fingerprints``, over the declared paths alone."""
    shapes = {}
    for layout in layouts:
        for size in range(len(layout.optional) + 1):
            for extra in combinations(layout.optional, size):
                shapes.setdefault("\n".join(sorted((*layout.required, *extra))), layout.name)
    return _hashed(spark, shapes)


def canonical(records: DataFrame, json_column: str = "json", layouts=LAYOUTS) -> DataFrame:
    """``(row, layout, turns)`` of JSON records: ``row`` holds all their columns, ``turns`` is an array of (role, text).

    A record whose field paths are exactly those of a layout has that layout. Otherwise its declared paths are
    hashed alone, so further fields of a record, or of its messages, do no harm; a record with the declared
    fields of two layouts fits neither. ``layout`` is null for records of none.
    """
    exact, loose = fingerprints(records.sparkSession, layouts), _loose_hashes(records.sparkSession, layouts)
    rows = records.select(F.struct(*[records[c] for c in records.columns]).alias("row"))
    rows = rows.withColumn("record", F.try_parse_json(F.col("row").getField(json_column)))
    record = F.col("record")

    def named(hashes: dict[str, list[int]], of: Column) -> Column:
        return reduce(lambda c, x: c.when(of.isin(hashes[x.name]), x.name), layouts[1:], F.when(of.isin(hashes[layouts[0].name]), layouts[0].name))

    rows = rows.withColumn("layout", named(exact, fingerprint(record)))
    rows = rows.withColumn("layout", F.when(F.col("layout").isNotNull(), F.col("layout")).otherwise(named(loose, F.xxhash64(_declared_shape(record, layouts)))))
    turns = reduce(lambda c, x: c.when(F.col("layout") == x.name, _turns(record, x)), layouts[1:], F.when(F.col("layout") == layouts[0].name, _turns(record, layouts[0])))
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    own = lambda r: F.coalesce(r, F.lit(""))
    # turn rows are canonical already
    role = lambda r: F.when(F.col("layout") == "turn_row", own(r)).otherwise(F.coalesce(F.try_element_at(known, own(r)), own(r)))
    clean = F.transform(turns, lambda t: F.struct(role(t["role"]).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    return rows.withColumn("turns", F.coalesce(clean, F.array().cast(f"array<{TURN}>"))).drop("record")


def rejected(records: DataFrame, json_column: str = "json", layouts=LAYOUTS) -> DataFrame:
    """``(row, problem)`` of the records that ``format_records`` gives no row for, with all their columns."""
    rows = canonical(records, json_column, layouts).filter(F.size("turns") == 0)
    unread = F.try_parse_json(F.col("row").getField(json_column)).isNull()
    return rows.select("row", F.when(unread, "no JSON").when(F.col("layout").isNull(), "no known layout").otherwise("no turns").alias("problem"))


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"([<\[])(?=/?(?:s>|INST\]))", "$1\\\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def formatted(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, part, formatted, loss_start, loss_end)`` of rows ``(conv_id, turn, part, role, text)``.

    The mask is empty (0, 0) but for the assistant's turns.
    """
    head = F.concat(F.lit("[INST]"), escaped(F.col("role")), F.lit("[/INST]"))
    rows = turns.withColumns({"_head": head, "_body": escaped(F.col("text")), "_learn": F.col("role") == "assistant"})
    start = F.char_length("_head")
    return rows.select(
        "conv_id",
        "turn",
        "part",
        F.concat("_head", "_body", F.lit("</s>")).alias("formatted"),
        F.when(F.col("_learn"), start).otherwise(0).cast("long").alias("loss_start"),
        F.when(F.col("_learn"), start + F.char_length("_body")).otherwise(0).cast("long").alias("loss_end"),
    )


_PATTERN = r"(?s)^\[INST\](.*?)\[/INST\](.*)</s>$"


def parsed(rows: DataFrame) -> DataFrame:
    """Adds ``role``, ``text`` and ``loss`` (the masked text), read back and unescaped, to formatted rows."""
    masked = F.substring("formatted", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    return rows.withColumns(
        {
            "role": unescaped(F.regexp_extract("formatted", _PATTERN, 1)),
            "text": unescaped(F.regexp_extract("formatted", _PATTERN, 2)),
            "loss": unescaped(masked),
        }
    )


def turn_rows(records: DataFrame, id_column: str = "conv_id", turn_column: str = "turn") -> DataFrame:
    """One row for each turn of canonical records: ``(conv_id, turn, part, role, text)``; part orders a record's turns."""
    row = F.col("row")
    ids = [row.getField(id_column).cast("long").alias("conv_id"), row.getField(turn_column).cast("long").alias("turn")]
    return records.select(*ids, F.posexplode("turns").alias("part", "t")).select("conv_id", "turn", "part", "t.role", "t.text")


def digests(rows: DataFrame) -> DataFrame:
    """Per conversation ``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` of parsed rows.

    The rows of a conversation pass through one task in order, as a stream.
    """
    ordered = rows.select("conv_id", "turn", "part", "role", "text", "loss", F.char_length("formatted").cast("long").alias("n"))
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part", "role", "text")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, begun = None, False
        done: list[tuple] = []

        def close() -> None:
            done.append((own, count, whole.hexdigest(), loss_chars, loss.hexdigest(), chars))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
            done.clear()
            return batch

        for batch in batches:
            for conv, role, text, masked, n in zip(*[column(batch, c).to_pylist() for c in ("conv_id", "role", "text", "loss", "n")], strict=True):
                if not begun or conv != own:
                    if begun:
                        close()
                    own, begun = conv, True
                    count, loss_chars, chars, whole, loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                count += 1
                chars += n
                whole.update(f"{role}\n{text}\n".encode())
                loss.update(masked.encode())
                loss_chars += len(masked)
            yield flush()
        if begun:
            close()
        yield flush()

    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_records(records: DataFrame, json_column: str = "json", id_column: str = "conv_id", turn_column: str = "turn") -> DataFrame:
    """JSON records of any known layout as formatted rows, one for each turn, without a shuffle."""
    return formatted(turn_rows(canonical(records, json_column), id_column, turn_column))
