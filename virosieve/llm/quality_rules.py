"""Rule counts per text, and its Jensen-Shannon distance to references of its language.

Two histograms are compared: character classes, and the language's most common words with one bin for all
other words. A language's references are the pooled histograms of all its texts. A text is kept if it does
not fail the base rules and neither distance exceeds its limit. Texts under ``min_words`` words fail the
base rules, and a language whose reference rests on fewer than ``min_reference_words`` words judges nothing:
there the distances say little.

Everything is DataFrame functions over arrays of one row: no shuffle carries texts. The references take one
count per (language, word) over all texts, combined before the shuffle; what reaches the driver is
``common_words`` words for each language. Up to ``max_languages`` languages are judged in one pass, further ones
in further passes by the same rules. Texts without a language share the pooled reference ``''``.

Repeated 3-word windows are found by their 64-bit hashes, sorted: time is n log n in a text's length.

Nulls: a null text has no words and fails the base rules; a null id stays null. Empty table: no rows.
Repeated rows stay repeated. Only the id, text and language columns are read; ``kept_rows`` returns all.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from virosieve.llm.text import SPACES
from virosieve.plans.durable import cut

SYMBOLS = "[#*$%&|<>]"
_BLANK = f"[{SPACES}]+"


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    max_repeat_percent: int = 50
    common_words: int = 50
    min_reference_words: int = 1000
    max_languages: int = 512
    max_class_distance: float = 0.29
    #: Plus one over the root of the word count: a short text misses most common words by chance.
    max_word_distance: float = 0.31


DEFAULT = Limits()


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _counted(docs: DataFrame) -> DataFrame:
    """Adds ``_words`` and the base counts to ``docs``, which has ``_text``."""
    text, words = F.col("_text"), F.col("_words")
    docs = docs.withColumn("_words", F.filter(F.split(text, _BLANK), lambda w: w != ""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACES}]"))
    window = lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
    docs = docs.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
            "n_symbols": _matches(text, SYMBOLS),
            "_lines": lines,
            "_windows": F.transform(F.slice("_words", F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0))), window),
        }
    )
    none = F.array().cast("array<bigint>")
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    docs = docs.withColumn("_order", F.when(twice, F.sort_array("_windows")).otherwise(none))
    same_as_last = lambda h, i: h.eqNullSafe(F.get("_order", i - 1))
    docs = docs.withColumn("_twice", F.array_distinct(F.filter("_order", same_as_last)))
    # where: for few repeated hashes by comparing with each, else from (hash, place) in order
    few = F.array_compact(F.transform("_windows", lambda h, i: F.when(F.array_contains("_twice", h), i)))
    pairs = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    docs = docs.withColumn("_placed", F.when(F.size("_twice") > 32, pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    found = lambda s, i: s["h"].eqNullSafe(F.get("_placed", i - 1)["h"]) | s["h"].eqNullSafe(F.get("_placed", i + 1)["h"])
    many = F.sort_array(F.transform(F.filter("_placed", found), lambda s: s["i"]))
    at = F.when(F.size("_twice") == 0, F.array().cast("array<int>")).when(F.size("_twice") <= 32, few).otherwise(many)
    docs = docs.withColumn("_at", at)
    # a repeated window adds its 3 words, less those that the repeated window before it covers
    fresh = F.transform("_at", lambda p, i: F.coalesce(F.least(F.lit(3), p - F.get("_at", i - 1)), F.lit(3)))
    return docs.withColumns(
        {
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.aggregate(fresh, F.lit(0).cast("long"), lambda total, n: total + n),
        }
    ).drop("_lines", "_windows", "_order", "_twice", "_placed", "_at")


#: Upper case, digits, other ASCII marks; then symbols, blanks and all else are told by counts at hand.
_CLASS_PATTERNS = ("[A-Z]", "[0-9]", r"[!\x22'()+,./:;=?@\[\x5C\]^_`{}~-]")
CLASSES = 6


def _classes(text: Column, n_symbols: Column, blanks: Column) -> Column:
    parts = [*(_matches(text, p) for p in _CLASS_PATTERNS), n_symbols, blanks]
    rest = F.char_length(text) - sum(parts, F.lit(0))
    return F.array(*[p.cast("double") for p in [*parts, rest]])


def _half(p: Column, q: Column) -> Column:
    """p's part of the divergence, in bits and halved."""
    return F.when(p > 0, p * F.log2(2 * p / (p + q)) / 2).otherwise(F.lit(0.0))


def _both(p: Column, q: Column) -> Column:
    return _half(p, q) + _half(q, p)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def _root(divergence: Column) -> Column:
    return F.sqrt(F.greatest(F.least(divergence, F.lit(1.0)), F.lit(0.0)))


def references(rows: DataFrame, limits: Limits) -> tuple[dict, dict]:
    """``({language: class shares}, {language: {word: share}})`` of ``rows(_lang, _text)``, bounded by the limits."""
    symbols, size = _matches(F.col("_text"), SYMBOLS), F.char_length("_text")
    parts = _classes(F.col("_text"), symbols, _matches(F.col("_text"), f"[{SPACES}]"))
    sums = rows.select("_lang", size.alias("size"), parts.alias("c")).groupBy("_lang")
    sums = sums.agg(F.sum("size").alias("size"), *[F.sum(F.col("c")[k]).alias(f"c{k}") for k in range(CLASSES)]).collect()
    classes = {r["_lang"]: [r[f"c{k}"] / r["size"] for k in range(CLASSES)] for r in sums if r["size"]}

    cleaned = F.filter(F.split(F.lower("_text"), _BLANK), lambda w: w != "")
    counts = cut(rows.select("_lang", F.explode(cleaned).alias("word")).groupBy("_lang", "word").count(), "words")
    best = Window.partitionBy("_lang").orderBy(F.desc("count"), "word")
    top = counts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limits.common_words)
    totals = {r["_lang"]: r["n"] for r in counts.groupBy("_lang").agg(F.sum("count").alias("n")).collect()}
    words: dict = {}
    for row in top.collect():
        if totals[row["_lang"]] >= limits.min_reference_words:
            words.setdefault(row["_lang"], {})[row["word"]] = row["count"] / totals[row["_lang"]]
    classes = {lang: shares for lang, shares in classes.items() if lang in words}
    return classes, words


def _distances(features: DataFrame, classes: dict, words: dict) -> DataFrame:
    """Adds ``class_distance`` and ``word_distance``; null where the language has no reference."""
    if not classes:
        return features.withColumns({"class_distance": F.lit(None).cast("double"), "word_distance": F.lit(None).cast("double")})

    def by_language(values: dict, kind: str) -> Column:
        picked = None
        for lang, value in values.items():
            same, value = F.col("_lang") == lang, F.lit(value) if kind == "array" else _map(value)
            picked = F.when(same, value) if picked is None else picked.when(same, value)
        return picked

    common = sorted({w for table in words.values() for w in table})
    features = features.withColumns(
        {
            "_ref_classes": by_language(classes, "array"),
            "_ref_words": by_language(words, "map"),
            "_common": F.sort_array(F.filter(F.transform("_words", F.lower), lambda w: w.isin(common))),
        }
    )
    starts = F.array_compact(F.transform("_common", lambda w, i: F.when(~w.eqNullSafe(F.get("_common", i - 1)), i)))
    features = features.withColumn("_starts", starts)
    runs = F.transform(
        "_starts",
        lambda at, i: F.struct(
            ((F.coalesce(F.get("_starts", i + 1), F.size("_common")) - at) / F.col("n_words")).alias("p"),
            F.coalesce(F.try_element_at("_ref_words", F.get("_common", at)), F.lit(0.0)).alias("q"),
        ),
    )
    features = features.withColumn("_runs", F.filter(runs, lambda r: r["q"] > 0))
    size = _sum("_classes")
    by_class = _sum(F.transform("_classes", lambda n, i: _both(n / F.col("_size"), F.get("_ref_classes", i))))
    seen_p, seen_q = _sum(F.transform("_runs", lambda r: r["p"])), _sum(F.transform("_runs", lambda r: r["q"]))
    features = features.withColumns({"_size": size, "_p": seen_p, "_q": seen_q, "_all_q": _sum(F.map_values("_ref_words"))})
    by_word = (
        _sum(F.transform("_runs", lambda r: _both(r["p"], r["q"])))
        + (F.col("_all_q") - F.col("_q")) / 2
        + _both(F.greatest(1 - F.col("_p"), F.lit(0.0)), F.greatest(1 - F.col("_all_q"), F.lit(0.0)))
    )
    return features.withColumns(
        {
            "class_distance": F.when(F.col("_size") > 0, _root(by_class)),
            "word_distance": F.when(F.col("n_words") > 0, _root(by_word)),
        }
    )


def _map(table: dict) -> Column:
    if not table:
        return F.create_map().cast("map<string,double>")
    return F.map_from_arrays(F.lit(list(table)), F.lit(list(table.values())))


RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"]


def judged(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", limits: Limits = DEFAULT) -> DataFrame:
    """``(row, n_words, ..., kept)`` per row of ``docs``; ``row`` holds all its columns.

    Every language has a reference of its own. Those of ``max_languages`` languages are held in one plan; the
    commonest come first, and further ones are judged in further passes in the same way.
    """
    own = F.col(lang_column).cast("string")
    names = docs.groupBy(own.alias("lang")).count().filter("lang is not null")
    names = [r["lang"] for r in names.orderBy(F.desc("count"), "lang").collect()]  # the distinct languages
    groups = [names[i : i + limits.max_languages] for i in range(0, len(names), limits.max_languages)]
    if len(groups) <= 1:
        return _judged(docs, names, text_column, lang_column, limits)
    rest = own.isNull() | own.isin(groups[0])
    parts = [_judged(docs.filter(rest if i == 0 else own.isin(group)), group, text_column, lang_column, limits) for i, group in enumerate(groups)]
    return reduce(DataFrame.unionByName, parts)


def _judged(docs: DataFrame, names: list[str], text_column: str, lang_column: str, limits: Limits) -> DataFrame:
    """The verdicts on documents of the languages ``names``, or of none."""
    lang = F.col("row").getField(lang_column).cast("string")
    features = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    features = features.withColumn("_text", F.coalesce(F.col("row").getField(text_column).cast("string"), F.lit("")))
    features = features.withColumn("_lang", F.when(lang.isin(names), lang).otherwise("") if names else F.lit(""))
    classes, words = references(features.select("_lang", "_text"), limits)
    features = _counted(features)
    blanks = F.char_length("_text") - F.col("word_chars")
    features = features.withColumn("_classes", _classes(F.col("_text"), F.col("n_symbols"), blanks))
    features = _distances(features, classes, words)
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))
    near = (F.coalesce("class_distance", F.lit(0.0)) <= limits.max_class_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= limits.max_word_distance + 1 / F.sqrt("n_words"))
    return features.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & near).select("row", *RESULT)


def kept_rows(docs: DataFrame, limits: Limits = DEFAULT, **columns: str) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns."""
    rows = judged(docs, limits=limits, **columns)
    # a verdict that also names the row's place isn't pushed below, where its steps would be expanded into one another
    return rows.select("row", (F.col("kept") & (F.monotonically_increasing_id() >= 0)).alias("kept")).filter("kept").select("row.*")
