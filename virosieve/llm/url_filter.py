"""URL verdicts by fixed host and path rules, else by association rules over URL tokens.

Tokens are the parts of host and path (marked ``h:`` and ``p:``) that aren't numbers. FP-growth mines token
combinations of labelled URLs, the label being one more item; rules whose consequent is the blocking label are
kept if they reach the support and confidence limits, if they beat the share of blocked URLs among all labelled
ones, and if no part of their combination does so alone. They are matched by an inverted index: each rule is
listed under its rarest token, distinct token sets are joined to it by their tokens, and the combination is
then checked. URLs that no fixed rule and no mined rule fits are allowed.

DataFrame functions and Spark's FP-growth only. URLs with equal tokens are matched once; the verdicts go back to
the rows by token set. The index is broadcast if it holds at most ``BROADCAST_RULES`` rules, else joined by a
shuffle. The number of labelled URLs bounds what is mined.

Nulls: a null URL, or one without ``://``, has empty host and path, no tokens and no fixed rule, and is allowed.
Rows with null ids, repeated rows and repeated ids stay as they are. Null labels are left out; an id with
several labels is blocked if one of them says so. Without labels, or with fewer than ``min_count`` labelled URLs,
nothing is mined. Only the id and url columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from virosieve.plans.durable import cut

BROADCAST_RULES = 100_000
#: (verdict, host, path); the rule's text is host and path together.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_BLOCK = "=block"


@dataclass(frozen=True)
class Mining:
    min_count: int = 20
    #: A floor in shares for very many labelled URLs: the miner holds the frequent tokens in the driver, at most a token count of a URL over this.
    min_support: float = 1e-6
    min_confidence: float = 0.6
    min_lift: float = 1.5


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, with A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text, verdict = F.when(fits, rule_host + rule_path).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def tokens(host: Column, path: Column) -> Column:
    """Sorted distinct tokens of a URL."""
    parts = []
    for mark, text in (("h:", host), ("p:", F.translate(path, _UPPER, _LOWER))):
        words = F.filter(F.split(text, r"[^\pL\pN]+"), lambda w: (w != "") & ~w.rlike("^[0-9]+$"))
        parts.append(F.transform(words, _marked(mark)))
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def _marked(mark: str):
    return lambda w: F.concat(F.lit(mark), w)


def mine(labelled: DataFrame, options: Mining = Mining()) -> DataFrame:
    """``(antecedent, confidence, support)`` of the rules for blocking, from ``labelled(tokens, blocked)``."""
    spark = labelled.sparkSession
    schema = "antecedent array<string>, confidence double, support double"
    sums = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("blocked").cast("int")).alias("blocked")).first()
    if sums["n"] < options.min_count or not sums["blocked"]:
        return spark.createDataFrame([], schema)
    items = labelled.select(F.when(F.col("blocked"), F.array_append("tokens", F.lit(_BLOCK))).otherwise(F.col("tokens")).alias("items"))
    support = min(1.0, max(options.min_support, options.min_count / sums["n"]))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=options.min_confidence).fit(items)
    base = sums["blocked"] / sums["n"]
    rules = model.associationRules.filter(F.col("consequent")[0] == _BLOCK)
    rules = rules.filter(F.col("confidence") >= options.min_lift * base)
    rules = cut(rules.select("antecedent", "confidence", "support"), "url-rules")
    # a rule is idle if leaving one token out gives a rule, too: its parts are looked up by their text
    rules = rules.withColumn("name", F.array_join(F.array_sort("antecedent"), "\n"))
    parts = rules.select("name", F.explode(F.transform("antecedent", _without)).alias("part"))
    idle = parts.join(rules.select(F.col("name").alias("part")), "part", "left_semi").select("name").distinct()
    return rules.join(idle, "name", "left_anti").select("antecedent", "confidence", "support")


def _without(token: Column) -> Column:
    return F.array_join(F.array_sort(F.array_remove(F.col("antecedent"), token)), "\n")


def _fired(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``(set)`` of the token sets that a rule fits."""
    listed = sets.select("set", F.explode("set").alias("token"))
    frequency = listed.join(rules.select(F.explode("antecedent").alias("token")).distinct(), "token", "left_semi").groupBy("token").count()
    spread = rules.select("antecedent", F.explode("antecedent").alias("token")).join(frequency, "token")
    index = spread.groupBy("antecedent").agg(F.min_by("token", F.struct("count", "token")).alias("token"))
    index = cut(index, "url-index")
    small = index.count() <= BROADCAST_RULES
    met = listed.join(F.broadcast(index) if small else index, "token")
    return met.filter(F.size(F.array_except("antecedent", "set")) == 0).select("set").distinct()


def number_in(url: Column) -> Column:
    """The last number in a URL's path; null if there is none that fits."""
    return F.regexp_extract(path_of(url), r"([0-9]{1,18})[^0-9]*$", 1).try_cast("long")


def judged(pages: DataFrame, labels: DataFrame, id_column: str = "page_id", url_column: str = "url", label_id: str = "doc_id", key: Column | None = None, rules=RULES, options: Mining = Mining()) -> DataFrame:
    """``(id, host, path, rule, verdict)`` per row of ``pages``.

    ``labels`` has ``label_id`` and the boolean ``blocked``; ``key``, over the columns of ``pages``, tells the label id of
    a page (the page's own id by default).
    """
    url = F.col(url_column).cast("string")
    rows, found = _labelled(pages, labels, id_column, url, label_id, key)
    mined = mine(found, options)
    return _verdicts(rows, mined, rules)


def mined_rules(pages: DataFrame, labels: DataFrame, id_column: str = "page_id", url_column: str = "url", label_id: str = "doc_id", key: Column | None = None, options: Mining = Mining()) -> DataFrame:
    """The rules that ``judged`` would apply, with their confidence and support."""
    return mine(_labelled(pages, labels, id_column, F.col(url_column).cast("string"), label_id, key)[1], options)


def _labelled(pages: DataFrame, labels: DataFrame, id_column: str, url: Column, label_id: str, key: Column | None) -> tuple[DataFrame, DataFrame]:
    """``(id, host, path, set)`` of all pages, and ``(tokens, blocked)`` of those with a label."""
    own = F.col(id_column) if key is None else key
    rows = pages.select(F.col(id_column).cast("long").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), own.cast("long").alias("key"))
    rows = rows.withColumn("set", tokens(F.col("host"), F.col("path")))
    marked = labels.select(F.col(label_id).cast("long").alias("id"), "blocked").filter("id is not null and blocked is not null")
    marked = marked.groupBy("id").agg(F.max("blocked").alias("blocked"))
    known = rows.select(F.col("set").alias("tokens"), F.col("key").alias("id")).join(marked, "id").select("tokens", "blocked")
    return rows.drop("key"), known


def _verdicts(rows: DataFrame, mined: DataFrame, rules) -> DataFrame:
    rule, fixed = fixed_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "fixed": fixed})
    if mined.isEmpty():
        return rows.select("id", "host", "path", "rule", F.coalesce("fixed", F.lit("allow")).alias("verdict"))
    fired = _fired(rows.select("set").distinct(), mined).withColumn("fired", F.lit(True))
    rows = rows.join(fired, "set", "left")
    return rows.select("id", "host", "path", "rule", F.coalesce("fixed", F.when(F.col("fired"), "block").otherwise("allow")).alias("verdict"))
