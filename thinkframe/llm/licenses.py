"""License scans with ordered signature rules, as plain column expressions.

1. A text becomes its words, each between two spaces of its own (so rules
   need no look-around and neighbouring matches cannot share a space).
2. One expression finds texts that hold any rule's keyword; only their
   keywords' rules are tried.
3. A rule's matches are found by splitting the text at it; a running sum over
   the pieces' word counts gives each match its place.
4. A detection is suppressed if another one's interval contains it and is of
   the same or a better tier (equal intervals: the better tier, then the
   earlier rule). Base phrases are always reported.

Only short rows (numbers) are shuffled, once, by document; windows within a
document resolve overlaps in sorted order, so a text with any number of
detections costs their sorting, not their pairs.
"""

from __future__ import annotations

import json
import string
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thinkframe.llm.license_rules import CONFIDENCE, Rule, rules

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # with A-Z lower-cased before
_GROUPS = "array<struct<keyword:string,rules:array<struct<number:int,tier:int,regex:string>>>>"


def spaced_words(text: str) -> Column:
    """The text's words between two spaces each: " w1  w2  w3 " (none: "  ")."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, SEPARATORS, "  ")), F.lit(" "))


def _words_in(spaced: Column) -> Column:
    """Words of a run of spaced words: two spaces each."""
    return ((F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("int")


def _gate(table: list[Rule]) -> str:
    """One regex for texts that hold any keyword, branches shared by first letter."""
    by_letter = defaultdict(set)
    for r in table:
        by_letter[r.keyword[0]].add(r.literal[2:])
    return " (?:" + "|".join(f"{c}(?:{'|'.join(sorted(rest))})" for c, rest in sorted(by_letter.items())) + ")"


def detections(docs: DataFrame, key: str = "doc_id", text: str = "text", table: list[Rule] | None = None) -> DataFrame:
    """Every detection and at least one row per row of ``docs``:

    (row, key, n_words, first_of_row, rule, tier, start, end, kept). ``rule``
    is a rule's number (null where nothing was found); words ``start`` to
    ``end`` (exclusive, from 0) match it; ``kept`` is false for suppressed
    detections. Exactly one row per document has ``first_of_row``.

    Null texts are empty. Rows with equal keys or equal texts stay apart: rows
    are numbered where they are read, so ``docs`` should come from files or a
    written table. Other columns are not read.
    """
    table = table or rules()
    groups = defaultdict(list)
    for r in table:
        groups[r.literal].append({"number": r.number, "tier": r.tier, "regex": r.regex})
    literal = json.dumps([{"keyword": k, "rules": v} for k, v in groups.items()])
    known = F.from_json(F.lit(literal), _GROUPS)

    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), spaced_words(text).alias("n"))
    found = F.when(F.col("n").rlike(_gate(table)), F.filter(known, lambda g: F.contains(F.col("n"), g["keyword"])))
    n_words = F.when(F.length("n") > 2, _words_in(F.col("n"))).otherwise(0)
    tried = words.select("row", "key", "n", n_words.alias("n_words"), found.alias("groups"))
    tried = tried.select("row", "key", "n", "n_words", F.posexplode_outer("groups").alias("gi", "g"))
    tried = tried.select("row", "key", "n", "n_words", "gi", F.posexplode_outer("g.rules").alias("ri", "r"))
    gaps = F.transform(F.split("n", F.col("r.regex"), -1), _words_in)
    hits = F.transform(F.regexp_extract_all("n", F.col("r.regex"), F.lit(0)), _words_in)
    tried = tried.select("row", "key", "n_words", "gi", "ri", "r.number", "r.tier", F.posexplode_outer(F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))).alias("hi", "x"))
    first = (F.coalesce("gi", F.lit(0)) + F.coalesce("ri", F.lit(0)) + F.coalesce("hi", F.lit(0))) == 0
    rows = tried.select("row", "key", "n_words", first.alias("first_of_row"), "number", "tier", "hi", "x.gap", "x.hit").where("first_of_row or hit is not null")

    # a rule's pieces in order: gap, match, gap, match, ...
    run = Window.partitionBy("row", "number").orderBy("hi").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.coalesce("hit", F.lit(0))).over(run)
    placed = rows.repartition("row").withColumn("end", F.when(F.col("hit").isNotNull(), end))
    placed = placed.withColumn("start", F.col("end") - F.col("hit")).withColumn("rule", F.when(F.col("hit").isNotNull(), F.col("number")))

    before = Window.partitionBy("row").orderBy("start", F.col("end").desc(), "tier", "number").rowsBetween(Window.unboundedPreceding, -1)
    tiers = sorted({r.tier for r in table if r.tier})
    inside = F.lit(False)
    for t in tiers:
        reach = F.max(F.when((F.col("tier") <= t) & (F.col("tier") > 0), F.col("end"))).over(before)
        inside = F.when(F.col("tier") == t, F.coalesce(reach >= F.col("end"), F.lit(False))).otherwise(inside)
    kept = F.col("rule").isNotNull() & ~inside
    return placed.select("row", "key", "n_words", "first_of_row", "rule", "tier", F.col("start").cast("long"), F.col("end").cast("long"), kept.alias("kept"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", table: list[Rule] | None = None) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_base, first_word, last_word,
    base_labels, labels, score, n_detections.

    ``n_base`` counts the base phrases' places, ``first_word`` and
    ``last_word`` are their smallest and largest start (else null). Label
    lists are distinct, sorted and comma-joined: the base phrases' labels, and
    those together with all labels of detections that are not suppressed.
    ``score`` is the largest confidence of these detections, by tier (none: 0).
    """
    table = table or rules()
    labels = F.array(*[F.lit(r.label) for r in sorted(table, key=lambda r: r.number)])
    confidence = F.lit(0.0)
    for tier, value in CONFIDENCE.items():
        confidence = F.when(F.col("tier") == tier, F.lit(value)).otherwise(confidence)
    found = detections(docs, key, text, table)
    base = (F.col("tier") == 0) & F.col("rule").isNotNull()
    found = found.withColumn("label", F.when(F.col("kept"), F.get(labels, F.col("rule"))))

    def joined(which: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")

    out = found.groupBy("row").agg(
        F.first("key").alias("key"), F.max("n_words").cast("long").alias("n_words"), F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("kept")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("kept"), confidence)), F.lit(0.0)).alias("score"), F.count_if("kept").alias("n_detections"),
    )
    return out.drop("row").withColumnRenamed("key", key)
