"""Line-first cleaning: rules per line, then a look at what is left of the document. Column functions only."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.values import col
from plumbline.llm.common import words

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
#: A line fails if it has more symbols, in percent of its words, ...
SYMBOL_PCT = 10
#: ... or, with five words or more, as many marks of shouting or trailing off, ...
SHOUTED = ("!!", "??", "....")
#: ... more words in capitals (two anywhere, no small letter), ...
CAPITAL_PCT = 50
#: (the first two capitals of such a word, with no small letter and no blank between them)
CAPITALS = "\\p{Lu}[^\\p{Lu}\\p{Ll}\\x20\\x09-\\x0D]*\\p{Lu}"
#: ... with four words or more, more separators of menus, ...
MENU_PCT = 30
SEPARATORS = "|»›•·>/"
#: ... or if it has one of these fixed phrases of sites, licences and scripts.
BOILERPLATE = (
    "all rights reserved", "copyright (c)", "released under the ", "licensed under the ", "permission is hereby granted",
    "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies", "accept all cookies",
    "click here to", "sign up for our", "subscribe to our", "enable javascript", "lorem ipsum",
)
#: A document is rejected if it loses more than this of its word characters, in percent.
MAX_LOST_PCT = 30


def scored_lines(lines: Column, n_symbols: Column) -> Column:
    """Per line: the line, and why it fails (null: it stays). Cheap tests come first and spare most lines the rest."""
    any_of = lambda line, marks: reduce(lambda x, y: x | y, (F.contains(line, F.lit(m)) for m in marks))

    def reason(line: Column) -> Column:
        w = words(line)
        n = F.size(w)
        symbols = F.regexp_count(line, F.lit(SYMBOLS))
        shouted = sum((F.regexp_count(line, F.lit(re.escape(m))) for m in SHOUTED), F.lit(0))
        capitals = F.size(F.filter(w, lambda x: x.rlike(CAPITALS) & ~x.rlike("\\p{Ll}")))
        menu = F.size(F.filter(w, lambda x: x.isin(*SEPARATORS)))
        return (
            F.when((n_symbols > 0) & (100 * symbols > SYMBOL_PCT * n), "symbols")
            .when(any_of(line, SHOUTED) & (n >= 5) & (100 * shouted > SYMBOL_PCT * n), "punctuation")
            .when(line.rlike(CAPITALS) & (n >= 5) & (100 * capitals > CAPITAL_PCT * n), "capitals")
            .when(any_of(line, SEPARATORS) & (n >= 4) & (100 * menu > MENU_PCT * n), "navigation")
            .when(any_of(F.lower(line), BOILERPLATE), "boilerplate")
        )

    return F.transform(lines, lambda x: F.struct(x.alias("line"), reason(x).alias("reason")))


def clean(
    df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, max_lost_pct: int = MAX_LOST_PCT
) -> DataFrame:
    """One row per row of ``df``: key, measures of the text, its cleaned text and whether it is kept.

    Every line is tested by itself: symbols, shouting punctuation, capitals, navigation and boilerplate. Lines that
    fail, and those equal to an earlier line, are removed; what is left, joined by line feeds, is ``cleaned``. A
    document is kept unless the base rules fail it (fewer than ``min_words`` words, or more than half of them in
    windows of three words that repeat) or it loses more than ``max_lost_pct`` percent of its word characters.

    Null and empty texts have no words, so the base rules reject them; ``cleaned`` is empty then. Very long texts are
    handled whole, in the row. Repeated rows give the same result each. Other columns are not read.
    """
    t = F.coalesce(col(text), F.lit(""))
    d = df.select(col(key).alias("key"), t.alias("t")).withColumn("w", words(F.col("t")))
    n = F.size("w")
    def windows(make) -> Column:
        return F.transform(F.sequence(F.lit(0), n - 3), lambda i: make(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))

    # Windows whose hashes all differ are all different; only the others are compared as text.
    hashes = F.when(n >= 3, windows(F.xxhash64))
    w = d.withColumn("hashes", hashes)
    w = w.withColumn("some_repeat", F.coalesce(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.lit(False)))
    blank = F.lit(" ")
    w = w.withColumn("windows", F.when(F.col("some_repeat"), windows(lambda x, y, z: F.concat(x, blank, y, blank, z))))
    # Sorted with their places, equal windows are neighbours.
    placed = F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    w = w.withColumn("placed", F.when(F.col("some_repeat"), placed))
    same = lambda a, b: F.coalesce(F.get("placed", a)["x"] == F.get("placed", b)["x"], F.lit(False))
    doubled = F.filter("placed", lambda x, k: same(k, k - 1) | same(k, k + 1))
    w = w.withColumn("at", F.sort_array(F.transform(doubled, lambda x: x["i"])))
    # Each place covers three words, less what the next one covers.
    covered = F.aggregate(
        F.transform("at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("at", k + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    w = w.select(
        "key",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.coalesce(F.when(F.col("some_repeat"), covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        lines.alias("lines"),
    )
    w = w.withColumn("unique_lines", F.array_distinct("lines")).withColumn("judged", scored_lines(F.col("unique_lines"), F.col("n_symbols")))
    w = w.withColumn("good", F.transform(F.filter("judged", lambda x: x["reason"].isNull()), lambda x: x["line"]))
    failed = F.transform(F.filter("judged", lambda x: x["reason"].isNotNull()), lambda x: x["reason"])
    left = F.length(F.regexp_replace(F.array_join("good", ""), "[\\x20\\x09-\\x0D]+", ""))
    left = F.when(F.size("good") == F.size("lines"), F.col("word_chars")).otherwise(left)
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    w = w.select(
        "key",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size("unique_lines")).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        base.alias("base_failed"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(failed).cast("long").alias("n_failed_lines"),
        F.array_sort(F.array_distinct(failed)).alias("reasons"),
        (F.col("word_chars") - left).cast("long").alias("lost_chars"),
        F.array_join("good", "\n").alias("cleaned"),
    )
    kept = ~F.col("base_failed") & (100 * F.col("lost_chars") <= max_lost_pct * F.col("word_chars"))
    return w.withColumn("kept", kept).withColumnRenamed("key", key)
