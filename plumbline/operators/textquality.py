"""Low-quality text filter over a table of texts. Every test looks at one row; nothing shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import at, let
from ..functions.markdown import SHORTEST_TEXT
from ..functions.values import WORD, col, lines, strip, words

# Phrases that report a failed generation.
FAILURE_PHRASES = (
    "error generating response",
    "unable to generate",
    "failed to analyze",
    "cannot process",
    "insufficient data",
    "analysis failed",
)

REASONS = ("too_short", "failure_phrase", "repetitive", "mostly_headers", "few_sentences", "fragmented")


def repetitive(text: Column) -> Column:
    """True if, in more than ten words, some four-word phrase stands more than twice in the text.

    Counts are of non-overlapping substrings, partial words at the ends included.
    Counting every phrase would be quadratic, so phrases are narrowed first: an
    occurrence shows up as a window whose last three words start with the
    phrase's. After sorting these tails with their places, one with three
    occurrences has another that starts with it two places on, and only such
    phrases are counted, until one is found.
    """

    def tail(w: Column, i: Column) -> Column:
        blank = F.lit(" ")
        return F.concat(at(w, i + 1), blank, at(w, i + 2), blank, at(w, i + 3))

    def placed(w: Column) -> Column:
        return F.sort_array(F.transform(w, lambda x, i: F.struct(tail(w, i).alias("t"), i.alias("i"))))

    def phrases(w: Column, s: Column) -> Column:
        # Of equal tails, the last two have no third one behind them: their neighbours tell.
        third = lambda r: F.startswith(at(s, r + 2)["t"], at(s, r)["t"])
        same = lambda r, x: F.coalesce(at(s, r)["t"] == x["t"], F.lit(False))
        hit = lambda r: F.coalesce(third(r), F.lit(False))

        def phrase(x: Column, r: Column) -> Column:
            # The last phrases of a text are occurrences but not candidates.
            listed = (x["i"] <= F.size(w) - 7) & (hit(r) | (same(r - 1, x) & hit(r - 1)) | (same(r - 2, x) & hit(r - 2)))
            return F.when(listed, F.concat(at(w, x["i"]), F.lit(" "), x["t"]))

        return F.array_distinct(F.filter(F.transform(s, phrase), lambda p: p.isNotNull()))

    def often(t: Column, p: Column) -> Column:
        return (F.length(t) - F.length(F.replace(t, p, F.lit("")))) > F.length(p) * 2

    def test(t: Column, w: Column) -> Column:
        found = let(placed(w), lambda s: F.exists(phrases(w, s), lambda p: often(t, p)))
        return F.when(F.size(w) > 10, found).otherwise(False)

    return let(text, lambda t: let(words(t), lambda w: test(t, w)))


def mostly_headers(text: Column) -> Column:
    """More header than content lines, in more than five lines."""

    def test(ls: Column) -> Column:
        heads = F.size(F.filter(ls, lambda s: F.startswith(s, F.lit("#"))))
        body = F.size(F.filter(ls, lambda s: (s != "") & ~F.startswith(s, F.lit("#"))))
        return (heads > body) & (F.size(ls) > 5)

    return let(F.transform(lines(strip(text)), strip), test)


def sentence_lengths(text: Column) -> Column:
    """Words per sentence; sentences end at full stops, blank ones do not count."""
    parts = F.filter(F.split(text, r"\.", -1), lambda s: strip(s) != "")
    return F.transform(parts, lambda s: F.size(F.regexp_extract_all(s, F.lit(WORD), 0)))


def low_quality_flags(text: Column) -> dict[str, Column]:
    """One flag per reason; a NULL text is too short and nothing else."""
    known = lambda c: F.coalesce(c, F.lit(False))
    low = F.lower(text)
    phrase = F.lit(False)
    for p in FAILURE_PHRASES:
        phrase = phrase | F.contains(low, F.lit(p))
    lengths = sentence_lengths(text)
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, n: s + n)
    return {
        "too_short": F.coalesce(F.length(strip(text)) < SHORTEST_TEXT, F.lit(True)),
        "failure_phrase": known(phrase),
        "repetitive": known(repetitive(text)),
        "mostly_headers": known(mostly_headers(text)),
        "few_sentences": known(F.size(lengths) < 3) & text.isNotNull(),
        "fragmented": known(let(lengths, lambda a: (F.size(a) > 2) & (total(a) < F.size(a) * 3))) & text.isNotNull(),
    }


def low_quality(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, one flag per reason, is_low)."""
    flags = low_quality_flags(col(text))
    out = df.select(col(key), *(c.alias(n) for n, c in flags.items()))
    any_of = F.lit(False)
    for n in flags:
        any_of = any_of | F.col(n)
    return out.withColumn("is_low", any_of)
