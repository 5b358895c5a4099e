"""Markdown and text clean-up as column expressions: no shuffle, one row in, one value out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import at, let
from .values import INLINE_SPACE, WHITESPACE, lines, strip

HEADER = rf"^#{{1,6}}{INLINE_SPACE}+([^\n]+)"

BLANK_RUN = rf"\n{WHITESPACE}*\n{WHITESPACE}*\n"
HEADER_THEN_TEXT = r"(^|\n)(#[^\n]*)\n([^#\n])"

# Traces of a text generator that are removed, and what replaces a text too short to use.
ARTEFACTS = ("**Error generating response**:", "Response:")
PLACEHOLDER = "**Unable to generate detailed analysis.** The model output was too brief or incomplete."
SHORTEST_TEXT = 100

# Words that mark a column description as troubled.
ISSUE_WORDS = ("issue", "problem", "concern", "missing", "outlier", "skewed", "empty", "rare", "duplicate")

BLOCK_BREAK = rf"\n#+{WHITESPACE}+"


def clean_markdown(c: Column) -> Column:
    """Collapse runs of blank lines, trim, and put a blank line after each header that text follows."""
    c = strip(F.regexp_replace(c, BLANK_RUN, "\n\n"))
    return F.regexp_replace(c, HEADER_THEN_TEXT, "$1$2\n\n$3")


def estimate_tokens(c: Column) -> Column:
    """About four characters per token."""
    return F.floor(F.length(c) / 4).cast("bigint")


def collapse_lines(c: Column) -> Column:
    """Trimmed lines without blanks and consecutive repeats; artefacts removed; a placeholder if little is left."""
    kept = let(
        F.filter(F.transform(lines(c), strip), lambda s: s != ""),
        lambda a: F.filter(a, lambda s, i: (i == 0) | (s != F.coalesce(at(a, i - 1), F.lit("")))),
    )
    out = F.array_join(kept, "\n")
    for artefact in ARTEFACTS:
        out = F.replace(out, F.lit(artefact), F.lit(""))
    return let(out, lambda t: F.when(F.length(strip(t)) < SHORTEST_TEXT, F.lit(PLACEHOLDER)).otherwise(t))


def section_key(header: Column) -> Column:
    """Section name of a header line: lower case with underscores; empty if it is no header."""
    return F.replace(F.lower(strip(F.regexp_extract(header, HEADER, 1))), F.lit(" "), F.lit("_"))


def sections(c: Column) -> Column:
    """array<struct<section, section_no, content>> of a text; a repeated name keeps its last content.

    Lines before the first header belong to no section, nor do lines under a
    header without a name.
    """

    def cut(ls: Column) -> Column:
        heads = F.filter(
            F.transform(ls, lambda s, i: F.struct(i.alias("i"), s.alias("s"))), lambda h: h["s"].rlike(HEADER)
        )
        return let(heads, lambda hs: F.transform(hs, lambda h, k: part(ls, hs, h, k)))

    def part(ls: Column, hs: Column, h: Column, k: Column) -> Column:
        end = F.coalesce(at(hs, k + 1)["i"], F.size(ls))
        body = F.array_join(F.slice(ls, h["i"] + 2, end - h["i"] - 1), "\n")
        return F.struct(section_key(h["s"]).alias("section"), (-k).alias("last"), strip(body).alias("content"))

    found = F.sort_array(F.filter(let(lines(c), cut), lambda p: p["section"] != ""))
    return let(
        found,
        lambda ps: F.transform(
            F.filter(ps, lambda p, i: (i == 0) | (p["section"] != F.coalesce(at(ps, i - 1)["section"], F.lit("")))),
            lambda p: F.struct(p["section"].alias("section"), (-p["last"]).alias("section_no"), p["content"].alias("content")),
        ),
    )


def issue_count(block: Column) -> Column:
    """How many of the issue words occur in a block."""
    low = F.lower(block)
    return sum((F.contains(low, F.lit(w)).cast("int") for w in ISSUE_WORDS), F.lit(0))


def ranked_blocks(c: Column) -> Column:
    """array<struct<rank_key, pos, block>>: header blocks of a profile section, most troubled first, lead text dropped."""

    def shape(b: Column, i: Column) -> Column:
        titled = F.when(F.startswith(strip(b), F.lit("#")), strip(b)).otherwise(
            strip(F.concat(F.lit("### "), strip(at(F.split(b, r"\.", 2), F.lit(0))), F.lit("\n"), b))
        )
        return F.struct((-issue_count(b)).alias("rank_key"), i.alias("pos"), b.alias("raw"), titled.alias("block"))

    def order(parts: Column) -> Column:
        # The first part is the text before any header.
        blocks = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), shape)
        return F.sort_array(F.filter(blocks, lambda b: strip(b["raw"]) != ""))

    return let(F.split(c, BLOCK_BREAK, -1), order)


def format_profiles(c: Column) -> Column:
    """A profile section with its blocks in rank order; unchanged if it has none."""
    blank = strip(c) == ""
    many = F.size(F.split(c, BLOCK_BREAK, -1)) > 1
    joined = F.array_join(F.transform(ranked_blocks(c), lambda b: b["block"]), "\n\n")
    return F.when(blank, "").when(many, joined).otherwise(c)
