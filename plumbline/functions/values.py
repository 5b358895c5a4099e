"""Small column helpers: quoting, trimming, rounding and number formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python's str.strip and str.split see it: the Unicode property and
# four separators. The property is one table look-up per character; spelling the
# ranges out in a class is three times slower.
WHITESPACE = r"(?U:[\s\x{1C}-\x{1F}])"
# The same without the line feed, for patterns that stay inside one line.
INLINE_SPACE = r"(?U:[\s\x{1C}-\x{1F}&&[^\n]])"
# A run of anything else. For short texts: splitting compiles its pattern for every call.
WORD = r"(?U:[^\s\x{1C}-\x{1F}])+"
# Fixed value: the same characters one by one.
SPACES = "".join(
    map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)


def col(name: str) -> Column:
    """A column by its exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(c: Column) -> Column:
    """Remove white space (not only blanks) from both ends."""
    return F.btrim(c, F.lit(SPACES))


def exact_round(c: Column, places: int) -> Column:
    """Round half up on the decimal value, so 1.005 gives 1.01 rather than 1.0."""
    return F.coalesce(F.round(c.try_cast("decimal(30,8)"), places).cast("double"), F.round(c, places))


def fixed(c: Column, places: int) -> Column:
    """Text with a fixed number of decimals; values beyond the decimal range fall back to printf."""
    return F.coalesce(
        F.round(c.try_cast("decimal(30,8)"), places).cast("string"),
        F.format_string(f"%.{places}f", c.cast("double")),
    )


def thousands(c: Column) -> Column:
    """Integer with thousands separators."""
    return F.format_string("%,d", c.cast("bigint"))


def percent(part: Column, whole: Column) -> Column:
    """part / whole * 100, or 0.0 for an empty whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")) * 100, F.lit(0.0))


def words(c: Column) -> Column:
    """Tokens between runs of white space, without empty ones."""
    return F.filter(F.split(c, WHITESPACE + "+", -1), lambda w: w != "")


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)
