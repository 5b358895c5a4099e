"""Lenient conversions: what does not parse becomes NULL instead of failing under ANSI mode."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import WHITESPACE, strip

NUMBER = rf"^{WHITESPACE}*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?{WHITESPACE}*\z"

# How every number and every date layout begins.
NUMBER_START = rf"^(?:{WHITESPACE}*[+\-.0-9]|(?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec))"

# Nanosecond timestamps reach from 1677 to 2262; only whole years inside count as dates.
FIRST_YEAR, LAST_YEAR = 1678, 2261

# How every date layout begins that number patterns do not rule out; keys of eight digits are rarely days of those years.
DATE_START = (
    r"^(?:(?:1[6-9]|2[0-2])\d\d(?:(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01]))?\z|\d{1,4}[-/ ]"
    r"|(?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec))"
)


@dataclass(frozen=True)
class DateFormat:
    """A date layout: the shape it must have and its rewrite to ISO order."""

    name: str
    shape: str
    iso: str
    named_month: int = 0  # the group that holds the name of the month, if any


# Names of months, short and long.
MONTHS = (
    "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?"
    "|nov(?:ember)?|dec(?:ember)?"
)

# The date layouts that are recognised, in the order they are tried.
DATE_FORMATS = (
    DateFormat("yyyy-MM-dd", r"^(\d{4})-(\d{2})-(\d{2})\z", "$1-$2-$3"),
    DateFormat("yyyy-MM-dd HH:mm:ss[.SSSSSS]", r"^(\d{4}-\d{2}-\d{2}) (\d{2}:\d{2}:\d{2}(\.\d{1,6})?)\z", "$1 $2"),
    DateFormat("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2}(\.\d{1,6})?)\z", "$1 $2"),
    DateFormat("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX", r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)(Z|[+-]\d{2}:\d{2})\z", "$1 $2$3"),
    DateFormat("yyyy-MM-dd HH:mm", r"^(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2})\z", "$1 $2:00"),
    DateFormat("M/d/yyyy", r"^(\d{1,2})/(\d{1,2})/(\d{4})\z", "$3-$1-$2"),
    DateFormat("yyyy/MM/dd", r"^(\d{4})/(\d{2})/(\d{2})\z", "$1-$2-$3"),
    DateFormat("yyyyMMdd", r"^(\d{4})(\d{2})(\d{2})\z", "$1-$2-$3"),
    DateFormat("yyyy-MM", r"^(\d{4})-(\d{2})\z", "$1-$2-01"),
    DateFormat("yyyy", r"^(\d{4})\z", "$1-01-01"),
    DateFormat("MMM d, yyyy", rf"(?i)^({MONTHS}) (\d{{1,2}}),? (\d{{4}})\z", "$3-$1-$2", 1),
    DateFormat("d MMM yyyy", rf"(?i)^(\d{{1,2}})[ -]({MONTHS})[ -](\d{{4}})\z", "$3-$2-$1", 2),
)
# The same with the day first where both could be meant.
DAY_FIRST = tuple(
    DateFormat("d/M/yyyy", f.shape, "$3-$2-$1") if f.name == "M/d/yyyy" else f for f in DATE_FORMATS
)


def to_numeric(c: Column) -> Column:
    """Text to double. The shape test comes first because casts also accept forms such as '1d'."""
    return F.when(c.rlike(NUMBER), strip(c).try_cast("double"))


def parse_date(c: Column, fmt: DateFormat) -> Column:
    """Text in one layout to timestamp.

    The rewrite to ISO order keeps parsing on the cast path, which reports bad
    input without raising; a formatter would throw once per bad row.
    """
    iso = F.regexp_replace(c, fmt.shape, fmt.iso)
    if fmt.named_month:
        name = F.lower(F.left(F.regexp_extract(c, fmt.shape, fmt.named_month), F.lit(3)))
        number = F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), name) + 2
        iso = F.regexp_replace(iso, F.lit("(?i)[a-z]+"), (number / 3).cast("int").cast("string"))
    ts = F.when(c.rlike(fmt.shape), iso.try_cast("timestamp"))
    return F.when(F.year(ts).between(FIRST_YEAR, LAST_YEAR), ts)


def to_datetime(c: Column, formats: tuple[DateFormat, ...] = DATE_FORMATS) -> Column:
    """Text to timestamp by the first layout that fits."""
    return F.coalesce(*(parse_date(c, f) for f in formats))


def nan_to_null(c: Column) -> Column:
    """NaN counts as missing; Spark would otherwise let it poison every aggregate."""
    return F.when(~F.isnan(c), c)
