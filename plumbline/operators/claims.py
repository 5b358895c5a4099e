"""Numeric claims in texts: extraction with positions, and verification against profiles."""

from __future__ import annotations

import re
import sys
from collections.abc import Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import SPACES, WHITESPACE, col, fixed, percent
from ..session import settle

# Executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CONTEXT_CHARS = 50
_NUMBER, _COUNT, _SPACE = r"(\d+(?:\.\d+)?)", r"(\d+(?:,\d+)*)", WHITESPACE + "*"

# What counts as a claim, by kind and in order of extraction.
PATTERNS = (
    ("percentage", rf"{_NUMBER}{_SPACE}%{_SPACE}(missing|null|empty|complete|non-null)"),
    ("percentage", rf"{_NUMBER}{_SPACE}%{_SPACE}(duplicate|duplicated)"),
    ("percentage", rf"{_NUMBER}{_SPACE}%{_SPACE}(zero|zeros)"),
    ("range", rf"(?:range|ranges?){_SPACE}:?{_SPACE}{_NUMBER}{_SPACE}(?:to|-){_SPACE}{_NUMBER}"),
    ("min_value", rf"(?:min|minimum){_SPACE}:?{_SPACE}{_NUMBER}"),
    ("max_value", rf"(?:max|maximum){_SPACE}:?{_SPACE}{_NUMBER}"),
    ("mean_value", rf"(?:mean|average){_SPACE}:?{_SPACE}{_NUMBER}"),
    ("row_count", rf"{_COUNT}{_SPACE}(?:rows?|records?)"),
    ("column_count", rf"{_COUNT}{_SPACE}(?:columns?)"),
    ("unique_count", rf"{_COUNT}{_SPACE}(?:unique|distinct){_SPACE}(?:values?)"),
    ("outlier_count", rf"{_COUNT}{_SPACE}(?:outliers?)"),
    ("memory_mb", rf"{_NUMBER}{_SPACE}(?:MB|mb|megabytes?)"),
    ("days_count", rf"(\d+){_SPACE}days?"),
)
COUNTS = ("row_count", "column_count", "unique_count", "outlier_count")

# Two passes over the lower-cased text find every match of the patterns: numbers with a word before them, and numbers with a word
# after them. Numbers and gaps are taken whole, so that long runs of digits or blanks are read once. No word of a pass ends or
# begins inside a match of the same pass, so none hides another.
_GAP = f"[{SPACES}]*+"
_DECIMAL = r"[0-9]++(?:\.[0-9]++)?"
_BEFORE = re.compile(
    rf"(?:ranges?+|min(?:imum)?+|max(?:imum)?+|mean|average){_GAP}:?+{_GAP}({_DECIMAL})(?:{_GAP}(?:to|-){_GAP}({_DECIMAL}))?"
)
_AFTER = re.compile(
    rf"([0-9](?<![0-9].)(?<![0-9][.,].)[0-9]*+(?:[.,][0-9]++)*+){_GAP}(?:%{_GAP}(?:(missing|null|empty|complete|non-null)|(duplicate)|(zero))"
    rf"|(rows?|records?)|(columns?)|((?:unique|distinct){_GAP}values?)|(outliers?)|(mb|megabytes?)|(days?))"
)
# Pattern number of a word before a number, and of a group of _AFTER.
_LEADING = {"ra": 3, "mi": 4, "ma": 5, "me": 6, "av": 6}
_CLOSING = (None, None, 0, 1, 2, 7, 8, 9, 10, 11, 12)
KINDS = tuple(kind for kind, _ in PATTERNS)
CLAIM = "type string, text string, start int, end int, context string, value double, min_value double, max_value double"


def _number_at(block: str, kind: str) -> int:
    """Where the number of a claim begins in the digits, points and commas before its word."""
    if kind in COUNTS:
        return block.rfind(".") + 1
    comma = block.rfind(",")
    point = block.rfind(".", comma + 1)
    if kind == "days_count" or point < 0:
        return max(comma, point) + 1
    return max(comma, block.rfind(".", comma + 1, point)) + 1


def find_claims(text: str) -> list[tuple[int, int, int, float | None, float | None, float | None]]:
    """(pattern, start, end, value, min_value, max_value) of all claims in a text, by pattern and position."""
    # Only this letter changes its length in lower case, and it is none of a claim's.
    low = text.replace("\u0130", "\u0131").lower()
    found = []
    for m in _AFTER.finditer(low):
        no = _CLOSING[m.lastindex]
        block = m[1]
        skipped = _number_at(block, KINDS[no]) if "," in block or "." in block else 0
        found.append((no, m.start() + skipped, m.end(), float(block[skipped:].replace(",", "")), None, None))
    for m in _BEFORE.finditer(low):
        no = _LEADING[m[0][:2]]
        if no > 3:
            found.append((no, m.start(), m.end(1), float(m[1]), None, None))
        elif m[2]:
            found.append((no, m.start(), m.end(2), None, float(m[1]), float(m[2])))
    found.sort(key=lambda c: c[:2])
    return found


def _claims_of_batch(texts: pa.Array) -> pa.Array:
    ends, rows = [0], []
    for raw in texts.cast(pa.binary()).to_pylist():
        if raw is not None:
            t = raw.decode("utf-8", "replace")
            for no, start, end, value, low, high in find_claims(t):
                x = t[start:end]
                context = f"{t[max(start - CONTEXT_CHARS, 0) : start]}**{x}**{t[end : end + CONTEXT_CHARS]}"
                rows.append((KINDS[no], x, start, end, context, value, low, high))
        ends.append(len(rows))
    types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.float64())
    names = [f.split()[0] for f in CLAIM.split(", ")]
    columns = list(zip(*rows)) or [()] * len(names)
    structs = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)


def claims(text: Column) -> Column:
    """All claims of a text as one array, by pattern and position; empty without any."""
    kind = f"array<struct<{', '.join(f.replace(' ', ': ') for f in CLAIM.split(', '))}>>"
    # Else the filter that Spark adds before exploding finds all claims once more, ahead of any repartition.
    return F.arrow_udf(_claims_of_batch, kind).asNondeterministic()(text)


def extract_claims(df: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """(keys, claim_no, type, text, start, end, context, value, min_value, max_value)."""
    found = df.select(*[col(k) for k in keys], claims(col(text)).alias("_found"))
    found = found.select(*[col(k) for k in keys], F.posexplode("_found").alias("_no", "_c"))
    fields = ("type", "text", "start", "end", "context", "value", "min_value", "max_value")
    return found.select(*[col(k) for k in keys], (F.col("_no") + 1).alias("claim_no"), *(F.col(f"_c.{f}") for f in fields))


GRAM_CHARS = 3


def _grams(c: Column, n: int) -> Column:
    """All runs of n characters."""
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n))))


def named_columns(found: DataFrame, columns: DataFrame) -> DataFrame:
    """(dataset, context, column): the first column, in table order, whose name occurs in a context, as a struct.

    An inverted index: each name is filed under its rarest run of three characters (a shorter name under itself), contexts look up
    their own runs, and only the names found there are searched for. So a claim costs what its context says, however many columns there are. Each different context
    is searched once.
    """
    low = F.lower("name")
    about = F.struct("name", "inferred_type", "non_null_pct", "zeros_pct").alias("column")
    names = columns.select("dataset", "ordinal", low.alias("low"), about)
    size = F.least(F.length("low"), F.lit(GRAM_CHARS))
    runs = F.transform(F.sequence(F.lit(1), F.length("low") - size + 1), lambda i: F.substring(F.col("low"), i, size))
    filed = names.select("dataset", "ordinal", F.explode(F.array_distinct(F.when(F.col("low") == "", F.array(F.lit(""))).otherwise(runs))).alias("gram"))
    common = filed.groupBy("dataset", "gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = filed.join(common, ["dataset", "gram"]).groupBy("dataset", "ordinal").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    index = settle(rarest.join(names, ["dataset", "ordinal"]))
    sizes = [r[0] for r in index.select(F.length("gram")).distinct().collect()]  # 0 to 3
    words = F.lower("context")
    asked = [_grams(words, n) if n else F.array(F.lit("")) for n in sizes] or [F.array().cast("array<string>")]
    contexts = found.select("dataset", "context").distinct()
    looked_up = contexts.select("dataset", "context", F.explode(F.array_distinct(F.concat(*(F.coalesce(a, F.array().cast("array<string>")) for a in asked)))).alias("gram"))
    met = looked_up.join(index, ["dataset", "gram"]).where(F.contains(F.lower("context"), F.col("low")))
    return met.groupBy("dataset", "context").agg(F.min_by("column", "ordinal").alias("column"))


# Up to so many columns in a table, a claim tries every name; more are looked up by their runs of characters.
FEW_COLUMNS = 200
# Names of all tables, and facts of these tables, are sent to every executor up to so many.
SENT_NAMES = 50_000


def _with_profile(found: DataFrame, dataset: DataFrame, columns: DataFrame) -> DataFrame:
    """Claims with ``_d``, the facts of their dataset, and ``_hit``, the column that a share is about, as in ``named_columns``; ``_low`` is the context in lower case.

    Where all tables are narrow, facts and names go to the claims, which neither move nor are joined by their contexts.
    """
    d = dataset.select(F.col("dataset").alias("_dataset"), F.struct("n_rows", "n_cols", "size_mb", "duplicate_rows_pct").alias("_d"))
    about = F.struct("name", "inferred_type", "non_null_pct", "zeros_pct").alias("column")
    listed = F.array_sort(F.collect_list(F.struct("ordinal", F.lower("name").alias("low"), about)))
    names = settle(columns.groupBy(F.col("dataset").alias("_dataset")).agg(listed.alias("_names")))
    widest, total = names.agg(F.max(F.size("_names")), F.sum(F.size("_names"))).first()
    share = F.col("type") == "percentage"
    sent = F.broadcast if (total or 0) <= SENT_NAMES else lambda x: x
    found = found.join(sent(d), F.col("dataset") == F.col("_dataset"), "left").drop("_dataset")
    if (widest or 0) <= FEW_COLUMNS:
        hit = F.get(F.filter("_names", lambda n: F.contains(F.col("_low"), n["low"])), F.lit(0))["column"]
        joined = found.join(sent(names), F.col("dataset") == F.col("_dataset"), "left")
        return joined.withColumn("_hit", F.when(share, hit)).drop("_dataset", "_names")
    every = names.select(F.col("_dataset").alias("dataset"), F.explode("_names").alias("_n"))
    every = every.select("dataset", "_n.ordinal", "_n.column.*")
    named = named_columns(found.where(share), every)
    named = named.select(F.col("dataset").alias("_dataset"), F.col("context").alias("_context"), F.col("column").alias("_hit"))
    same = (F.col("dataset") == F.col("_dataset")) & (F.col("context") == F.col("_context")) & share
    return found.join(named, same, "left").drop("_dataset", "_context")


def verify_claims(found: DataFrame, dataset: DataFrame, columns: DataFrame) -> DataFrame:
    """Check claims against the profile that their ``dataset`` names; adds verified, actual_value, discrepancy, column_name.

    Tolerances: 1% of the rows (at least one), exact columns, 10% of the size (at
    least 0.1 MB), one point for duplicates, two points for column shares. A
    column share is checked against the first column, in table order, whose name
    occurs in the context. Other kinds cannot be verified.
    """
    joined = _with_profile(found.withColumn("_low", F.lower("context")), dataset, columns)

    has = lambda w: F.contains(F.col("_low"), F.lit(w))
    d = lambda n: F.coalesce(F.col(f"_d.{n}").cast("double"), F.lit(0.0))
    kind, value = F.col("type"), F.col("value")

    share = F.col("_hit.non_null_pct")
    about_missing = has("missing") | has("null")
    of_column = (
        F.when(about_missing & (has("non-null") | has("complete")), share)
        .when(about_missing, 100 - share)
        .when(has("zero") & (F.col("_hit.inferred_type") == "numeric"), F.coalesce("_hit.zeros_pct", F.lit(0.0)))
    )
    by_column = (kind == "percentage") & ~has("duplicate")
    actual = (
        F.when(kind == "row_count", d("n_rows"))
        .when(kind == "column_count", d("n_cols"))
        .when(kind == "memory_mb", d("size_mb"))
        .when((kind == "percentage") & has("duplicate"), d("duplicate_rows_pct"))
        .when(by_column & F.col("_hit").isNotNull(), of_column)
    )
    joined = joined.withColumn("actual_value", actual)
    a = F.col("actual_value")
    allowed = (
        F.when(kind == "row_count", F.greatest(F.lit(1.0), a * 0.01))
        .when(kind == "column_count", F.lit(0.0))
        .when(kind == "memory_mb", F.greatest(F.lit(0.1), a * 0.1))
        .when(by_column, F.lit(2.0))
        .when(kind == "percentage", F.lit(1.0))
    )
    verified = F.coalesce(F.abs(a - value) <= allowed, F.lit(False))
    claimed = F.when(kind.isin(*COUNTS), value.cast("bigint").cast("string")).otherwise(value.cast("string"))
    discrepancy = F.when(
        ~F.col("verified") & a.isNotNull(),
        F.when(kind == "percentage", F.concat(fixed(F.abs(a - value), 1), F.lit(" percentage points")))
        .when(a != 0, F.concat(fixed(F.try_divide(F.abs(a - value), a) * 100, 1), F.lit("% difference")))
        .otherwise(F.concat(F.lit("Expected 0, got "), claimed)),
    )
    return (
        joined.withColumn("verified", verified)
        .withColumn("discrepancy", discrepancy)
        .withColumn("column_name", F.when(by_column & a.isNotNull(), F.col("_hit.name")))
        .drop("_d", "_low", "_hit")
    )


NOTES_TITLE = "## Verification Notes\n"
NOTES_LEAD = "*The following numeric claims in this report have been automatically cross-checked against the source data:*\n"


def claim_notes(verified: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, notes): one numbered note per failed claim; texts without failures have no row."""
    failed = verified.where(~F.col("verified"))
    # The claims of one text: bounded by its length.
    listed = F.array_sort(F.collect_list(F.struct("claim_no", "context", "actual_value", "discrepancy")))

    def note(c: Column, i: Column) -> Column:
        extra = F.when(F.coalesce(c["discrepancy"], F.lit("")) != "", F.concat(F.lit(" ("), c["discrepancy"], F.lit(")"))).otherwise("")
        known = F.concat(F.lit("*Auto-corrected: actual value is "), fixed(c["actual_value"], 1), extra, F.lit("*\n"))
        unknown = F.lit("*Could not verify this claim against source data*\n")
        return F.concat(
            (i + 1).cast("string"),
            F.lit(". **"),
            c["context"],
            F.lit("**  \n   ⚠️ "),
            F.when(c["actual_value"].isNotNull(), known).otherwise(unknown),
        )

    grouped = failed.groupBy(col(key)).agg(listed.alias("_c"))
    head = F.array(F.lit(NOTES_TITLE), F.lit(NOTES_LEAD))
    return grouped.select(col(key), F.array_join(F.concat(head, F.transform("_c", note)), "\n").alias("notes"))


def annotate(df: DataFrame, verified: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): each report with its notes after a rule; unchanged without notes."""
    notes = claim_notes(verified, key)
    whole = F.when(F.col("notes").isNull(), col(text)).otherwise(F.concat(col(text), F.lit("\n\n---\n\n"), F.col("notes")))
    return df.select(key, text).join(notes, key, "left").select(col(key), whole.alias(text))


def verification_summary(verified: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, claims, failures, success_pct, warning): over all claims; 100% if there are none, a warning below 90%."""
    total, bad = F.count(F.lit(1)), F.count_if(~F.col("verified"))
    success = F.when(total == 0, 100.0).otherwise(100 - percent(bad, total))
    return verified.groupBy(*[col(k) for k in by]).agg(
        total.alias("claims"), bad.alias("failures"), success.alias("success_pct"), (success < 90).alias("warning")
    )
