"""Semantic types: numeric, categorical, datetime, text."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import DATE_FORMATS, DATE_START, NUMBER_START, DateFormat, parse_date, to_numeric
from ..functions.values import col
from .aggregate import one_row
from .schema import Field, fields, normalise

SEMANTIC_TYPES = ("numeric", "categorical", "datetime", "text")

# A string column is categorical below this distinct share, or up to this many distinct values.
CATEGORICAL_SHARE = 0.2
CATEGORICAL_DISTINCT = 50

# Strings up to this length travel whole; longer ones as this much prefix and a digest.
KEY_CHARS = 64


@dataclass(frozen=True)
class Facts:
    """What the plan must know about a column before it is built."""

    field: Field
    may_be_numeric: bool
    formats: tuple[DateFormat, ...]
    long_values: bool

    @property
    def numeric_value(self) -> Column | None:
        """The column as double, or NULL where it is not a number column."""
        if self.field.is_number:
            return self.field.number
        return to_numeric(self.field.value) if self.may_be_numeric else None


def look(df: DataFrame, by: Sequence[str] = (), partial: bool = False) -> list[Facts]:
    """Fetch one row of facts on a normalised table: parse counts and lengths.

    Over a whole table a string column is a number (date) candidate only if all
    its values parse. Under ``by``, or if the table is ``partial``, each segment or part decides
    for itself, so one parsed value anywhere makes a candidate.
    """
    cols = [f for f in fields(df) if f.name not in by]
    aggs: list[Column] = []
    tested: list[Column] = []
    for f in cols:
        i = f.ordinal
        if f.kind == "string":
            # Numbers and dates begin alike; one cheap test spares other values all the patterns. It is made before the counts, once a value.
            tested.append(F.when(f.value.rlike(NUMBER_START), f.value).alias(f"{i}_c"))
            tested.append(F.when(f.value.rlike(DATE_START), f.value).alias(f"{i}_d"))
            aggs += [F.count(f"{i}_v").alias(f"{i}_n"), F.count(to_numeric(F.col(f"{i}_c"))).alias(f"{i}_numeric")]
            aggs += [F.count(parse_date(F.col(f"{i}_d"), d)).alias(f"{i}_date{j}") for j, d in enumerate(DATE_FORMATS)]
        if f.kind in ("string", "nested"):
            tested.append(f.value.alias(f"{i}_v"))
            aggs.append(F.max(F.length(f"{i}_v")).alias(f"{i}_length"))
    got = one_row(df.select(*tested), aggs) if aggs else {}

    def facts(f: Field) -> Facts:
        i = f.ordinal
        parsed = lambda k: got[f"{i}_{k}"] > 0 if by or partial else got[f"{i}_{k}"] == got[f"{i}_n"]
        return Facts(
            field=f,
            may_be_numeric=f.kind == "string" and parsed("numeric"),
            formats=tuple(
                d
                for j, d in enumerate(DATE_FORMATS)
                if f.kind == "string" and got[f"{i}_n"] > 0 and parsed(f"date{j}")
            ),
            long_values=(got.get(f"{i}_length") or 0) > KEY_CHARS,
        )

    return [facts(f) for f in cols]


def string_type(non_null: Column, numeric: Column, dates: Column, distinct: Column) -> Column:
    """Type of a string column from its counts.

    ``dates`` is the largest number of values that one layout parses: a mix of
    layouts is no date column. A column without any value converts to numbers
    vacuously and is numeric, as in the reference.
    """
    return (
        F.when((non_null > 0) & (dates == non_null), "datetime")
        .when(numeric == non_null, "numeric")
        .when((distinct < non_null * CATEGORICAL_SHARE) | (distinct <= CATEGORICAL_DISTINCT), "categorical")
        .otherwise("text")
    )


def physical_type(f: Field) -> str | None:
    """Type decided by the schema alone; None where the values decide."""
    if f.is_number:
        return "numeric"
    return {"bool": "categorical", "time": "datetime"}.get(f.kind)


def infer_types(df: DataFrame) -> DataFrame:
    """(ordinal, name, inferred_type) for every column."""
    from .columns import base_columns

    return base_columns(df).select("ordinal", "name", "inferred_type")


def type_counts(types: DataFrame) -> DataFrame:
    """Columns per semantic type, all four types present."""
    every = types.sparkSession.createDataFrame([(t,) for t in SEMANTIC_TYPES], "inferred_type string")
    found = types.groupBy("inferred_type").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(every).join(found, "inferred_type", "left").select(
        "inferred_type", F.coalesce("n", F.lit(0)).alias("n_columns")
    )


def type_summary(columns: DataFrame) -> DataFrame:
    """Columns per semantic type, present types only, sorted."""
    return columns.groupBy("inferred_type").agg(F.count(F.lit(1)).alias("n_columns")).orderBy("inferred_type")


def split_by_dtype(df: DataFrame) -> DataFrame:
    """(ordinal, name, group) for number and string columns by schema; others are in neither group."""
    rows = [
        (f.ordinal, f.name, "numerical" if f.is_number else "categorical")
        for f in fields(df)
        if f.is_number or f.kind == "string"
    ]
    return df.sparkSession.createDataFrame(rows, "ordinal int, name string, group string")
