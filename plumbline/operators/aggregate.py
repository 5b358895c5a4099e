"""One wide aggregate per table, returned as one row per column."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import col
from .schema import Field

# Aggregate expressions per job stage: generated code above this size stops compiling.
EXPRESSIONS_PER_PASS = 100


def batches(cols: Sequence[Field], width: int) -> list[list[Field]]:
    step = max(1, EXPRESSIONS_PER_PASS // max(1, width))
    return [list(cols[i : i + step]) for i in range(0, len(cols), step)]


def by_column(
    df: DataFrame,
    cols: Sequence[Field],
    build: Callable[[Field], dict[str, Column]],
    by: Sequence[str] = (),
) -> DataFrame:
    """Aggregate every column in one scan and unpivot the result.

    ``build`` gives the aggregates of one column; all columns must give the same
    names and types. Wide tables take several scans, each over its own columns,
    because the scan prunes the rest. Partial aggregation makes a hot segment in
    ``by`` cost one row per task.
    """
    built = [(f, build(f)) for f in cols]
    if not built:
        raise ValueError("no column to aggregate")
    width = len(built[0][1])
    step = max(1, EXPRESSIONS_PER_PASS // width)
    keys = [col(k) for k in by]
    parts = []
    for start in range(0, len(built), step):
        group = built[start : start + step]
        aggs = [e.alias(f"{f.ordinal}_{n}") for f, exprs in group for n, e in exprs.items()]
        rows = [
            F.struct(
                F.lit(f.ordinal).alias("ordinal"),
                F.lit(f.name).alias("name"),
                *(col(f"{f.ordinal}_{n}").alias(n) for n in exprs),
            )
            for f, exprs in group
        ]
        parts.append(df.groupBy(*keys).agg(*aggs).select(*keys, F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, parts)


def one_row(df: DataFrame, aggs: list[Column]) -> dict[str, object]:
    """Run global aggregates and fetch their values: one row per batch reaches the driver."""
    out: dict[str, object] = {}
    for i in range(0, len(aggs), EXPRESSIONS_PER_PASS):
        out.update(df.agg(*aggs[i : i + EXPRESSIONS_PER_PASS]).first().asDict())
    return out
