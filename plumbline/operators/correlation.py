"""Pairwise-complete Pearson correlation over number columns."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import col
from .aggregate import one_row
from .schema import Field, fields, normalise, number_fields

PAIRS = "ordinal1 int, column1 string, ordinal2 int, column2 string, correlation double"


# Below this share of the squares, what is left around the mean is rounding noise.
FLAT = 1e-13


# Columns of a block: a task holds the sums of all pairs of two blocks.
BLOCK = 256
# Segments whose sums a task holds before it hands them on, by their number of values.
HELD_VALUES = 4_000_000


def _gram(n_keys: int, left: int, right: int, held_values: int):
    """Sums over pairs of a column of the left block and one of the right block (or both of one block, if ``right`` is 0).

    Products of matrices: counts come from the null masks, sums of a column over the rows that have the other from its values
    and the other's mask. Nested, so that it travels by value.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        one_block = not right
        kinds: list[pa.DataType] = []

        def sums(x: np.ndarray) -> np.ndarray:
            there = ~np.isnan(x)
            m = there.astype(np.float64)
            v = np.where(there, x, 0.0)
            # What is infinite must not meet a mask of zero.
            odd = np.flatnonzero(np.isinf(v).any(axis=0))
            clean = np.where(np.isinf(v), 0.0, v)
            a, b = (slice(0, left), slice(0, left)) if one_block else (slice(0, left), slice(left, left + right))
            sq = clean * clean
            out = np.stack(
                [m[:, a].T @ m[:, b], clean[:, a].T @ m[:, b], m[:, a].T @ clean[:, b], sq[:, a].T @ m[:, b], m[:, a].T @ sq[:, b], clean[:, a].T @ clean[:, b]]
            )
            if len(odd):
                for i in range(a.start, a.stop):
                    for j in range(b.start, b.stop):
                        if i in odd or j in odd:
                            both = there[:, i] & there[:, j]
                            p, q = v[both, i], v[both, j]
                            with np.errstate(all="ignore"):
                                out[:, i - a.start, j - b.start] = both.sum(), p.sum(), q.sum(), (p * p).sum(), (q * q).sum(), (p * q).sum()
            return out

        def rows() -> Iterator[pa.RecordBatch]:
            i, j = np.triu_indices(left, 1) if one_block else (x.ravel() for x in np.indices((left, right)))
            far = 0 if one_block else left
            for key, total in held.items():
                met = total[0][i, j] > 0
                keys = [pa.array([k] * int(met.sum()), t) for k, t in zip(key, kinds, strict=True)]
                values = [pa.array(t[i[met], j[met]]) for t in total]
                places = [pa.array(i[met].astype(np.int32)), pa.array((j[met] + far).astype(np.int32))]
                names = [*(f"key{k}" for k in range(n_keys)), "i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"]
                yield pa.RecordBatch.from_arrays([*keys, *places, *values], names=names)
            held.clear()

        for batch in batches:
            kinds = [batch.schema.field(k).type for k in range(n_keys)]
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys, batch.num_columns)]
            x = np.column_stack(columns).astype(np.float64) if batch.num_rows else np.empty((0, len(columns)))
            if not n_keys:
                groups = {(): slice(None)}
            else:
                places: dict[tuple, list[int]] = {}
                for at, key in enumerate(zip(*(batch.column(k).to_pylist() for k in range(n_keys)), strict=True)):
                    places.setdefault(key, []).append(at)
                groups = {k: np.array(v) for k, v in places.items()}
            for key, at in groups.items():
                part = sums(x[at])
                held[key] = held[key] + part if key in held else part
                if len(held) * part.size > held_values:
                    yield from rows()
        yield from rows()

    return run


def _sums(df: DataFrame, keys: Sequence[str], columns: list[Column]) -> DataFrame:
    """(keys, i, j, n, sx, sy, sxx, syy, sxy) for the pairs i < j of columns that meet in a row: one scan per pair of blocks."""
    out = T.StructType(
        [*(T.StructField(f"key{k}", df.schema[name].dataType) for k, name in enumerate(keys)), T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())]
        + [T.StructField(c, T.DoubleType()) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]
    )
    named = [col(k).alias(f"key{i}") for i, k in enumerate(keys)]
    blocks = [list(range(s, min(s + BLOCK, len(columns)))) for s in range(0, len(columns), BLOCK)]
    parts = []
    for a, left in enumerate(blocks):
        for right in [[], *blocks[a + 1 :]]:
            both = [*left, *right]
            cells = df.select(*named, *(columns[k].alias(f"v{k}") for k in both))
            found = cells.mapInArrow(_gram(len(keys), len(left), len(right), HELD_VALUES), out)
            # Places in the two blocks back to places in the table; a block of one's own has no second one.
            start = right[0] - len(left) if right else left[0]
            parts.append(found.withColumn("i", F.col("i") + left[0]).withColumn("j", F.col("j") + start))
    every = reduce(DataFrame.unionByName, parts)
    grouped = every.groupBy(*(f"key{k}" for k in range(len(keys))), "i", "j")
    return grouped.agg(*(F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))).withColumnsRenamed({f"key{i}": k for i, k in enumerate(keys)})


def _pairs(df: DataFrame, columns: list[tuple[Field, Column]], by: Sequence[str] = ()) -> DataFrame:
    """(by, ordinal1, column1, ordinal2, column2, correlation) for every pair in table order; NULL beside a constant.

    A first scan finds means. Values are then summed relative to the mean of the whole
    table, which keeps plain sums accurate. One more scan (per pair of blocks of ``BLOCK`` columns) sums all pairs at once as products of
    matrices: a task gives one row per pair (and segment), however many rows it reads.
    """
    keys = [col(k) for k in by]
    if len(columns) < 2:
        empty = df.select(*keys).limit(0)
        return empty.select(*keys, F.inline(F.from_json(F.lit("[]"), f"array<struct<{PAIRS.replace(' ', ':').replace(',:', ',')}>>")))
    aggs = []
    for f, x in columns:
        aggs += [e.alias(f"{f.ordinal}_{n}") for n, e in (("m", F.avg(x)), ("lo", F.min(x)), ("hi", F.max(x)))]
    got = one_row(df, aggs)

    def shifted(f: Field, x: Column) -> Column:
        # A constant is shifted by itself: its mean may be off in the last digit.
        flat = got[f"{f.ordinal}_lo"] == got[f"{f.ordinal}_hi"]
        by = float(got[f"{f.ordinal}_lo" if flat else f"{f.ordinal}_m"] or 0.0)
        return x - F.lit(by if math.isfinite(by) else 0.0)

    sums = _sums(df, by, [shifted(f, x) for f, x in columns])
    around = lambda s, ss: F.col(ss) - F.col(s) * F.col(s) / F.col("n")
    spread = lambda s, ss: F.when(around(s, ss) > F.col(ss) * FLAT, around(s, ss))
    together = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    r = F.try_divide(together, F.sqrt(spread("sx", "sxx")) * F.sqrt(spread("sy", "syy")))
    found = sums.select(*keys, "i", "j", F.when(r > 1, 1.0).when(r < -1, -1.0).otherwise(r).alias("correlation"))

    # One row per pair of the schema (and segment): also those that never meet in a row.
    names = df.sparkSession.createDataFrame([(k, f.ordinal, f.name) for k, (f, _) in enumerate(columns)], "k int, ordinal int, name string")
    a = names.select(F.col("k").alias("_i"), F.col("ordinal").alias("ordinal1"), F.col("name").alias("column1"))
    b = names.select(F.col("k").alias("_j"), F.col("ordinal").alias("ordinal2"), F.col("name").alias("column2"))
    every = F.broadcast(a).join(F.broadcast(b), F.col("_i") < F.col("_j"))
    out = ["ordinal1", "column1", "ordinal2", "column2", "correlation"]
    if not by:
        found = F.broadcast(found)
        return every.join(found, (F.col("i") == F.col("_i")) & (F.col("j") == F.col("_j")), "left").select(*out)
    return found.join(F.broadcast(every), (F.col("i") == F.col("_i")) & (F.col("j") == F.col("_j"))).select(*keys, *out)


def correlations(df: DataFrame, names: list[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Correlation of every pair of number columns, whole or per segment; empty for fewer than two.

    Per segment, pairs that are never both present have no row.
    """
    df = normalise(df)
    return _pairs(df, [(f, f.number) for f in number_fields(df, names) if f.name not in by], by)


def semantic_correlations(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same over semantically numeric columns, numbers held as text included."""
    from .types import look

    df = normalise(df)
    found = []
    for x in look(df):
        if x.numeric_value is not None and not x.formats and x.field.name not in by:
            found.append((x.field, x.numeric_value))
    return _pairs(df, found, by)


def high_correlations(pairs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs with |r| above the threshold."""
    return pairs.where(F.abs("correlation") > threshold).select("column1", "column2", "correlation")


def strong_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with |r| > 0.5, labelled, strongest first."""
    r = F.col("correlation")
    return (
        pairs.where(F.abs(r) > 0.5)
        .select(
            F.col("column1").alias("variable1"),
            F.col("column2").alias("variable2"),
            F.round(r.cast("decimal(30,8)"), 3).cast("double").alias("correlation"),
            F.when(F.abs(r) > 0.8, "Very Strong").otherwise("Strong").alias("strength"),
        )
        .orderBy(F.abs("correlation").desc(), "variable1", "variable2")
    )


def correlation_triangle(pairs: DataFrame) -> DataFrame:
    """Lower triangle of the matrix: the later column names the row."""
    return pairs.select(
        F.col("column2").alias("row"), F.col("column1").alias("column"), F.col("correlation").alias("correlation")
    )
