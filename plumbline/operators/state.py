"""Column profiles as mergeable state: what has been profiled once is never read again when a table grows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import col, percent
from .aggregate import by_column
from .columns import FLAT, counts_of, elapsed_days, iso, merged_counts, read_counts
from .quantiles import SKETCH_K
from .schema import Field, fields, normalise
from .types import Facts, look, physical_type, string_type

# Sketch of distinct values: 2^12 registers, an error of about 1.6% (one standard deviation).
DISTINCT_LOG2 = 12

NUMBERS = ("n", "mean", "m2", "m3", "m4", "least", "most", "negative", "zeros", "quantiles")


def _numbers(x: Column | None) -> dict[str, Column]:
    """Moments around the mean, range, signs and a quantile sketch of the values as double."""
    none = F.lit(None).cast("double")
    if x is None:
        zero = F.lit(0).cast("bigint")
        sketch = F.lit(None).cast("binary")
        return {"n": zero, **dict.fromkeys(("mean", "m2", "m3", "m4", "least", "most"), none), "negative": zero, "zeros": zero, "quantiles": sketch}
    n = F.count(x)
    m2 = F.var_pop(x) * n
    # A constant has no skewness: its moments are zero.
    m3 = F.when(m2 > 0, F.skewness(x) * F.pow(m2, F.lit(1.5)) / F.sqrt(n.cast("double"))).when(n > 0, 0.0)
    m4 = F.when(m2 > 0, (F.kurtosis(x) + 3) * m2 * m2 / n).when(n > 0, 0.0)
    return {
        "n": n, "mean": F.avg(x), "m2": m2, "m3": m3, "m4": m4, "least": F.min(x), "most": F.max(x),
        "negative": F.count_if(x < 0), "zeros": F.count_if(x == 0),
        "quantiles": F.when(n > 0, F.kll_sketch_agg_double(x, F.lit(SKETCH_K))),
    }


def _distinct(x: Facts) -> Column:
    """Sketch of the distinct values. Equal values give equal sketches in every part: integers as such, others by text."""
    v = x.field.value
    return F.hll_sketch_agg(v.cast("bigint") if x.field.kind == "integral" else v.cast("string"), F.lit(DISTINCT_LOG2))


def profile_state(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per column (and segment, file, day ..): counts, date ranges, moments and sketches, all of which can be merged.

    One scan besides the facts; nothing is sorted and no value leaves its task. A state takes some 30 KB and can be kept as Parquet: a table that
    grows needs the state of its new part only. ``ordinal`` and ``name`` tell the column; parts must have the same columns.
    """
    df = normalise(df)
    facts = {x.field.name: x for x in look(df, by, partial=True)}

    def build(f: Field) -> dict[str, Column]:
        x = facts[f.name]
        kind = physical_type(f) or ("text" if f.kind == "nested" else "string")
        return {"kind": F.lit(kind), **counts_of(x), "distinct": _distinct(x), **_numbers(x.numeric_value)}

    rows = by_column(df, [f for f in fields(df) if f.name in facts], build, by)
    # A table without rows has one row per column that says so; segments always have rows.
    return rows.where("n_rows > 0")


def merge_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The states of equal ``by`` and column as one: of files as that of the table, of segments as that of the whole.

    Counts and sketches add up. Moments are merged around the common mean, so that large means cost no digits.
    """
    names = [*by, "ordinal", "name", "kind"]
    keys = [col(k) for k in names]
    n = F.col("n")
    extra = [
        F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
        F.sum("n").alias("n"), F.sum("negative").alias("negative"), F.sum("zeros").alias("zeros"),
        F.min("least").alias("least"), F.max("most").alias("most"),
        F.try_divide(F.sum(F.col("mean") * n), F.sum(n)).alias("mean"),
    ]
    merged = merged_counts(states, names, extra)
    merged = merged.withColumn("quantiles", F.when(n > 0, F.col("quantiles")))
    around = merged.select(*(col(k).alias(f"_{k}") for k in names), F.col("mean").alias("_mean"))
    same = F.lit(True)
    for k in names:
        same = same & col(k).eqNullSafe(col(f"_{k}"))
    m2, m3, m4 = F.col("m2"), F.col("m3"), F.col("m4")
    d = F.col("mean") - F.col("_mean")
    moved = states.where("n > 0").join(around, same).groupBy(*(col(f"_{k}") for k in names)).agg(
        F.sum(m2 + n * d * d).alias("m2"),
        F.sum(m3 + 3 * d * m2 + n * d * d * d).alias("m3"),
        F.sum(m4 + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d).alias("m4"),
    )
    out = merged.join(moved, same, "left").drop(*[f"_{k}" for k in names])
    return out.select(*[c for c in states.columns if c in out.columns])


def read_state(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The column profile that a state gives: exact but for n_unique and the quartiles, without lists of values.

    n_unique is off by about 1.6% (one standard deviation), quartiles by 0.4% of the ranks; what hangs on them, as the type of
    a string column near the borders of categorical, may be off too.
    """
    first = read_counts(states.withColumnRenamed("n", "n_numbers"))
    n = F.col("non_null")
    first = first.withColumn("n_unique", F.hll_sketch_estimate("distinct"))
    by_values = string_type(n, F.col("n_numeric"), F.col("n_dates"), F.col("n_unique"))
    first = first.withColumn("inferred_type", F.when(F.col("kind") == "string", by_values).otherwise(F.col("kind")))
    kind = F.col("inferred_type")
    numeric = lambda e: F.when(kind == "numeric", e)
    number = lambda e: numeric(F.coalesce(e, F.lit(0.0)))
    share = lambda c: numeric(percent(F.col(c), n))
    w, m2, m3, m4 = F.col("n_numbers").cast("double"), F.col("m2"), F.col("m3"), F.col("m4")
    flat = m2 < FLAT
    skewed = F.try_divide(w * F.sqrt(w - 1) * m3, (w - 2) * m2 * F.sqrt(m2))
    peaked = F.try_divide(w * (w + 1) * (w - 1) * m4, (w - 2) * (w - 3) * m2 * m2) - F.try_divide(3 * (w - 1) * (w - 1), (w - 2) * (w - 3))
    quartiles = F.when(F.col("n_numbers") > 0, F.kll_sketch_get_quantile_double("quantiles", F.array(*map(F.lit, (0.25, 0.5, 0.75)))))
    dated = (kind == "datetime") & (n > 0)
    texts = (kind == "text") & (n > 0)
    return first.withColumn("_q", quartiles).select(
        *[col(k) for k in by],
        "ordinal", "name", "inferred_type", "n_rows", "non_null", percent(n, F.col("n_rows")).alias("non_null_pct"), "n_unique",
        number(F.col("mean")).alias("mean"),
        numeric(F.when(n == 0, 0.0).otherwise(F.when(w > 1, F.sqrt(F.try_divide(m2, w - 1))))).alias("std"),
        number(F.col("least")).alias("min"), number(F.col("most")).alias("max"),
        *(number(F.get("_q", F.lit(i))).alias(c) for i, c in enumerate(("q1", "median", "q3"))),
        numeric(F.col("negative")).alias("negative_count"), share("negative").alias("negative_pct"),
        numeric(F.col("zeros")).alias("zeros_count"), share("zeros").alias("zeros_pct"),
        number(F.when((w < 3) | flat, 0.0).otherwise(skewed)).alias("skewness"),
        number(F.when((w < 4) | flat, 0.0).otherwise(peaked)).alias("kurtosis"),
        F.when(dated, iso(F.col("first"))).alias("min_date"), F.when(dated, iso(F.col("last"))).alias("max_date"),
        F.when(dated, elapsed_days(F.col("first"), F.col("last"))).alias("coverage_days"),
        F.when(texts, F.col("avg_length")).alias("avg_length"),
        F.when(texts, percent(F.col("empty_count"), n)).alias("pct_empty"),
        "bytes",
    )
