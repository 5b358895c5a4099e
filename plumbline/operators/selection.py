"""Row and column selection, previews and headline tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import col
from .frequency import frequencies
from .columns import _attach
from .aggregate import by_column
from .schema import fields, normalise
from .types import look

PREFIX = 4


def select_columns(df: DataFrame, names: Sequence[str] | str) -> DataFrame:
    """Project to ``names`` (a list or a comma-separated text); all unknown names are reported at once."""
    wanted = [n.strip() for n in names.split(",")] if isinstance(names, str) else list(names)
    missing = [n for n in wanted if n not in df.columns]
    if missing:
        raise ValueError(f"Columns not found: {', '.join(missing)}")
    return df.select(*[col(n) for n in wanted])


def sample_rows(df: DataFrame, n: int, key: str | Sequence[str], seed: int = 42) -> DataFrame:
    """At most n rows, picked at random but repeatably: those with the smallest md5 of seed and unique key.

    The cut is found over keys alone: counts of hash prefixes name the prefix in
    which the n-th row falls, and only that prefix's keys are ranked. Rows are then
    filtered by the cut and never moved.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    keys = [col(k) for k in ([key] if isinstance(key, str) else key)]
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))
    place = F.struct(h.alias("h"), *(k.alias(f"k{i}") for i, k in enumerate(keys)))
    tagged = df.select(place.alias("place"), F.left(h, F.lit(PREFIX)).alias("p"))
    sizes = tagged.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    # One row per prefix, 16 ** PREFIX at most.
    upto = F.sum("n").over(W.orderBy("p"))
    cut = sizes.select("p", (upto - F.col("n")).alias("before"), upto.alias("upto"))
    edge = cut.where(F.col("upto") >= n).agg(F.min(F.struct("p", "before")).alias("e")).scalar()
    rank = F.row_number().over(W.partitionBy("p").orderBy("place"))
    inside = tagged.where(F.col("p") == edge["p"]).withColumn("r", rank)
    last = inside.where(F.col("r") == F.lit(n) - edge["before"]).agg(F.min("place").alias("place")).scalar()
    return df.where(F.coalesce(place <= last, F.lit(True)))


def preview(df: DataFrame, n: int = 10, order_by: str | Sequence[str] = ()) -> DataFrame:
    """First n rows by a key: rows have no order of their own."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    if not keys:
        raise ValueError("preview needs an order key")
    if n < 1:
        raise ValueError("n must be at least 1")
    return df.orderBy(*[col(k) for k in keys]).limit(n)


def column_info(df: DataFrame) -> DataFrame:
    """(ordinal, name, dtype, non_null, null_count, n_unique)."""
    dtypes = {f.ordinal: f.dtype for f in fields(df)}
    df = normalise(df)
    facts = look(df)
    n = F.count(F.lit(1))
    base = by_column(
        df, fields(df), lambda f: {"non_null": F.count(f.value), "null_count": n - F.count(f.value)}
    )
    distinct = frequencies(df, facts).groupBy("ordinal").agg(F.count(F.lit(1)).alias("n_unique"))
    names = F.create_map(*[F.lit(x) for k, t in dtypes.items() for x in (k, t)])
    return _attach(base, distinct, ()).select(
        "ordinal",
        "name",
        names[F.col("ordinal")].alias("dtype"),
        "non_null",
        "null_count",
        F.coalesce("n_unique", F.lit(0)).alias("n_unique"),
    )
