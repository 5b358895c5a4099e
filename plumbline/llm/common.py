"""Column helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.values import col

WORD_GAP = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Runs of characters other than space and the five ASCII line and tab controls; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where the frame already has such a column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def row_key(df: DataFrame) -> tuple[Column, Column]:
    """128 bits from all columns, nulls told apart by their place: equal for rows that are equal."""
    cols = [col(c) for c in df.columns]
    gaps = [F.isnull(c) for c in cols]
    return F.xxhash64(F.lit(1), *gaps, *cols), F.xxhash64(F.lit(2), *gaps, *cols)


def held_out(key: Column) -> Column:
    """True where crc32 of the key as text leaves 2 when divided by 4; a null key is never held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def running_total(df: DataFrame, group: str, cell: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over all earlier rows of the group, without a task that sees a whole group.

    ``cell`` numbers slices of the group that follow the order: a row of a lower
    cell precedes every row of a higher one. Only the sums of cells meet per group.
    """
    t = fresh(df, "cell_total")[0]
    sums = df.groupBy(group, cell).agg(F.sum(value).alias(t))
    before = Window.partitionBy(group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col(group).alias("g_"), F.col(cell).alias("c_"), F.coalesce(F.sum(t).over(before), F.lit(0)).alias("offset_")
    )
    inside = Window.partitionBy(group, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    # Both sides are dealt by group and cell already.
    joined = local.join(offsets.hint("merge"), (F.col(group) == F.col("g_")) & (F.col(cell) == F.col("c_")))
    return joined.withColumn(out, F.col(out) + F.col("offset_")).drop("g_", "c_", "offset_")
