"""Exact global ranks without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settle

# Rows per slice of a range-partitioned table.
ROWS_PER_SLICE = 250_000


def sliced(df: DataFrame, order: Sequence[Column], slices: int) -> DataFrame:
    """Range partition by ``order`` and record the slice number, frozen by a checkpoint.

    Slice borders come from sampling. Without the checkpoint a lost executor
    could redraw them between two reads and shift ranks. One slice has no borders.
    """
    if slices <= 1:
        return df.withColumn("slice", F.lit(0))
    return settle(df.repartitionByRange(max(1, slices), *order).withColumn("slice", F.spark_partition_id()))


def global_rank(df: DataFrame, order: Sequence[Column], slices: int) -> DataFrame:
    """Add ``rank`` (1..n by ``order``, which must be unique): rank within the slice plus rows before it."""
    parts = sliced(df, order, slices)
    sizes = parts.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    # One row per slice.
    offsets = sizes.select("slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"))
    inside = F.row_number().over(W.partitionBy("slice").orderBy(*order))
    return (
        parts.withColumn("rank", inside)
        .join(offsets, "slice")
        .withColumn("rank", F.col("rank") + F.col("rows_before"))
        .drop("slice", "rows_before")
    )
