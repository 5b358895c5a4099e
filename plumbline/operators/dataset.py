"""Dataset-level analysis: size, duplicates, missing values, insights and recommendations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import col, exact_round, percent
from ..session import settle
from .aggregate import by_column
from .columns import profile_columns, width
from .correlation import correlations, high_correlations, semantic_correlations
from .schema import fields, normalise, number_fields
from .types import SEMANTIC_TYPES

MEGABYTE = 1048576.0


def table_metrics(df: DataFrame) -> DataFrame:
    """(n_rows, n_cols, missing_cells, size_mb) in one scan."""
    df = normalise(df)
    cols = fields(df)
    n = F.count(F.lit(1))
    present = sum((F.count(f.value) for f in cols), F.lit(0))
    return df.agg(
        n.alias("n_rows"),
        F.lit(len(cols)).cast("bigint").alias("n_cols"),
        (n * len(cols) - present).alias("missing_cells"),
        (_size(df) / MEGABYTE).alias("size_mb"),
    )


def _size(df: DataFrame) -> Column:
    return sum((F.coalesce(F.sum(width(f)).cast("bigint"), F.lit(0)) for f in fields(df)), F.lit(0))


def logical_size_mb(df: DataFrame) -> DataFrame:
    """(size_mb): fixed width or UTF-8 bytes of all non-null values."""
    df = normalise(df)
    return df.agg((_size(df) / MEGABYTE).alias("size_mb"))


def fingerprint(df: DataFrame, names: Sequence[str] | None = None) -> list[Column]:
    """128 bits that identify a row's values, NULLs included.

    Grouping by it moves 16 bytes per row instead of the row. The null mask is
    hashed too, because hashes skip NULLs.
    """
    values = [f.value for f in fields(df) if names is None or f.name in names] or [F.lit(0)]
    nulls = [v.isNull() for v in values]
    return [
        F.xxhash64(*values, *nulls).alias("_h1"),
        F.xxhash64(F.lit("second"), *reversed(nulls), *reversed(values)).alias("_h2"),
    ]


def duplicate_rows(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_rows, duplicate_rows, duplicate_rows_pct): rows beyond the first of each identical row.

    Under ``by`` rows are compared on the remaining columns within their segment.
    """
    df = normalise(df)
    keys = [col(k) for k in by]
    rest = [f.name for f in fields(df) if f.name not in by]
    groups = df.select(*keys, *fingerprint(df, rest)).groupBy(*keys, "_h1", "_h2").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce(F.sum("n"), F.lit(0))
    extra = F.coalesce(F.sum(F.col("n") - 1), F.lit(0))
    return groups.groupBy(*keys).agg(
        n.alias("n_rows"), extra.alias("duplicate_rows"), percent(extra, n).alias("duplicate_rows_pct")
    )


def missing_by_column(df: DataFrame) -> DataFrame:
    """(name, missing_count, missing_pct) of columns with any missing value."""
    df = normalise(df)
    n = F.count(F.lit(1))
    out = by_column(
        df,
        fields(df),
        lambda f: {"missing_count": n - F.count(f.value), "missing_pct": percent(n - F.count(f.value), n)},
    )
    return out.where("missing_count > 0").drop("ordinal")


def missing_table(df: DataFrame) -> DataFrame:
    """The same for display: share rounded to two places, most missing first."""
    out = missing_by_column(df).withColumn("missing_pct", exact_round(F.col("missing_pct"), 2))
    return out.orderBy(F.desc("missing_count"), "name")


def completeness_overall(df: DataFrame) -> DataFrame:
    """(missing_cells, completeness_pct, missing_pct) over all cells; an empty table is complete."""
    m = table_metrics(df)
    share = percent(F.col("missing_cells"), F.col("n_rows") * F.col("n_cols"))
    return m.select("missing_cells", (100 - share).alias("completeness_pct"), share.alias("missing_pct"))


def outlier_table(df: DataFrame) -> DataFrame:
    """(name, outliers_count, outliers_pct): number columns with outliers, share of all rows, most first."""
    from .columns import iqr_outliers

    out = iqr_outliers(df).where("outliers_count > 0")
    share = exact_round(percent(F.col("outliers_count"), F.col("n_rows")), 2)
    return out.select("name", "outliers_count", share.alias("outliers_pct")).orderBy(F.desc("outliers_count"), "name")


def recommendations(df: DataFrame, columns: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(rule, columns): rules that fire and the columns that make them, by physical type.

    Drawn from the column profile and the correlations, which may be given.
    """
    df = normalise(df)
    strings = [f.name for f in fields(df) if f.kind == "string"]
    numbers = [f.name for f in number_fields(df)]
    columns = settle(profile_columns(df)) if columns is None else columns
    pairs = correlations(df) if pairs is None else pairs
    n = F.col("n_rows")
    ends = high_correlations(pairs, 0.8).select(F.explode(F.array("column1", "column2")).alias("name"))
    found = {
        "high_missing": columns.where(percent(n - F.col("non_null"), n) > 30),
        "high_correlation": ends,
        "outliers": columns.where(F.col("name").isin(numbers) & (F.col("outliers_count") > n * 0.05)),
        "high_cardinality": columns.where(F.col("name").isin(strings) & (F.col("n_unique") > n * 0.5)),
    }
    # One row per column name and rule: bounded by the schema.
    named = reduce(DataFrame.unionByName, (t.select(F.lit(r).alias("rule"), "name") for r, t in found.items()))
    return named.groupBy("rule").agg(F.array_sort(F.collect_set("name")).alias("columns"))


# -- relations over the column profile -----------------------------------------


def dataset_row(columns: DataFrame, duplicates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per dataset: shape, size, duplicates and columns per type."""
    types = [F.count_if(F.col("inferred_type") == t).alias(f"n_{t}") for t in SEMANTIC_TYPES]
    shape = columns.groupBy(*[col(k) for k in keys]).agg(
        F.max("n_rows").alias("n_rows"),
        F.count(F.lit(1)).alias("n_cols"),
        (F.sum("bytes") / MEGABYTE).alias("size_mb"),
        *types,
    )
    for k in keys:
        shape = shape.withColumnRenamed(k, f"_{k}")
    on = F.lit(True)
    for k in keys:
        on = on & col(k).eqNullSafe(col(f"_{k}"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    joined = duplicates.drop("n_rows").join(shape, on, "left")
    return joined.select(
        *[col(k) for k in keys],
        zero("n_rows").alias("n_rows"),
        zero("n_cols").alias("n_cols"),
        F.coalesce("size_mb", F.lit(0.0)).alias("size_mb"),
        "duplicate_rows_pct",
        *(zero(f"n_{t}").alias(f"n_{t}") for t in SEMANTIC_TYPES),
    )


@dataclass(frozen=True)
class Profile:
    """The profile relations; all share the ``dataset`` key."""

    dataset: DataFrame
    columns: DataFrame
    source: DataFrame
    by: tuple[str, ...] = ()

    @cached_property
    def correlations(self) -> DataFrame:
        """Pairs over the semantically numeric columns of each dataset; computed and settled at the first use."""
        pairs = semantic_correlations(self.source, self.by)
        named = pairs.withColumn("_d", F.concat_ws("/", *[F.coalesce(col(k).cast("string"), F.lit("null")) for k in self.by])) if self.by else pairs
        return settle(named.withColumnRenamed("_d", "dataset").drop(*self.by) if self.by else named)

    @property
    def missing(self) -> DataFrame:
        """(dataset, name, missing_count, missing_pct) of columns with missing values."""
        m = F.col("n_rows") - F.col("non_null")
        return self.columns.where(m > 0).select(
            "dataset", "name", m.alias("missing_count"), percent(m, F.col("n_rows")).alias("missing_pct")
        )

    @property
    def completeness(self) -> DataFrame:
        """(dataset, missing_cells, completeness_pct); 100 for an empty table."""
        m = F.sum(F.col("n_rows") - F.col("non_null"))
        per = self.columns.groupBy("dataset").agg(
            m.alias("missing_cells"), (100 - percent(m, F.sum("n_rows"))).alias("completeness_pct")
        )
        return self.dataset.select("dataset").join(per, "dataset", "left").select(
            "dataset",
            F.coalesce("missing_cells", F.lit(0)).alias("missing_cells"),
            F.coalesce("completeness_pct", F.lit(100.0)).alias("completeness_pct"),
        )

    @property
    def insights(self) -> DataFrame:
        return quality_insights(self.columns)

    @property
    def skewed(self) -> DataFrame:
        return skewed_columns(self.columns)

    @property
    def high_correlations(self) -> DataFrame:
        return high_correlations(self.correlations)


def quality_insights(columns: DataFrame) -> DataFrame:
    """One row per dataset: counts of troubled columns, names of likely IDs and of outlier columns."""
    missing = percent(F.col("n_rows") - F.col("non_null"), F.col("n_rows"))
    named = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("name"))))
    return columns.groupBy("dataset").agg(
        F.count_if(missing > 0).alias("columns_with_missing"),
        F.count_if(missing > 20).alias("columns_with_high_missing"),
        F.count_if(F.col("n_unique") == F.col("n_rows")).alias("columns_all_unique"),
        named(F.array_contains("quality_issues", "likely_id")).alias("potential_id_columns"),
        named(F.col("outliers_pct") > 5).alias("columns_with_outliers"),
    )


def skewed_columns(columns: DataFrame) -> DataFrame:
    """(dataset, name, skewness, interpretation) of numeric columns with |skewness| > 1."""
    s = F.abs("skewness")
    return columns.where(s > 1).select(
        "dataset",
        "name",
        "skewness",
        F.when(s > 2, "highly skewed").otherwise("moderately skewed").alias("interpretation"),
    )


def profile(df: DataFrame, dataset: str = "data", by: Sequence[str] = ()) -> Profile:
    """Profile a table, or each of its segments as a dataset of its own.

    The column profile, a few rows per dataset, is checkpointed once: reports and
    checks read it many times.
    """
    label = F.concat_ws("/", *[F.coalesce(col(k).cast("string"), F.lit("null")) for k in by]) if by else F.lit(dataset)
    columns = settle(profile_columns(df, by))
    row = settle(dataset_row(columns, duplicate_rows(df, by), by))
    name = lambda t: t.withColumn("dataset", label).drop(*by)
    return Profile(name(row), name(columns), df, tuple(by))


def dataset_profile(df: DataFrame, dataset: str = "data") -> DataFrame:
    """The dataset row alone."""
    cols = profile_columns(df)
    return dataset_row(cols, duplicate_rows(df), ()).withColumn("dataset", F.lit(dataset))
