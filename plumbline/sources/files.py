"""CSV and Parquet tables in, Markdown reports out."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import to_numeric
from ..functions.values import col, strip
from ..operators.aggregate import one_row

# Texts that stand for a missing value in a CSV file.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

WHOLE = r"^[+-]?\d{1,18}\z"
TRUTH = ("True", "TRUE", "true", "False", "FALSE", "false")


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    null_tokens: Sequence[str] = NULL_TOKENS,
    infer: bool = True,
    multi_line: bool = False,
) -> DataFrame:
    """A CSV table with header; null tokens are missing values; columns of numbers or booleans get their type.

    Values are read as text first: the reader's own inference knows one null
    token only and would leave a column with 'NA' in it as text.

    A large file is split among tasks at line feeds. ``multi_line=True`` allows line
    feeds inside quotes; each file is then read by one task, so give many files.
    """
    paths = [path] if isinstance(path, str) else list(path)
    raw = spark.read.csv(paths, header=True, inferSchema=False, multiLine=multi_line, escape='"', quote='"', nullValue="")
    raw = raw.select(*(F.when(~col(c).isin(*null_tokens), col(c)).alias(c) for c in raw.columns))
    if not infer or not raw.columns:
        return raw
    aggs = []
    for i, c in enumerate(raw.columns):
        x = col(c)
        aggs += [
            F.count(x).alias(f"{i}_n"),
            F.count_if(strip(x).rlike(WHOLE)).alias(f"{i}_whole"),
            F.count(to_numeric(x)).alias(f"{i}_number"),
            F.count_if(x.isin(*TRUTH)).alias(f"{i}_truth"),
        ]
    got = one_row(raw, aggs)
    out = []
    for i, c in enumerate(raw.columns):
        n = got[f"{i}_n"]
        full = lambda k: n > 0 and got[f"{i}_{k}"] == n  # noqa: B023, E731
        x = col(c)
        if full("whole"):
            x = strip(x).try_cast("bigint")
        elif full("number") or n == 0:
            x = to_numeric(x)
        elif full("truth"):
            x = F.lower(x).try_cast("boolean")
        out.append(x.alias(c))
    return raw.select(*out)


def read_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def report_path(source: str) -> str:
    """Where the report of a source file goes by default: ``<stem>_report.md``."""
    return f"{PurePosixPath(source).stem}_report.md"


def write_report(reports: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write (dataset, markdown) as text, one folder per dataset; folders of other datasets stay as they are."""
    out = reports.select("dataset", F.col("markdown").alias("value")).write.mode(mode)
    out.option("partitionOverwriteMode", "dynamic").partitionBy("dataset").text(path)
