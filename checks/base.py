"""Registry, inputs derived from the given tables, and result shaping."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.values import col

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return plain(fn(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def plain(df: DataFrame, places: int = 4) -> DataFrame:
    """Integers as bigint, doubles rounded, lists as text: types that compare across engines."""
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, T.IntegralType):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.FractionalType):
            # Adding zero turns -0.0 into 0.0.
            c = F.round(c.cast("double"), places) + F.lit(0.0)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = F.array_join(c, ",")
        out.append(c.alias(f.name))
    return df.select(*out)


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: under the cluster's checkpoint folder, private only in local mode."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return f"{shared.rstrip('/')}/scratch-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.mkdtemp(prefix="plumbline-"), "data")


# Inputs as SQL that both engines read alike: kind per column, then the query.
SOURCES: dict[str, tuple[dict[str, str], str]] = {
    "lineitem": (
        {
            "l_orderkey": "number", "l_partkey": "number", "l_suppkey": "number", "l_linenumber": "number",
            "l_quantity": "number", "l_extendedprice": "number", "l_discount": "number", "l_tax": "number",
            "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "time",
        },
        "SELECT * FROM lineitem",
    ),
    "orders": (
        {
            "o_orderkey": "number", "o_custkey": "number", "o_orderstatus": "string",
            "o_totalprice": "number", "o_orderdate": "time", "o_orderpriority": "string",
        },
        "SELECT * FROM orders",
    ),
    "events": (
        {"event_id": "number", "ts": "time", "user_id": "number", "event_type": "string", "value": "number", "props": "string"},
        "SELECT * FROM events",
    ),
    "documents": (
        {"doc_id": "number", "text": "string", "lang": "string", "source": "string", "n_chars": "number"},
        "SELECT * FROM documents",
    ),
    # Labels cover some documents only: two columns with missing values.
    "labelled": (
        {
            "doc_id": "number", "text": "string", "lang": "string", "source": "string",
            "n_chars": "number", "quality": "number", "toxic": "number",
        },
        "SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic"
        " FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    ),
    # The same with a column that repeats another: one pair correlates fully.
    "measured": (
        {
            "doc_id": "number", "text": "string", "lang": "string", "source": "string",
            "n_chars": "number", "quality": "number", "toxic": "number", "len": "number",
        },
        "SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic, length(d.text) AS len"
        " FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    ),
    # Every flag fires on some column here.
    "troubled": (
        {
            "doc_id": "number", "lang": "string", "n_chars": "number", "quality": "number", "empty_text": "string",
            "squared": "number", "group_name": "string", "len": "number", "no_number": "string", "is_long": "bool",
        },
        "SELECT d.doc_id, d.lang, d.n_chars, l.quality,"
        " CASE WHEN d.doc_id % 5 < 3 THEN '' ELSE d.text END AS empty_text,"
        " d.n_chars * d.n_chars AS squared, concat('u', CAST(d.doc_id % 150 AS VARCHAR(20))) AS group_name,"
        " length(d.text) AS len, CASE WHEN d.doc_id < 0 THEN d.lang END AS no_number,"
        " CASE WHEN d.doc_id % 7 > 0 THEN d.n_chars > 1000 END AS is_long"
        " FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    ),
    # All columns as text: types must come from the values.
    "orders_text": (
        {
            "o_orderkey": "string", "o_custkey": "string", "o_orderstatus": "string",
            "o_totalprice": "string", "o_orderdate": "string", "o_orderpriority": "string",
        },
        "SELECT CAST(o_orderkey AS VARCHAR(20)) AS o_orderkey, CAST(o_custkey AS VARCHAR(20)) AS o_custkey,"
        " o_orderstatus, CAST(o_totalprice AS VARCHAR(20)) AS o_totalprice,"
        " CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)) AS o_orderdate, o_orderpriority FROM orders",
    ),
    # A date layout per column.
    "orders_dates": (
        {"zoned": "string", "fraction": "string", "minutes": "string", "slashes": "string", "month": "string", "named": "string", "mixed": "string"},
        "SELECT concat(d, 'T10:20:30+02:00') AS zoned, concat(d, 'T10:20:30.125') AS fraction, concat(d, ' 10:05') AS minutes,"
        " concat(CAST(CAST(substr(d, 6, 2) AS INT) AS VARCHAR(2)), '/', CAST(CAST(substr(d, 9, 2) AS INT) AS VARCHAR(2)), '/', substr(d, 1, 4)) AS slashes,"
        " substr(d, 1, 7) AS month, concat(substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(substr(d, 6, 2) AS INT) * 3 - 2, 3), ' ',"
        " substr(d, 9, 2), ', ', substr(d, 1, 4)) AS named, CASE WHEN o_orderkey % 2 = 0 THEN d ELSE concat(d, ' 10:05') END AS mixed"
        " FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)) AS d FROM orders) x",
    ),
    # Values that share more than their first 64 characters.
    "linked": (
        {"url": "string", "page": "string", "o_orderstatus": "string"},
        f"SELECT concat('https://example.org/{'x' * 60}/', CAST(o_orderkey AS VARCHAR(20))) AS url,"
        f" concat('{'y' * 300}', CAST(o_orderkey % 7 AS VARCHAR(20)), o_orderpriority) AS page, o_orderstatus FROM orders",
    ),
    "status_priority": (
        {"o_orderstatus": "string", "o_orderpriority": "string"},
        "SELECT o_orderstatus, o_orderpriority FROM orders",
    ),
    "signed": (
        {"event_id": "number", "shifted": "number", "zeroed": "number"},
        "SELECT event_id, value - 20 AS shifted, CASE WHEN event_id % 10 = 0 THEN 0 ELSE value END AS zeroed FROM events",
    ),
    "related": (
        {"l_quantity": "number", "l_discount": "number", "mixed": "number", "opposite": "number"},
        "SELECT l_quantity, l_discount, l_quantity + 530 * l_discount AS mixed, -l_quantity AS opposite FROM lineitem",
    ),
}


TABLES = ("lineitem", "orders", "events", "documents", "labels", "conversations")


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t}" in SOURCES[name][1]}
    sql = SOURCES[name][1]
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(sql, **tables)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
