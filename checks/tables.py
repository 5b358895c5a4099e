"""Queries over tables: sources, selection, types, column statistics, dataset analysis, distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.coerce import to_datetime, to_numeric
from plumbline.operators import columns as C
from plumbline.operators import correlation as R
from plumbline.operators import dataset as D
from plumbline.operators import distribution as E
from plumbline.operators import frequency as Q
from plumbline.operators import selection as S
from plumbline.operators import types as T
from plumbline.operators.state import merge_states, profile_state, read_state
from plumbline.sources.files import read_csv, read_parquet

from .base import SOURCES, register, scratch, source, table
from .profile_sql import (
    COLUMNS,
    DATES,
    big,
    columns_sql,
    date,
    isoformat,
    num,
    per_column,
    pick,
    rnd,
    value_rows,
    with_columns,
)

ALL = ("number", "string", "time", "bool")


def src(name: str) -> str:
    return f"WITH src AS ({SOURCES[name][1]}) "


# -- A: sources, sinks, selection ----------------------------------------------

TOKENS = ("NA", "n/a", "#N/A", "null", "NaN", "None", "<NA>", "")


@register(
    "a1_read_csv",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS priority,"
    f" CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE {rnd('o_totalprice')} END AS totalprice,"
    " 'say \"' || o_orderstatus || '\", twice' AS quoted, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS orderdate,"
    " o_orderkey % 2 = 0 AS even FROM orders",
)
def a1_read_csv(spark, sf_dir):
    """Write orders as CSV with null tokens in every flavour and quoted text, and read it back."""
    o = table(spark, sf_dir, "orders")
    token = F.get(F.array(*map(F.lit, TOKENS)), (F.col("o_orderkey") % len(TOKENS)).cast("int"))
    out = o.select(
        F.col("o_orderkey").cast("string"),
        F.when(F.col("o_orderkey") % 5 == 0, token).otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(F.col("o_orderkey") % 7 == 0, token).otherwise(F.col("o_totalprice").cast("string")).alias("totalprice"),
        F.concat(F.lit('say "'), "o_orderstatus", F.lit('", twice')).alias("quoted"),
        F.col("o_orderdate").cast("date").cast("string").alias("orderdate"),
        F.when(F.col("o_orderkey") % 2 == 0, "True").otherwise("False").alias("even"),
    )
    path = scratch(spark)
    out.write.csv(path, header=True, escape='"')
    return read_csv(spark, path)


@register("a2_table_input", f"SELECT {big('count(*)')} AS n_rows, {big('count(DISTINCT l_orderkey)')} AS n_orders FROM lineitem")
def a2_table_input(spark, sf_dir):
    df = read_parquet(spark, f"{sf_dir}/lineitem.parquet")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("l_orderkey").alias("n_orders"))


@register(
    "a1_read_csv_multiline",
    "SELECT o_orderkey, 'first line' || chr(10) || '\"' || o_orderstatus || '\", second; ' || o_orderpriority || chr(10) || 'end' AS note FROM orders",
)
def a1_read_csv_multiline(spark, sf_dir):
    """Line feeds and quotes inside quoted fields."""
    o = table(spark, sf_dir, "orders")
    note = F.concat(F.lit('first line\n"'), "o_orderstatus", F.lit('", second; '), "o_orderpriority", F.lit("\nend"))
    path = scratch(spark)
    o.select("o_orderkey", note.alias("note")).write.csv(path, header=True, escape='"')
    return read_csv(spark, path, multi_line=True)


@register("a2_table_profile", columns_sql("lineitem", pick("name", "inferred_type", "n_rows", "non_null", "n_unique")))
def a2_table_profile(spark, sf_dir):
    p = D.profile(read_parquet(spark, f"{sf_dir}/lineitem.parquet"), "lineitem")
    return p.columns.select("name", "inferred_type", "n_rows", "non_null", "n_unique")


@register("a3_select_columns", f"SELECT o_orderkey, {rnd('o_totalprice')} AS o_totalprice FROM orders")
def a3_select_columns(spark, sf_dir):
    return S.select_columns(table(spark, sf_dir, "orders"), "o_orderkey, o_totalprice")


SAMPLE = "SELECT o_orderkey FROM orders ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT {n}"


@register("a4_sample_rows", SAMPLE.format(n=500))
def a4_sample_rows(spark, sf_dir):
    return S.sample_rows(table(spark, sf_dir, "orders"), 500, "o_orderkey").select("o_orderkey")


@register("a4_sample_rows_large", SAMPLE.format(n=5000))
def a4_sample_rows_large(spark, sf_dir):
    return S.sample_rows(table(spark, sf_dir, "orders"), 5000, "o_orderkey").select("o_orderkey")


@register("a5_preview", f"SELECT event_id, user_id, event_type, {rnd('value')} AS value FROM events ORDER BY event_id LIMIT 10")
def a5_preview(spark, sf_dir):
    return S.preview(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), 10, "event_id")


PREVIEW = "SELECT event_id, user_id, event_type, {value} FROM events ORDER BY event_id LIMIT {n}"


@register("a5_preview_short", PREVIEW.format(value=rnd("value") + " AS value", n=3))
def a5_preview_short(spark, sf_dir):
    return S.preview(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), 3, "event_id")


@register("a5_preview_long", PREVIEW.format(value=rnd("value") + " AS value", n=2000))
def a5_preview_long(spark, sf_dir):
    return S.preview(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), 2000, "event_id")


DTYPES = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint", "quality": "int", "toxic": "int"}
CASE_DTYPE = "CASE name " + " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in DTYPES.items()) + " END"


@register(
    "a7_column_info",
    f"SELECT *, {CASE_DTYPE} AS dtype FROM ("
    + per_column("labelled", ALL, "count({c}) AS non_null, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS n_unique")
    + ")",
)
def a7_column_info(spark, sf_dir):
    return S.column_info(source(spark, sf_dir, "labelled"))


WIDTHS = {"doc_id": 8, "n_chars": 8, "quality": 4, "toxic": 4}
SIZE_MB = (
    "("
    + " + ".join(f"{w} * count({c})" for c, w in WIDTHS.items())
    + " + "
    + " + ".join(f"sum(strlen({c}))" for c in ("text", "lang", "source"))
    + ") / 1048576.0"
)
MISSING_CELLS = "count(*) * 7 - " + " - ".join(f"count({c})" for c in DTYPES)


@register(
    "a8_table_metrics",
    src("labelled")
    + f"SELECT count(*) AS n_rows, {big('7')} AS n_cols, {big(MISSING_CELLS)} AS missing_cells, {rnd(SIZE_MB)} AS size_mb FROM src",
)
def a8_table_metrics(spark, sf_dir):
    return D.table_metrics(source(spark, sf_dir, "labelled"))


# -- B: types and coercion -----------------------------------------------------


@register("b1_infer_types", columns_sql("troubled", pick("ordinal", "name", "inferred_type")))
def b1_infer_types(spark, sf_dir):
    return T.infer_types(source(spark, sf_dir, "troubled"))


@register("b1_infer_types_text", columns_sql("orders_text", pick("ordinal", "name", "inferred_type")))
def b1_infer_types_text(spark, sf_dir):
    return T.infer_types(source(spark, sf_dir, "orders_text"))


@register("b1_infer_types_dates", columns_sql("orders_dates", pick("ordinal", "name", "inferred_type", "min_date", "max_date", "coverage_days")))
def b1_infer_types_dates(spark, sf_dir):
    """A column per date layout, and one that mixes two."""
    p = C.profile_columns(source(spark, sf_dir, "orders_dates"))
    return p.select("ordinal", "name", "inferred_type", "min_date", "max_date", "coverage_days")


# Number-like texts that engines disagree on when cast without a shape test.
SPOILERS = ("'1d'", "'1_000'", "'1,000'", "'.5'", "'5.'", "'1e3'", "'+7'", "'abc'", "''", "'0x1F'", "'--1'", "'NaN'")


def spoiled(price: str) -> str:
    branches = " ".join(f"WHEN o_orderkey % 20 = {i} THEN {s}" for i, s in enumerate(SPOILERS))
    return f"CASE {branches} WHEN o_orderkey % 20 = 13 THEN concat('  ', {price}, ' ') ELSE {price} END"


SPOILED = "SELECT o_orderkey, " + spoiled("CAST(o_totalprice AS VARCHAR(20))") + " AS raw FROM orders"


@register("b2_to_numeric", f"SELECT o_orderkey, {rnd(num('raw'))} AS value FROM ({SPOILED})")
def b2_to_numeric(spark, sf_dir):
    df = spark.sql(SPOILED.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    return df.select("o_orderkey", to_numeric(F.col("raw")).alias("value"))


MONTH_NO = "CAST(CAST(substr(d, 6, 2) AS INT) AS VARCHAR(2))"
DAY_NO = "CAST(CAST(substr(d, 9, 2) AS INT) AS VARCHAR(2))"
MONTH_NAME = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(substr(d, 6, 2) AS INT) * 3 - 2, 3)"
LAYOUTS = (
    "substr(d, 1, 10)",
    "concat(substr(d, 1, 10), ' 10:20:30.5')",
    "concat(substr(d, 1, 10), 'T23:59:59')",
    "concat(substr(d, 6, 2), '/', substr(d, 9, 2), '/', substr(d, 1, 4))",
    "replace(substr(d, 1, 10), '-', '/')",
    "replace(substr(d, 1, 10), '-', '')",
    "substr(d, 1, 4)",
    "concat(substr(d, 1, 8), '32')",
    "'899'",
    "'no date'",
    "concat(substr(d, 1, 10), 'T10:20:30.125')",
    "concat(substr(d, 1, 10), 'T10:20:30Z')",
    "concat(substr(d, 1, 10), 'T01:20:30.5+02:30')",
    "concat(substr(d, 1, 10), ' 10:05')",
    f"concat({MONTH_NO}, '/', {DAY_NO}, '/', substr(d, 1, 4))",
    "substr(d, 1, 7)",
    f"concat({MONTH_NAME}, ' ', {DAY_NO}, ', ', substr(d, 1, 4))",
    f"concat({DAY_NO}, '-', {MONTH_NAME}, '-', substr(d, 1, 4))",
    "concat('Smarch 3, ', substr(d, 1, 4))",
)
DATED = (
    "SELECT o_orderkey, CASE "
    + " ".join(f"WHEN o_orderkey % {len(LAYOUTS)} = {i} THEN {e}" for i, e in enumerate(LAYOUTS))
    + " END AS raw FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)) AS d FROM orders) x"
)
ANY_DATE = "coalesce(" + ", ".join(date("raw", i) for i in range(len(DATES))) + ")"


@register("b3_to_datetime", f"SELECT o_orderkey, {isoformat('ts')} AS value FROM (SELECT o_orderkey, {ANY_DATE} AS ts FROM ({DATED}))")
def b3_to_datetime(spark, sf_dir):
    df = spark.sql(DATED.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    return df.select("o_orderkey", C.iso(to_datetime(F.col("raw"))).alias("value"))


FOUR = "(VALUES ('numeric'), ('categorical'), ('datetime'), ('text')) t(inferred_type)"


@register(
    "b4_type_counts",
    f"{with_columns('orders_text')} SELECT t.inferred_type, count(cp.name) AS n_columns"
    f" FROM {FOUR} LEFT JOIN cp ON cp.inferred_type = t.inferred_type GROUP BY t.inferred_type",
)
def b4_type_counts(spark, sf_dir):
    return T.type_counts(T.infer_types(source(spark, sf_dir, "orders_text")))


@register("b5_type_summary", columns_sql("troubled", "inferred_type, count(*) AS n_columns", "TRUE GROUP BY inferred_type"))
def b5_type_summary(spark, sf_dir):
    return T.type_summary(T.infer_types(source(spark, sf_dir, "troubled")))


@register(
    "b6_split_by_dtype",
    "SELECT ordinal, column_name AS name, CASE WHEN column_type = 'VARCHAR' THEN 'categorical' ELSE 'numerical' END AS \"group\""
    " FROM (SELECT *, row_number() OVER () - 1 AS ordinal FROM (DESCRIBE SELECT * FROM orders)) WHERE column_type <> 'TIMESTAMP'",
)
def b6_split_by_dtype(spark, sf_dir):
    return T.split_by_dtype(table(spark, sf_dir, "orders"))


# -- C: column statistics ------------------------------------------------------


@register(
    "c1_completeness",
    per_column("labelled", ALL, f"count(*) AS n_rows, count({{c}}) AS non_null, {rnd('count({c}) * 100.0 / count(*)')} AS non_null_pct"),
)
def c1_completeness(spark, sf_dir):
    return C.completeness(source(spark, sf_dir, "labelled"))


@register("c2_n_unique", f"SELECT name, n_unique FROM ({per_column('lineitem', ALL, 'count(DISTINCT {c}) AS n_unique')})")
def c2_n_unique(spark, sf_dir):
    return Q.n_unique(source(spark, sf_dir, "lineitem"))


@register("c2_n_unique_approx", f"SELECT name, n_unique, TRUE AS close FROM ({per_column('lineitem', ALL, 'count(DISTINCT {c}) AS n_unique')})")
def c2_n_unique_approx(spark, sf_dir):
    """The sketch is within 15 % (three standard errors) of the exact count."""
    df = source(spark, sf_dir, "lineitem")
    rough = Q.n_unique(df, exact=False).withColumnRenamed("n_unique", "rough")
    close = F.abs(F.col("rough") - F.col("n_unique")) <= 0.15 * F.col("n_unique")
    return Q.n_unique(df).join(rough, "name").select("name", "n_unique", close.alias("close"))


@register(
    "c3_sample_values",
    value_rows("labelled", ("string",))
    + " SELECT name, rank, value FROM (SELECT name, value, row_number() OVER (PARTITION BY ordinal ORDER BY k2) AS rank FROM freq) WHERE rank <= 3",
)
def c3_sample_values(spark, sf_dir):
    return Q.sample_values(source(spark, sf_dir, "labelled"), 3, ["text", "lang", "source"])


NUMBERS = ("number",)
MOMENTS = ", ".join(f"{rnd(e)} AS {a}" for a, e in (("mean", "avg({c})"), ("std", "stddev_samp({c})"), ("min", "min({c})"), ("max", "max({c})")))


@register("c4_numeric_moments", per_column("lineitem", NUMBERS, MOMENTS))
def c4_numeric_moments(spark, sf_dir):
    return C.numeric_moments(source(spark, sf_dir, "lineitem"))


QUARTS = ", ".join(f"{rnd('quantile_cont(CAST({c} AS DOUBLE), ' + p + ')')} AS {a}" for a, p in (("q1", "0.25"), ("median", "0.5"), ("q3", "0.75")))


@register("c5_quartiles", f"SELECT name, q1, median, q3 FROM ({per_column('lineitem', NUMBERS, QUARTS)})")
def c5_quartiles(spark, sf_dir):
    return C.quartiles(source(spark, sf_dir, "lineitem"))


@register("c5_quartiles_approx", f"SELECT name, q1, median, q3, TRUE AS close FROM ({per_column('lineitem', NUMBERS, QUARTS)})")
def c5_quartiles_approx(spark, sf_dir):
    """The sketch is within 1 % of the range of the exact quartiles; it gives values, not points between whole numbers."""
    df = source(spark, sf_dir, "lineitem")
    rough = C.quartiles(df, exact=False).select("name", *(F.col(q).alias(f"_{q}") for q in ("q1", "median", "q3")))
    whole = [n for n, t in df.dtypes if t in ("int", "bigint")]
    allowed = 0.01 * (F.col("max") - F.col("min")) + F.when(F.col("name").isin(whole), 1.0).otherwise(0.0)
    near = lambda q: F.abs(F.col(q) - F.col(f"_{q}")) <= allowed
    joined = C.quartiles(df).join(rough, "name").join(C.numeric_moments(df).select("name", "min", "max"), "name")
    return joined.select("name", "q1", "median", "q3", (near("q1") & near("median") & near("q3")).alias("close"))


@register(
    "c6_iqr_outliers",
    columns_sql("labelled", pick("name", "n_rows", "non_null", "outliers_count", "outliers_pct"), "inferred_type = 'numeric'"),
)
def c6_iqr_outliers(spark, sf_dir):
    return C.iqr_outliers(source(spark, sf_dir, "labelled"))


SIGNS = (
    "count(*) FILTER ({c} < 0) AS negative_count, count(*) FILTER ({c} = 0) AS zeros_count, "
    + rnd("count(*) FILTER ({c} < 0) * 100.0 / count({c})") + " AS negative_pct, "
    + rnd("count(*) FILTER ({c} = 0) * 100.0 / count({c})") + " AS zeros_pct"
)


@register("c7_sign_counts", per_column("signed", NUMBERS, SIGNS))
def c7_sign_counts(spark, sf_dir):
    return C.sign_counts(source(spark, sf_dir, "signed"))


@register("c8_skewness", per_column("labelled", NUMBERS, rnd("skewness({c})") + " AS skewness"))
def c8_skewness(spark, sf_dir):
    return C.skewness(source(spark, sf_dir, "labelled"))


@register("c9_kurtosis", per_column("labelled", NUMBERS, rnd("kurtosis({c})") + " AS kurtosis"))
def c9_kurtosis(spark, sf_dir):
    return C.kurtosis(source(spark, sf_dir, "labelled"))


NUMERIC_BLOCK = (
    "name", "mean", "std", "min", "max", "q1", "median", "q3", "outliers_count", "outliers_pct", "negative_count",
    "negative_pct", "zeros_count", "zeros_pct", "skewness", "kurtosis",
)


@register("c10_no_numbers", columns_sql("troubled", pick(*NUMERIC_BLOCK), "name = 'no_number'"))
def c10_no_numbers(spark, sf_dir):
    """The numeric block of a column without any value: all zero."""
    return C.profile_columns(source(spark, sf_dir, "troubled")).where("name = 'no_number'").select(*NUMERIC_BLOCK)


TOP = (
    " SELECT name, rank, value, cnt AS count, {pct} AS frequency_pct FROM (SELECT *, sum(cnt) OVER (PARTITION BY ordinal) AS total,"
    " row_number() OVER (PARTITION BY ordinal ORDER BY cnt DESC, k0, value) AS rank FROM freq) WHERE rank <= 5"
).format(pct=rnd("cnt * 100.0 / total"))


@register("c11_top_values", value_rows("troubled", ("string", "number")).replace("CAST(squared AS VARCHAR)", "CAST(squared AS VARCHAR)") + TOP)
def c11_top_values(spark, sf_dir):
    names = [c for c, k in SOURCES["troubled"][0].items() if k in ("string", "number")]
    return Q.top_values(source(spark, sf_dir, "troubled"), 5, names)


@register("c11_top_values_prefix", value_rows("linked", ("string",)) + TOP)
def c11_top_values_prefix(spark, sf_dir):
    """Unique values that share 81 characters, and frequent ones that share 300."""
    return Q.top_values(source(spark, sf_dir, "linked"), 5)


@register(
    "c11_value_counts",
    "SELECT 'text' AS name, text AS value, count(*) AS cnt FROM documents WHERE text IS NOT NULL GROUP BY text"
    " UNION ALL SELECT 'lang', lang, count(*) FROM documents WHERE lang IS NOT NULL GROUP BY lang",
)
def c11_value_counts(spark, sf_dir):
    """Whole values, however long."""
    return Q.value_counts(table(spark, sf_dir, "documents"), ["text", "lang"])


@register("c12_rare_values", with_columns("troubled") + " SELECT name, rare AS rare_values FROM raw")
def c12_rare_values(spark, sf_dir):
    return Q.rare_values(source(spark, sf_dir, "troubled"))


DATES_SQL = (
    f"{isoformat('min({c})')} AS min_date, {isoformat('max({c})')} AS max_date,"
    f" {big('date_sub(' + chr(39) + 'day' + chr(39) + ', min({c}), max({c}))')} AS coverage_days"
)


@register("c13_datetime_stats", per_column("events", ("time",), DATES_SQL))
def c13_datetime_stats(spark, sf_dir):
    return C.datetime_stats(source(spark, sf_dir, "events"))


@register("c14_text_length", per_column("troubled", ("string",), rnd("avg(length({c}))") + " AS avg_length"))
def c14_text_length(spark, sf_dir):
    return C.text_length(source(spark, sf_dir, "troubled"))


@register(
    "c15_empty_rate",
    per_column("troubled", ("string",), rnd("coalesce(count(*) FILTER ({c} = '') * 100.0 / nullif(count({c}), 0), 0)") + " AS pct_empty"),
)
def c15_empty_rate(spark, sf_dir):
    return C.empty_rate(source(spark, sf_dir, "troubled"))


def _flag(no: int, flag: str) -> None:
    @register(f"c{no}_flag_{flag}", columns_sql("troubled", f"name, contains(',' || quality_issues || ',', ',{flag},') AS flagged"))
    def query(spark, sf_dir):
        p = C.profile_columns(source(spark, sf_dir, "troubled"))
        return p.select("name", F.array_contains("quality_issues", flag).alias("flagged"))


for _no, _name in enumerate(
    ("high_missing", "likely_id", "extreme_outliers", "skewed", "many_rare_categories", "mostly_empty"), 16
):
    _flag(_no, _name)


PROFILE = tuple(COLUMNS)


@register("c22_column_profile", columns_sql("troubled", pick(*PROFILE)))
def c22_column_profile(spark, sf_dir):
    return C.profile_columns(source(spark, sf_dir, "troubled")).select(*PROFILE)


@register("c22_column_profile_text", columns_sql("orders_text", pick(*PROFILE)))
def c22_column_profile_text(spark, sf_dir):
    return C.profile_columns(source(spark, sf_dir, "orders_text")).select(*PROFILE)


@register("c22_column_profile_lineitem", columns_sql("lineitem", pick(*PROFILE)))
def c22_column_profile_lineitem(spark, sf_dir):
    return C.profile_columns(source(spark, sf_dir, "lineitem")).select(*PROFILE)


@register(
    "c22_profile_top_values",
    value_rows("labelled", ("string",)) + TOP.replace("WHERE rank <= 5", "WHERE rank <= 5 AND name IN ('lang', 'source')"),
)
def c22_profile_top_values(spark, sf_dir):
    p = C.profile_columns(source(spark, sf_dir, "labelled")).where("inferred_type = 'categorical'")
    item = p.select("name", F.posexplode("top_values").alias("i", "t"))
    return item.select("name", (F.col("i") + 1).alias("rank"), "t.*")


@register(
    "c22_profile_nested",
    "SELECT 'vec_id' AS name, 'numeric' AS inferred_type, count(DISTINCT vec_id) AS n_unique, count(vec_id) AS non_null FROM embeddings"
    " UNION ALL SELECT 'embedding', 'text', count(DISTINCT embedding), count(embedding) FROM embeddings"
    " UNION ALL SELECT 'label', 'numeric', count(DISTINCT label), count(label) FROM embeddings",
)
def c22_profile_nested(spark, sf_dir):
    """Arrays are profiled as JSON text."""
    return C.profile_columns(table(spark, sf_dir, "embeddings")).select("name", "inferred_type", "n_unique", "non_null")


# Single precision, with an infinity.
SINGLE = "SELECT CASE WHEN l_linenumber = 1 AND l_orderkey % 50 = 1 THEN CAST('infinity' AS FLOAT) ELSE CAST(l_quantity AS FLOAT) END AS q FROM lineitem"


@register("c22_profile_single", f"SELECT 'numeric' AS inferred_type, min(q)::DOUBLE AS min, max(q)::DOUBLE AS max, count(DISTINCT q) AS n_unique FROM ({SINGLE})")
def c22_profile_single(spark, sf_dir):
    df = spark.sql(SINGLE.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))
    return C.profile_columns(df).select("inferred_type", "min", "max", "n_unique")


#: What a merged state gives exactly.
STATE = tuple(c for c in PROFILE if c not in ("ordinal", "n_unique", "q1", "median", "q3", "outliers_count", "outliers_pct", "rare_values", "quality_issues"))


def _merged_state(spark, sf_dir, name, part):
    """A table profiled in four parts, each by itself; the states merged, and how far estimates are off."""
    df = source(spark, sf_dir, name)
    p = merge_states(profile_state(df.withColumn("_part", part), ["_part"]))
    p = read_state(p)
    exact = Q.n_unique(df).select("name", F.col("n_unique").alias("n_exact"))
    close = F.abs(F.col("n_unique") - F.col("n_exact")) <= F.greatest(F.lit(1.0), 0.06 * F.col("n_exact"))
    return p.join(exact, "name").withColumn("distinct_close", close)


@register("c22_profile_state", columns_sql("lineitem", pick(*STATE) + ", TRUE AS distinct_close"))
def c22_profile_state(spark, sf_dir):
    return _merged_state(spark, sf_dir, "lineitem", F.col("l_orderkey") % 4).select(*STATE, "distinct_close")


@register("c22_profile_state_text", columns_sql("orders_text", pick(*STATE) + ", TRUE AS distinct_close"))
def c22_profile_state_text(spark, sf_dir):
    """Types, numbers and dates come from text; the parts lie apart in time."""
    return _merged_state(spark, sf_dir, "orders_text", F.left("o_orderdate", F.lit(4))).select(*STATE, "distinct_close")


@register("c22_profile_state_quartiles", per_column("lineitem", NUMBERS, "count({c}) > 0 AS q1_close, count({c}) > 0 AS median_close, count({c}) > 0 AS q3_close"))
def c22_profile_state_quartiles(spark, sf_dir):
    """Quartiles of the merged state lie within 1% of the wanted ranks."""
    df = source(spark, sf_dir, "lineitem")
    p = read_state(merge_states(profile_state(df.withColumn("_part", F.col("l_suppkey") % 5), ["_part"])))
    q = {r["name"]: r for r in p.where("inferred_type = 'numeric'").select("ordinal", "name", "q1", "median", "q3").collect()}
    share = lambda c, x: (F.avg((F.col(c) < x).cast("double")), F.avg((F.col(c) <= x).cast("double")))
    cells = []
    for r in q.values():
        near = []
        for n, at in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            below, upto = share(r["name"], F.lit(r[n]))
            near.append(((below - 0.01 <= at) & (upto + 0.01 >= at)).alias(f"{n}_close"))
        cells.append(F.struct(F.lit(r["ordinal"]).alias("ordinal"), F.lit(r["name"]).alias("name"), *near))
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))


DESCRIBED = (
    ("count", "CAST(count({c}) AS DOUBLE)"), ("mean", "avg({c})"), ("std", "stddev_samp({c})"), ("min", "min({c})"),
    ("25%", "quantile_cont(CAST({c} AS DOUBLE), 0.25)"), ("50%", "quantile_cont(CAST({c} AS DOUBLE), 0.5)"),
    ("75%", "quantile_cont(CAST({c} AS DOUBLE), 0.75)"), ("max", "max({c})"),
)


@register(
    "c23_describe",
    src("lineitem")
    + " UNION ALL ".join(
        f"SELECT '{c}' AS name, '{s}' AS statistic, {rnd(e.format(c=c))} AS value FROM src"
        for c, k in SOURCES["lineitem"][0].items()
        if k == "number"
        for s, e in DESCRIBED
    ),
)
def c23_describe(spark, sf_dir):
    return C.describe(source(spark, sf_dir, "lineitem"))


@register(
    "c24_category_summary",
    value_rows("documents", ("string",))
    + """, r AS (SELECT *, count(*) OVER (PARTITION BY ordinal) AS n_unique,
      row_number() OVER (PARTITION BY ordinal ORDER BY cnt DESC, value) AS rank,
      row_number() OVER (PARTITION BY ordinal ORDER BY cnt, value DESC) AS back FROM freq)
      SELECT r.name, r.n_unique, m.value AS most_frequent, m.cnt AS most_frequent_count, l.value AS least_frequent,
      r.rank, r.value, r.cnt AS count FROM r JOIN r m ON m.ordinal = r.ordinal AND m.rank = 1
      JOIN r l ON l.ordinal = r.ordinal AND l.back = 1 WHERE r.rank <= 10""",
)
def c24_category_summary(spark, sf_dir):
    return Q.category_summary(source(spark, sf_dir, "documents"))


def _by_segment(name: str, key: str, values: tuple[str, ...], select: str) -> str:
    """The whole-table profile, once per segment."""
    kinds = {c: k for c, k in SOURCES[name][0].items() if c != key}
    base = SOURCES[name]
    parts = []
    for v in values:
        SOURCES["_segment"] = (kinds, f"SELECT {', '.join(kinds)} FROM ({base[1]}) WHERE {key} = '{v}'")
        sql = columns_sql("_segment", select.replace("CAST(ordinal AS BIGINT) AS ordinal, ", ""))
        parts.append(f"SELECT '{v}' AS {key}, * FROM ({sql})")
    del SOURCES["_segment"]
    return " UNION ALL ".join(parts)


SEGMENT = tuple(c for c in PROFILE if c != "ordinal")


@register("c25_profile_by", _by_segment("lineitem", "l_returnflag", ("A", "N", "R"), pick(*SEGMENT)))
def c25_profile_by(spark, sf_dir):
    return C.profile_by(source(spark, sf_dir, "lineitem"), ["l_returnflag"]).select("l_returnflag", *SEGMENT)


def _with_total(name: str, key: str, values: tuple[str, ...], select: str) -> str:
    """The segments, and the same of the whole table without its key."""
    kinds = {c: k for c, k in SOURCES[name][0].items() if c != key}
    SOURCES["_whole"] = (kinds, f"SELECT {', '.join(kinds)} FROM ({SOURCES[name][1]})")
    whole = columns_sql("_whole", select)
    del SOURCES["_whole"]
    parts = _by_segment(name, key, values, select)
    return f"SELECT FALSE AS is_total, * FROM ({parts}) UNION ALL SELECT TRUE, NULL, * FROM ({whole})"


@register("c25_profile_total", _with_total("lineitem", "l_returnflag", ("A", "N", "R"), pick(*SEGMENT)))
def c25_profile_total(spark, sf_dir):
    """Segments and whole table from one frequency table."""
    p = C.profile_by(source(spark, sf_dir, "lineitem"), ["l_returnflag"], total=True)
    return p.select("is_total", "l_returnflag", *SEGMENT)


@register("c25_profile_total_text", _with_total("orders_text", "o_orderstatus", ("F", "O", "P"), pick(*SEGMENT)))
def c25_profile_total_text(spark, sf_dir):
    """The same where types, numbers and dates come from text."""
    p = C.profile_by(source(spark, sf_dir, "orders_text"), ["o_orderstatus"], total=True)
    return p.select("is_total", "o_orderstatus", *SEGMENT)


@register("c25_profile_by_lang", _by_segment("troubled", "lang", ("de", "en", "es", "fr"), pick(*SEGMENT)))
def c25_profile_by_lang(spark, sf_dir):
    return C.profile_by(source(spark, sf_dir, "troubled"), ["lang"]).select("lang", *SEGMENT)


# -- D: dataset analysis -------------------------------------------------------

DUPLICATE_PCT = "(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM src) u)) * 100.0 / count(*)"
TYPE_COUNTS = ", ".join(
    f"(SELECT count(*) FROM cp WHERE inferred_type = '{t}') AS n_{t}" for t in ("numeric", "categorical", "datetime", "text")
)


@register(
    "d1_dataset_profile",
    f"{with_columns('labelled')} SELECT 'labelled' AS dataset, count(*) AS n_rows, {big('7')} AS n_cols, {rnd(SIZE_MB)} AS size_mb,"
    f" {rnd(DUPLICATE_PCT)} AS duplicate_rows_pct, {TYPE_COUNTS} FROM src",
)
def d1_dataset_profile(spark, sf_dir):
    return D.dataset_profile(source(spark, sf_dir, "labelled"), "labelled")


@register("d2_logical_size", src("labelled") + f"SELECT {rnd(SIZE_MB)} AS size_mb FROM src")
def d2_logical_size(spark, sf_dir):
    return D.logical_size_mb(source(spark, sf_dir, "labelled"))


DUPLICATES = (
    "SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM src) u) AS duplicate_rows,"
    f" {rnd(DUPLICATE_PCT)} AS duplicate_rows_pct FROM src"
)


@register("d3_duplicate_rows", src("status_priority") + DUPLICATES)
def d3_duplicate_rows(spark, sf_dir):
    return D.duplicate_rows(source(spark, sf_dir, "status_priority"))


@register("d3_duplicate_rows_nulls", "WITH src AS (SELECT quality, toxic, lang FROM (" + SOURCES["labelled"][1] + ")) " + DUPLICATES)
def d3_duplicate_rows_nulls(spark, sf_dir):
    return D.duplicate_rows(source(spark, sf_dir, "labelled").select("quality", "toxic", "lang"))


MISSING = "count(*) - count({c}) AS missing_count, " + rnd("(count(*) - count({c})) * 100.0 / count(*)") + " AS missing_pct"


@register(
    "d4_missing_by_column",
    f"SELECT name, missing_count, missing_pct FROM ({per_column('troubled', ALL, MISSING)}) WHERE missing_count > 0",
)
def d4_missing_by_column(spark, sf_dir):
    return D.missing_by_column(source(spark, sf_dir, "troubled"))


@register(
    "d5_completeness_overall",
    src("labelled")
    + f"SELECT {big('m')} AS missing_cells, {rnd('100 - m * 100.0 / (n * 7)')} AS completeness_pct, {rnd('m * 100.0 / (n * 7)')} AS missing_pct"
    f" FROM (SELECT count(*) AS n, {MISSING_CELLS} AS m FROM src)",
)
def d5_completeness_overall(spark, sf_dir):
    return D.completeness_overall(source(spark, sf_dir, "labelled"))


def pairs_sql(name: str) -> str:
    cols = [(i, c) for i, (c, k) in enumerate(SOURCES[name][0].items()) if k == "number"]
    parts = [
        f"SELECT {i} AS ordinal1, '{a}' AS column1, {j} AS ordinal2, '{b}' AS column2, corr({a}, {b}) AS r FROM src"
        for n, (i, a) in enumerate(cols)
        for j, b in cols[n + 1 :]
    ]
    return f"WITH src AS ({SOURCES[name][1]}), pairs AS ({' UNION ALL '.join(parts)}) "


@register(
    "d6_correlations",
    pairs_sql("labelled") + f"SELECT {big('ordinal1')} AS ordinal1, column1, {big('ordinal2')} AS ordinal2, column2, {rnd('r')} AS correlation FROM pairs",
)
def d6_correlations(spark, sf_dir):
    return R.correlations(source(spark, sf_dir, "labelled"))


@register(
    "d6_correlations_by_segment",
    " UNION ALL ".join(
        f"SELECT lang, '{a}' AS column1, '{b}' AS column2, {rnd(f'corr({a}, {b})')} AS correlation FROM"
        f" ({SOURCES['labelled'][1]}) WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY lang"
        if "toxic" not in (a, b) and "quality" not in (a, b)
        else f"SELECT lang, '{a}', '{b}', CASE WHEN min({a}) < max({a}) AND min({b}) < max({b}) THEN {rnd(f'corr({a}, {b})')} END FROM"
        f" ({SOURCES['labelled'][1]}) WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY lang"
        for a, b in (("doc_id", "n_chars"), ("doc_id", "quality"), ("doc_id", "toxic"), ("n_chars", "quality"), ("n_chars", "toxic"), ("quality", "toxic"))
    ),
)
def d6_correlations_by_segment(spark, sf_dir):
    return R.correlations(source(spark, sf_dir, "labelled"), by=["lang"]).select("lang", "column1", "column2", "correlation")


@register("d7_high_correlations", pairs_sql("related") + f"SELECT column1, column2, {rnd('r')} AS correlation FROM pairs WHERE abs(r) > 0.7")
def d7_high_correlations(spark, sf_dir):
    return R.high_correlations(R.correlations(source(spark, sf_dir, "related")))


@register(
    "d8_strong_pairs",
    pairs_sql("related")
    + "SELECT column1 AS variable1, column2 AS variable2, CAST(round(CAST(r AS DECIMAL(30,8)), 3) AS DOUBLE) AS correlation,"
    " CASE WHEN abs(r) > 0.8 THEN 'Very Strong' ELSE 'Strong' END AS strength FROM pairs WHERE abs(r) > 0.5",
)
def d8_strong_pairs(spark, sf_dir):
    return R.strong_pairs(R.correlations(source(spark, sf_dir, "related")))


def _profiled(spark, sf_dir, name: str):
    return C.profile_columns(source(spark, sf_dir, name)).withColumn("dataset", F.lit(name))


NAMES = "coalesce(string_agg(name, ',' ORDER BY name) FILTER ({c}), '')"


@register(
    "d9_quality_insights",
    f"{with_columns('troubled')} SELECT 'troubled' AS dataset, count(*) FILTER (non_null < n_rows) AS columns_with_missing,"
    " count(*) FILTER (non_null * 1.0 / n_rows < 0.8) AS columns_with_high_missing,"
    " count(*) FILTER (n_unique = n_rows) AS columns_all_unique,"
    f" {NAMES.format(c='contains(quality_issues, ' + chr(39) + 'likely_id' + chr(39) + ')')} AS potential_id_columns,"
    f" {NAMES.format(c='outliers_pct > 5')} AS columns_with_outliers FROM cp",
)
def d9_quality_insights(spark, sf_dir):
    return D.quality_insights(_profiled(spark, sf_dir, "troubled"))


@register(
    "d10_skewed_columns",
    columns_sql(
        "troubled",
        f"'troubled' AS dataset, name, {rnd('skewness')} AS skewness,"
        " CASE WHEN abs(skewness) > 2 THEN 'highly skewed' ELSE 'moderately skewed' END AS interpretation",
        "abs(skewness) > 1",
    ),
)
def d10_skewed_columns(spark, sf_dir):
    return D.skewed_columns(_profiled(spark, sf_dir, "troubled"))


ROUNDED = "CAST(round(CAST({x} AS DECIMAL(30,8)), 2) AS DOUBLE)"


@register(
    "d11_outlier_table",
    columns_sql(
        "labelled",
        f"name, outliers_count, {ROUNDED.format(x='outliers_count * 100.0 / n_rows')} AS outliers_pct",
        "inferred_type = 'numeric' AND outliers_count > 0",
    ),
)
def d11_outlier_table(spark, sf_dir):
    return D.outlier_table(source(spark, sf_dir, "labelled"))


def rule_sql(rule: str, where: str) -> str:
    return f"SELECT '{rule}' AS rule, string_agg(name, ',' ORDER BY name) AS columns FROM cp WHERE {where} HAVING count(*) > 0"


def recommendations_sql(name: str) -> str:
    """WITH clause ending in rec(rule, columns)."""
    strings = ", ".join(f"'{c}'" for c, k in SOURCES[name][0].items() if k == "string")
    pairs = pairs_sql(name)[len(f"WITH src AS ({SOURCES[name][1]})") :]
    rules = [
        rule_sql("high_missing", "n_rows - non_null > 0.3 * n_rows"),
        rule_sql("outliers", "outliers_count > 0.05 * n_rows"),
        rule_sql("high_cardinality", f"name IN ({strings}) AND n_unique > 0.5 * n_rows"),
        "SELECT 'high_correlation', string_agg(DISTINCT x, ',' ORDER BY x) FROM"
        " (SELECT unnest([column1, column2]) AS x FROM pairs WHERE abs(r) > 0.8) HAVING count(*) > 0",
    ]
    return f"{with_columns(name)}{pairs}, rec AS ({' UNION ALL '.join(rules)}) "


@register("d12_recommendations", recommendations_sql("measured") + "SELECT * FROM rec")
def d12_recommendations(spark, sf_dir):
    return D.recommendations(source(spark, sf_dir, "measured"))


@register(
    "d13_missing_table",
    columns_sql(
        "troubled",
        f"name, n_rows - non_null AS missing_count, {ROUNDED.format(x='(n_rows - non_null) * 100.0 / n_rows')} AS missing_pct",
        "non_null < n_rows",
    ),
)
def d13_missing_table(spark, sf_dir):
    return D.missing_table(source(spark, sf_dir, "troubled"))


@register(
    "d14_profile",
    columns_sql("orders_text", "'orders' AS dataset, " + pick("name", "inferred_type", "n_rows", "non_null_pct", "n_unique", "quality_issues")),
)
def d14_profile(spark, sf_dir):
    p = D.profile(source(spark, sf_dir, "orders_text"), "orders")
    return p.columns.select("dataset", "name", "inferred_type", "n_rows", "non_null_pct", "n_unique", "quality_issues")


@register(
    "d14_profile_missing",
    columns_sql("troubled", f"'troubled' AS dataset, name, n_rows - non_null AS missing_count, {rnd('100 - non_null_pct')} AS missing_pct", "non_null < n_rows"),
)
def d14_profile_missing(spark, sf_dir):
    return D.profile(source(spark, sf_dir, "troubled"), "troubled").missing


@register(
    "d14_profile_empty",
    "SELECT 'none' AS dataset, CAST(0 AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_cols, 0.0::DOUBLE AS size_mb, 0.0::DOUBLE AS duplicate_rows_pct,"
    " CAST(0 AS BIGINT) AS missing_cells, 100.0::DOUBLE AS completeness_pct, count(*) AS n_columns FROM documents WHERE doc_id < 0",
)
def d14_profile_empty(spark, sf_dir):
    """A table without rows has no columns and is complete."""
    p = D.profile(table(spark, sf_dir, "documents").where("doc_id < 0"), "none")
    per = p.columns.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_columns"))
    joined = p.dataset.join(p.completeness, "dataset").join(per, "dataset", "left")
    return joined.select(
        "dataset", "n_rows", "n_cols", "size_mb", "duplicate_rows_pct", "missing_cells", "completeness_pct",
        F.coalesce("n_columns", F.lit(0)).alias("n_columns"),
    )


@register(
    "d14_profile_correlations",
    "SELECT 'o_orderkey' AS column1, 'o_custkey' AS column2, " + rnd("corr(o_orderkey, o_custkey)") + " AS correlation FROM orders"
    " UNION ALL SELECT 'o_orderkey', 'o_totalprice', " + rnd("corr(o_orderkey, o_totalprice)") + " FROM orders"
    " UNION ALL SELECT 'o_custkey', 'o_totalprice', " + rnd("corr(o_custkey, o_totalprice)") + " FROM orders",
)
def d14_profile_correlations(spark, sf_dir):
    """Numbers held as text take part."""
    return R.semantic_correlations(source(spark, sf_dir, "orders_text")).select("column1", "column2", "correlation")


# -- E: distributions ----------------------------------------------------------


def layout_sql(table_name: str, c: str, whole: bool = False) -> str:
    width = "least(2 * (q3 - q1) / pow(n, 1.0 / 3), (hi - lo) / (log2(n) + 1))"
    width = f"CASE WHEN q3 > q1 THEN {width} ELSE (hi - lo) / (log2(n) + 1) END"
    if whole:
        width = f"greatest(1.0, {width})"
    return (
        f"v AS (SELECT CAST({c} AS DOUBLE) AS x FROM {table_name} WHERE {c} IS NOT NULL),"
        " s AS (SELECT count(*) AS n, min(x) AS lo, max(x) AS hi, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,"
        " quantile_cont(x, 0.75) AS q3, stddev_samp(x) AS sd FROM v),"
        f" l AS (SELECT *, CAST(ceil((hi - lo) / ({width})) AS BIGINT) AS bins FROM s),"
        " b AS (SELECT *, (hi - lo) / bins AS width FROM l)"
    )


HISTOGRAM = (
    ", h AS (SELECT least(floor((x - lo) / width), bins - 1) AS bin, count(*) AS c FROM v, b GROUP BY 1)"
    f" SELECT {big('g.bin')} AS bin, {rnd('b.lo + g.bin * b.width')} AS lo, {rnd('b.lo + (g.bin + 1) * b.width')} AS hi, coalesce(h.c, 0) AS count"
    " FROM b, generate_series(0, b.bins - 1) g(bin) LEFT JOIN h ON h.bin = g.bin"
)
GRID = " FROM b CROSS JOIN LATERAL (SELECT unnest(generate_series(0, b.bins - 1)) AS bin) g LEFT JOIN h ON h.bin = g.bin"
HISTOGRAM = HISTOGRAM[: HISTOGRAM.index(" FROM b, generate")] + GRID


@register("e1_histogram", f"WITH {layout_sql('events', 'value')}{HISTOGRAM}")
def e1_histogram(spark, sf_dir):
    return E.histogram(table(spark, sf_dir, "events"), "value")


@register("e1_histogram_whole", f"WITH {layout_sql('lineitem', 'l_linenumber', True)}{HISTOGRAM}")
def e1_histogram_whole(spark, sf_dir):
    return E.histogram(table(spark, sf_dir, "lineitem"), "l_linenumber")


TAILED = "(SELECT CASE WHEN event_id % 500 = 7 THEN value * 1e12 ELSE value END AS value FROM events) tailed"


@register(
    "e1_histogram_tail",
    f"WITH {layout_sql(TAILED, 'value')}, h AS (SELECT least(floor((x - lo) / width), bins - 1) AS bin, count(*) AS c FROM v, b GROUP BY 1)"
    f" SELECT {big('bin')} AS bin, c AS count FROM h",
)
def e1_histogram_tail(spark, sf_dir):
    """Few values far out ask for very many bins; only those with values are returned."""
    value = F.when(F.col("event_id") % 500 == 7, F.col("value") * 1e12).otherwise(F.col("value"))
    return E.histogram(table(spark, sf_dir, "events").select(value.alias("value")), "value", empty=False).select("bin", "count")


@register(
    "e2_kde_constant",
    "SELECT 'constant' AS kind, CASE WHEN stddev_samp(value * 0) > 0 THEN 200 ELSE 0 END AS n FROM events"
    " UNION ALL SELECT 'value', CASE WHEN stddev_samp(value) > 0 THEN 200 ELSE 0 END FROM events",
)
def e2_kde_constant(spark, sf_dir):
    """A constant has no density curve, beside one that has."""
    events = table(spark, sf_dir, "events")
    n = lambda df, kind: E.kde(df, "value").agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return n(events.select((F.col("value") * 0).alias("value")), "constant").union(n(events, "value"))


def kde_sql(table_name: str) -> str:
    """The density from every value, not from cells; scaled so that rounding keeps its digits."""
    return (
        f"WITH v AS (SELECT CAST(value AS DOUBLE) AS x FROM {table_name} WHERE value IS NOT NULL),"
        " s AS (SELECT count(*) AS n, min(x) AS lo, max(x) AS hi, stddev_samp(x) AS sd FROM v),"
        " k AS (SELECT *, sd * pow(n, -0.2) AS h FROM s), g AS (SELECT unnest(generate_series(0, 199)) AS point)"
        f" SELECT point, {rnd('lo + point * ((hi - lo) / 199)')} AS x,"
        f" {rnd('sum(exp(-0.5 * pow((lo + point * ((hi - lo) / 199) - x) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())) * 1000')} AS density"
        " FROM g, k, v GROUP BY point, lo, hi"
    )


@register("e2_kde", kde_sql("events"))
def e2_kde(spark, sf_dir):
    return E.kde(table(spark, sf_dir, "events"), "value").withColumn("density", F.col("density") * 1000)


FAR = "(SELECT CASE WHEN event_id % 500 = 7 THEN value * 1000 ELSE value END AS value FROM events) far"


@register("e2_kde_tail", kde_sql(FAR))
def e2_kde_tail(spark, sf_dir):
    """Few values far out: the bulk lies within a few hundredths of the range."""
    value = F.when(F.col("event_id") % 500 == 7, F.col("value") * 1000).otherwise(F.col("value"))
    return E.kde(table(spark, sf_dir, "events").select(value.alias("value")), "value").withColumn("density", F.col("density") * 1000)


@register(
    "e3_outlier_bounds",
    f"WITH {layout_sql('events', 'value')} SELECT {rnd('q1')} AS q1, {rnd('q3')} AS q3,"
    f" {rnd('q1 - 1.5 * (q3 - q1)')} AS lower_bound, {rnd('q3 + 1.5 * (q3 - q1)')} AS upper_bound FROM s",
)
def e3_outlier_bounds(spark, sf_dir):
    return E.outlier_bounds(table(spark, sf_dir, "events"), "value")


INSIDE = "x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1)"


@register(
    "e4_boxplot",
    f"WITH {layout_sql('documents', 'n_chars')} SELECT {rnd('any_value(q1)')} AS q1, {rnd('any_value(median)')} AS median, {rnd('any_value(q3)')} AS q3,"
    f" min(x) FILTER ({INSIDE}) AS whisker_low, max(x) FILTER ({INSIDE}) AS whisker_high, count(*) FILTER (NOT ({INSIDE})) AS fliers FROM v, s",
)
def e4_boxplot(spark, sf_dir):
    return E.boxplot(table(spark, sf_dir, "documents"), "n_chars")


@register(
    "e4_fliers",
    f"WITH {layout_sql('documents', 'n_chars')} SELECT doc_id, n_chars FROM documents, s WHERE n_chars < q1 - 1.5 * (q3 - q1) OR n_chars > q3 + 1.5 * (q3 - q1)",
)
def e4_fliers(spark, sf_dir):
    return E.fliers(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars")


@register(
    "e5_category_counts",
    "SELECT source AS value, count(*) AS count FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 10",
)
def e5_category_counts(spark, sf_dir):
    return E.category_counts(table(spark, sf_dir, "documents"), "source", 10)


@register(
    "e6_correlation_triangle",
    pairs_sql("related") + f'SELECT column2 AS "row", column1 AS "column", {rnd("r")} AS correlation FROM pairs',
)
def e6_correlation_triangle(spark, sf_dir):
    return R.correlation_triangle(R.correlations(source(spark, sf_dir, "related")))


def raster_sql(order: str, bands: int) -> str:
    cols = list(SOURCES["labelled"][0])
    head = src("labelled") + f", r AS (SELECT *, (row_number() OVER (ORDER BY {order}) - 1) * {bands} // count(*) OVER () AS band FROM src) "
    head = head.replace(") , r", "), r")
    return head + " UNION ALL ".join(
        f"SELECT {big('band')} AS band, '{c}' AS name, {rnd(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)')} AS null_rate FROM r GROUP BY band"
        for c in cols
    )


@register("e7_missing_raster", raster_sql("doc_id", 100))
def e7_missing_raster(spark, sf_dir):
    return E.missing_raster(source(spark, sf_dir, "labelled"), "doc_id", 100)


SPREAD = {"doc_id": "doc_id * 3 AS doc_id"}


@register("e7_missing_raster_sparse", raster_sql("doc_id", 7))
def e7_missing_raster_sparse(spark, sf_dir):
    """A key with gaps takes the ranked path."""
    df = source(spark, sf_dir, "labelled").withColumn("doc_id", F.col("doc_id") * 3)
    return E.missing_raster(df, "doc_id", 7)


MASK = "concat(" + ", ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in SOURCES["troubled"][0]) + ")"


@register("e8_missing_patterns", src("troubled") + f"SELECT {MASK} AS pattern, count(*) AS n_rows FROM src GROUP BY 1")
def e8_missing_patterns(spark, sf_dir):
    return E.missing_patterns(source(spark, sf_dir, "troubled"))
