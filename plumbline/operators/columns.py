"""Column statistics and the full column profile, for a whole table or per segment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import parse_date, to_numeric
from ..functions.values import col, percent
from .aggregate import by_column
from .frequency import (
    SAMPLE_VALUES,
    TOP_VALUES,
    RARE_SHARE,
    added_up,
    every_column,
    first_k,
    frequencies,
    in_order,
    of_columns,
    restore,
    smallest_digests,
    value_order,
)
from ..session import settle
from .quantiles import QUARTILES, beside, counted_quantiles, select_quantiles
from .schema import Field, fields, normalise, number_fields
from .types import Facts, look, physical_type, string_type

OUTLIER_REACH = 1.5

# Bytes per value by type name; strings and nested values count their UTF-8 bytes.
WIDTHS = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "boolean": 1, "date": 4}


def _bytes(f: Field) -> int:
    if f.kind == "decimal" and int(f.dtype[8:].split(",")[0]) > 18:
        return 16
    return WIDTHS.get(f.dtype, 8)


def width(f: Field) -> Column:
    """Bytes of one value, NULL where the value is."""
    if f.kind in ("string", "nested"):
        return F.octet_length(f.value)
    return F.when(f.value.isNotNull(), F.lit(_bytes(f)))


# -- single statistics ---------------------------------------------------------


def moments(x: Column) -> dict[str, Column]:
    """Mean, sample deviation and range; all zero where there is no number."""
    none = F.count(x) == 0
    zero = lambda e: F.when(none, 0.0).otherwise(e)
    return {"mean": zero(F.avg(x)), "std": zero(F.stddev_samp(x)), "min": zero(F.min(x)), "max": zero(F.max(x))}


def signs(x: Column) -> dict[str, Column]:
    n = F.count(x)
    return {
        "negative_count": F.count_if(x < 0),
        "negative_pct": percent(F.count_if(x < 0), n),
        "zeros_count": F.count_if(x == 0),
        "zeros_pct": percent(F.count_if(x == 0), n),
    }


# Sums of squares below this are rounding noise of a constant column.
FLAT = 1e-14


def skew(x: Column) -> Column:
    """Bias-adjusted skewness; 0 for fewer than three values or a constant."""
    n = F.count(x).cast("double")
    varies = (n > 2) & (F.var_pop(x) * n >= FLAT)
    return F.coalesce(F.when(varies, F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(x)), F.lit(0.0))


def excess_kurtosis(x: Column) -> Column:
    """Bias-adjusted excess kurtosis; 0 for fewer than four values or a constant."""
    n = F.count(x).cast("double")
    adjusted = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)
    return F.coalesce(F.when((n > 3) & (F.var_pop(x) * n >= FLAT), adjusted), F.lit(0.0))


def iso(ts: Column) -> Column:
    """ISO form, with the fraction only if there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_trunc("second", ts) == ts, whole).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def elapsed_days(first: Column, last: Column) -> Column:
    """Whole elapsed days, not midnights passed."""
    return F.timestamp_diff("DAY", first, last)


def iqr_bounds(q1: Column, q3: Column) -> tuple[Column, Column]:
    reach = OUTLIER_REACH * (q3 - q1)
    return q1 - reach, q3 + reach


def _numbers(df: DataFrame, names: list[str] | None) -> tuple[DataFrame, list[Field]]:
    df = normalise(df)
    return df, number_fields(df, names)


def completeness(df: DataFrame) -> DataFrame:
    """(ordinal, name, n_rows, non_null, non_null_pct)."""
    df = normalise(df)
    return by_column(
        df,
        fields(df),
        lambda f: {
            "n_rows": F.count(F.lit(1)),
            "non_null": F.count(f.value),
            "non_null_pct": percent(F.count(f.value), F.count(F.lit(1))),
        },
    )


def numeric_moments(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(ordinal, name, mean, std, min, max) of number columns."""
    df, cols = _numbers(df, names)
    return by_column(df, cols, lambda f: moments(f.number))


def sign_counts(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(ordinal, name, negative_count, negative_pct, zeros_count, zeros_pct)."""
    df, cols = _numbers(df, names)
    return by_column(df, cols, lambda f: signs(f.number))


def skewness(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    df, cols = _numbers(df, names)
    return by_column(df, cols, lambda f: {"skewness": skew(f.number)})


def kurtosis(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    df, cols = _numbers(df, names)
    return by_column(df, cols, lambda f: {"kurtosis": excess_kurtosis(f.number)})


def datetime_stats(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(ordinal, name, min_date, max_date, coverage_days) of date columns."""
    df = normalise(df)
    cols = [f for f in fields(df) if f.kind == "time" and (names is None or f.name in names)]

    def build(f: Field) -> dict[str, Column]:
        lo, hi = F.min(f.value).cast("timestamp"), F.max(f.value).cast("timestamp")
        return {"min_date": iso(lo), "max_date": iso(hi), "coverage_days": elapsed_days(lo, hi)}

    return by_column(df, cols, build)


def _strings(df: DataFrame, names: list[str] | None) -> tuple[DataFrame, list[Field]]:
    df = normalise(df)
    return df, [f for f in fields(df) if f.kind in ("string", "nested") and (names is None or f.name in names)]


def text_length(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(ordinal, name, avg_length) in characters."""
    df, cols = _strings(df, names)
    return by_column(df, cols, lambda f: {"avg_length": F.avg(F.length(f.value))})


def empty_rate(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(ordinal, name, pct_empty): empty strings among the non-null."""
    df, cols = _strings(df, names)
    return by_column(df, cols, lambda f: {"pct_empty": percent(F.count_if(f.value == ""), F.count(f.value))})


# -- quartiles and outliers ----------------------------------------------------


def _numeric_counts(freq: DataFrame, facts: Sequence[Facts]) -> DataFrame:
    """Frequency table with ``v``, the value as double where its column can be numeric."""
    parsed = [x.field.ordinal for x in facts if x.may_be_numeric or x.field.kind == "decimal"]
    text = F.when(F.col("ordinal").isin(parsed), to_numeric(F.col("txt"))) if parsed else F.lit(None).cast("double")
    return freq.withColumn("v", F.coalesce(F.col("lng").cast("double"), F.col("dbl"), F.col("flt").cast("double"), text))


def counted(freq: DataFrame, facts: Sequence[Facts]) -> DataFrame:
    """The frequency table with ``v``, settled: every distinct text is parsed once."""
    return settle(_numeric_counts(freq, facts))


def _counted_quartiles(df: DataFrame, facts: Sequence[Facts], freq: DataFrame, spread: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, ordinal, quartiles) from values and their counts; the table is scanned for texts that the counts do not have whole."""
    cut = [x for x in facts if x.numeric_value is not None and x.long_values]
    whole = [x.field.ordinal for x in facts if x.numeric_value is not None and not x.long_values]
    ends = spread.where((F.col("count") > 0) & F.col("ordinal").isin(whole)).select(
        *[col(k) for k in by], "ordinal", F.col("count").alias("n"), F.col("min").alias("lo"), F.col("max").alias("hi"), F.col("n_unique").alias("left")
    )
    found = counted_quantiles(freq.where(of_columns(whole)), by, ends=ends)
    return found.unionByName(_quartiles(df, cut, by)) if cut else found


def _quartiles(df: DataFrame, facts: Sequence[Facts], by: Sequence[str] = ()) -> DataFrame:
    """(by, ordinal, quartiles) of the columns that can be numeric, selected by scans of the table."""
    return select_quantiles(df, [(x.field.ordinal, x.numeric_value) for x in facts if x.numeric_value is not None], by)


def _beside(freq: DataFrame, right: DataFrame, by: Sequence[str], on_column: bool = True) -> DataFrame:
    """The frequency table, each row with what ``right`` has for its segment (and column)."""
    n_right = right.count() if by else None
    return beside(freq, right, [*by, "ordinal"] if on_column else list(by), by, ["ordinal", "lng", "dbl", "flt", "txt"], n_right)


def _outside(q1: Column, q3: Column) -> Column:
    """Rows outside the quartiles by more than the reach."""
    lo, hi = iqr_bounds(q1, q3)
    v = F.col("v")
    return F.sum(F.when((v < lo) | (v > hi), F.col("cnt")).otherwise(0))


def _second_pass(freq: DataFrame, spread: DataFrame, by: Sequence[str]) -> DataFrame:
    """First-round statistics carried along with the second round, so that each is computed once."""
    names = [c for c in spread.columns if c not in by and c != "ordinal"]
    joined = _beside(freq, spread.select(*[col(k) for k in by], "ordinal", *names), by)
    carried = [F.first(n).alias(n) for n in names]
    return joined.groupBy(*[col(k) for k in by], "ordinal").agg(
        *carried, *(e.alias(n) for n, e in _second_round().items())
    )


def _first_round() -> dict[str, Column]:
    """Statistics of ``v`` weighted by ``cnt`` that need one look at the counts."""
    v, n = F.col("v"), F.col("cnt")
    weight = F.when(v.isNotNull(), n)
    return {
        "count": F.coalesce(F.sum(weight), F.lit(0)),
        "mean": F.try_divide(F.sum(v * n), F.sum(weight)),
        "min": F.min(v),
        "max": F.max(v),
        "negative_count": F.coalesce(F.sum(F.when(v < 0, n)), F.lit(0)),
        "zeros_count": F.coalesce(F.sum(F.when(v == 0, n)), F.lit(0)),
    }


def _second_round() -> dict[str, Column]:
    """Outliers and central moments, given the quartiles and the mean of the first round.

    Deviations from the known mean are summed directly, which stays accurate
    where one-pass power sums cancel out.
    """
    w = F.when(F.col("v").isNotNull(), F.col("cnt").cast("double"))
    d = F.col("v") - F.col("mean")
    n = F.sum(w)
    m2, m3, m4 = F.sum(w * d * d), F.sum(w * d * d * d), F.sum(w * d * d * d * d)
    flat = m2 < FLAT
    skewed = F.try_divide(n * F.sqrt(n - 1) * m3, (n - 2) * m2 * F.sqrt(m2))
    peaked = F.try_divide(n * (n + 1) * (n - 1) * m4, (n - 2) * (n - 3) * m2 * m2)
    peaked = peaked - F.try_divide(3 * (n - 1) * (n - 1), (n - 2) * (n - 3))
    zero = F.lit(0.0)
    return {
        "outliers_count": _outside(F.col("q1"), F.col("q3")),
        "std": F.when(n > 1, F.sqrt(F.try_divide(m2, n - 1))),
        "skewness": F.when((n < 3) | flat, zero).otherwise(F.coalesce(skewed, zero)),
        "kurtosis": F.when((n < 4) | flat, zero).otherwise(F.coalesce(peaked, zero)),
    }


def _number_facts(df: DataFrame, names: list[str] | None) -> tuple[DataFrame, list[Facts]]:
    df = normalise(df)
    cols = number_fields(df, names)
    df = df.select(*(f.value for f in cols))
    return df, look(df)


def quartiles(df: DataFrame, exact: bool = True, names: list[str] | None = None) -> DataFrame:
    """(name, q1, median, q3) of number columns, linear interpolation; ``exact=False`` sketches in one scan."""
    df, facts = _number_facts(df, names)
    if not exact:
        ps = list(QUARTILES)
        out = by_column(df, fields(df), lambda f: {"quartiles": F.percentile_approx(f.number, ps, 10000)})
    else:
        out = every_column(df, facts, _quartiles(df, facts))
    q = F.col("quartiles")
    return out.select("name", *(F.coalesce(q[i], F.lit(0.0)).alias(n) for i, n in enumerate(("q1", "median", "q3"))))


def iqr_outliers(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(name, n_rows, non_null, outliers_count, outliers_pct): share of the non-null values."""
    df, facts = _number_facts(df, names)
    # One row per column of the schema: the counts are one more scan.
    found = {r["ordinal"]: r["quartiles"] for r in _quartiles(df, facts).collect()}

    def build(f: Field) -> dict[str, Column]:
        q1, _, q3 = (F.lit(q) for q in found.get(f.ordinal, (None, None, None)))
        lo, hi = iqr_bounds(q1.cast("double"), q3.cast("double"))
        outside = (f.number < lo) | (f.number > hi)
        return {"n_rows": F.count(F.lit(1)), "non_null": F.count(f.value), "outliers_count": F.count_if(outside)}

    out = by_column(df, fields(df), build)
    return out.select(
        "name", "n_rows", "non_null", "outliers_count", percent(F.col("outliers_count"), F.col("non_null")).alias("outliers_pct")
    )


def describe(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(name, statistic, value): count, mean, std, min, quartiles and max of number columns."""
    df, facts = _number_facts(df, names)
    x = lambda f: f.number
    base = by_column(
        df,
        fields(df),
        lambda f: {
            "count": F.count(x(f)).cast("double"),
            "mean": F.avg(x(f)),
            "std": F.stddev_samp(x(f)),
            "min": F.min(x(f)),
            "max": F.max(x(f)),
        },
    )
    q = F.col("quartiles")
    found = _quartiles(df, facts)
    wide = base.join(F.broadcast(found), "ordinal", "left")
    order = [("count", F.col("count")), ("mean", F.col("mean")), ("std", F.col("std")), ("min", F.col("min"))]
    order += [("25%", q[0]), ("50%", q[1]), ("75%", q[2]), ("max", F.col("max"))]
    cells = F.array(*(F.struct(F.lit(n).alias("statistic"), e.alias("value")) for n, e in order))
    return wide.select("name", F.inline(cells))


# -- the column profile --------------------------------------------------------


DATES = "array<struct<layout:string,n:bigint,first:timestamp,last:timestamp>>"


def counts_of(x: Facts) -> dict[str, Column]:
    """Counts, lengths, date ranges by layout and size of a column: few and cheap expressions, all of them additive."""
    f = x.field
    n = F.count(f.value)
    zero = F.lit(0).cast("bigint")
    out = {"n_rows": F.count(F.lit(1)), "non_null": n, "n_numeric": zero, "dates": F.array().cast(DATES)}
    if x.may_be_numeric:
        out["n_numeric"] = F.count(to_numeric(f.value))
    dated = lambda name, ts: F.struct(F.lit(name).alias("layout"), F.count(ts).alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    if f.kind == "time":
        out["dates"] = F.array(dated("", f.value.cast("timestamp")))
    elif x.formats:
        out["dates"] = F.array(*(dated(d.name, parse_date(f.value, d)) for d in x.formats))
    out["dates"] = out["dates"].cast(DATES)
    text = f.kind in ("string", "nested")
    out["chars"] = F.coalesce(F.sum(F.length(f.value)).cast("bigint"), F.lit(0)) if text else F.lit(None).cast("bigint")
    out["empty_count"] = F.count_if(f.value == "") if text else F.lit(None).cast("bigint")
    out["bytes"] = F.coalesce(F.sum(width(f)).cast("bigint"), F.lit(0)) if text else n * _bytes(f)
    return out


ADDED = ("n_rows", "non_null", "n_numeric", "chars", "empty_count", "bytes")


def merged_counts(parts: DataFrame, names: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """The counts of ``counts_of``, added up over rows of equal ``names``."""
    keys = [col(k) for k in names]
    sums = parts.groupBy(*keys).agg(*(F.sum(c).cast("bigint").alias(c) for c in ADDED), *extra)
    ranges = parts.select(*keys, F.inline("dates")).groupBy(*keys, "layout").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    # At most one entry per layout.
    ranges = ranges.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("layout", "n", "first", "last"))).alias("dates"))
    for k in names:
        ranges = ranges.withColumnRenamed(k, f"_{k}")
    same = F.lit(True)
    for k in names:
        same = same & col(k).eqNullSafe(col(f"_{k}"))
    joined = sums.join(ranges, same, "left").drop(*[f"_{k}" for k in names])
    return joined.withColumn("dates", F.coalesce("dates", F.array().cast(DATES)))


def read_counts(counts: DataFrame) -> DataFrame:
    """What the counts say: n_dates, the largest number of values of one layout, and first and last if it covers all; avg_length."""
    n = F.col("non_null")
    whole = F.get(F.filter("dates", lambda d: d["n"] == n), F.lit(0))
    most = F.array_max(F.transform("dates", lambda d: d["n"]))
    return (
        counts.withColumn("n_dates", F.coalesce(most, F.lit(0).cast("bigint")))
        .withColumn("first", whole["first"])
        .withColumn("last", whole["last"])
        .withColumn("avg_length", F.try_divide(F.col("chars"), n))
        .drop("dates", "chars")
    )


def _pass_one(df: DataFrame, facts: Sequence[Facts], by: Sequence[str]) -> DataFrame:
    """The counts of every column in one scan."""
    by_name = {x.field.name: x for x in facts}
    return by_column(df, [x.field for x in facts], lambda f: counts_of(by_name[f.name]), by)


def _listed(ranked_values: DataFrame, by: Sequence[str], element: Column, name: str) -> DataFrame:
    """Ranked rows to one array per column; the rank limit bounds it."""
    items = F.array_sort(F.collect_list(F.struct("rank", element.alias("item"))))
    return ranked_values.groupBy(*[col(k) for k in by], "ordinal").agg(
        F.transform(items, lambda t: t["item"]).alias(name)
    )


def _attach(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left join on (by, ordinal). Without segments the right side has one row per column of the schema."""
    for k in [*by, "ordinal"]:
        right = right.withColumnRenamed(k, f"_{k}")
    on = F.col("ordinal") == F.col("_ordinal")
    for k in by:
        on = on & col(k).eqNullSafe(col(f"_{k}"))
    joined = left.join(right if by else F.broadcast(right), on, "left")
    return joined.drop(*[f"_{k}" for k in [*by, "ordinal"]])


def base_columns(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, ordinal, name, inferred_type, n_rows, non_null, n_unique) without the costlier statistics."""
    df = normalise(df)
    facts = look(df, by)
    first = read_counts(_pass_one(df, facts, by))
    distinct = (
        frequencies(df, facts, by).groupBy(*[col(k) for k in by], "ordinal").agg(F.count(F.lit(1)).alias("n_unique"))
    )
    out = _attach(first.where("n_rows > 0"), distinct, by).withColumn("n_unique", F.coalesce("n_unique", F.lit(0)))
    return out.withColumn("inferred_type", _type(facts)).select(
        *[col(k) for k in by], "ordinal", "name", "inferred_type", "n_rows", "non_null", "n_unique"
    )


def _type(facts: Sequence[Facts]) -> Column:
    """Semantic type of a profile row: by schema where that decides, else by its counts."""
    known = {x.field.ordinal: physical_type(x.field) for x in facts}
    known |= {x.field.ordinal: "text" for x in facts if x.field.kind == "nested"}
    pairs = [F.lit(v) for k, t in known.items() if t for v in (k, t)]
    by_values = string_type(F.col("non_null"), F.col("n_numeric"), F.col("n_dates"), F.col("n_unique"))
    return F.coalesce(F.create_map(*pairs)[F.col("ordinal")], by_values) if pairs else by_values


def quality_flags(columns: DataFrame) -> DataFrame:
    """Add ``quality_issues``, the flags of a column in a fixed order.

    Shares are of all rows. The ``skewed`` flag compares the mean with the middle
    of the quartiles, not with the median.
    """
    n = F.col("n_rows")
    kind = F.col("inferred_type")
    flags = [
        ("high_missing", F.col("non_null") / n * 100 < 80),
        ("likely_id", F.col("n_unique") / n > 0.95),
        ("extreme_outliers", (kind == "numeric") & (F.col("outliers_count") > n * 0.05)),
        (
            "skewed",
            (kind == "numeric")
            & (F.abs(F.col("mean") - (F.col("q1") + F.col("q3")) / 2) > F.abs(F.col("q3") - F.col("q1"))),
        ),
        ("many_rare_categories", (kind == "categorical") & (F.col("rare_values") > 10)),
        ("mostly_empty", (kind == "text") & (F.col("pct_empty") > 50)),
    ]
    return columns.withColumn("quality_issues", F.array_compact(F.array(*(F.when(c, F.lit(f)) for f, c in flags))))


def profile_columns(df: DataFrame, by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """One row per column (and segment): base counts, the block of its type, and quality flags.

    Fed by the facts that decide the plan, one wide aggregate of cheap counts, one value-frequency
    table, settled once, from which the quartiles are selected too. Fields that do not apply to a column's type are NULL. A table without rows
    or columns has no rows here. ``exact=False`` reads sketches instead: see ``state.profile_state``.
    """
    if not exact:
        from .state import profile_state, read_state

        return read_state(profile_state(df, by), by)
    df = normalise(df)
    facts = look(df, by)
    if not facts:
        keys = [col(k) for k in by]
        return profile_columns(df.select(*keys, F.lit(None).cast("string").alias("none")).limit(0), by)
    counts = settle(_pass_one(df, facts, by).where("n_rows > 0"))
    return _profile(df, facts, by, counts, counted(frequencies(df, facts, by), facts))


def _profile(df: DataFrame, facts: Sequence[Facts], by: Sequence[str], counts: DataFrame, freq: DataFrame) -> DataFrame:
    """The profile from settled counts and frequencies with ``v``."""
    keys = [col(k) for k in by]
    first = read_counts(counts)
    sizes = first.groupBy(*keys).agg(F.max("n_rows").alias("_n"))
    if by:
        sized, n_rows = _beside(freq, sizes, by, on_column=False), F.col("_n")
    else:
        sized, n_rows = freq, F.lit(sizes.first()["_n"] or 0)
    rare = F.count_if(F.col("cnt") < F.greatest(F.lit(1.0), n_rows * RARE_SHARE))
    spread = sized.groupBy(*keys, "ordinal").agg(
        F.count(F.lit(1)).alias("n_unique"), rare.alias("rare_values"), *(e.alias(n) for n, e in _first_round().items())
    )
    spread = settle(spread)
    q = F.col("quartiles")
    spread = _attach(spread, _counted_quartiles(df, facts, freq, spread, by), by)
    spread = settle(spread.select("*", q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3")).drop("quartiles"))

    # Types are known now: only categorical columns have a top list.
    distinct = spread.select(*keys, "ordinal", "n_unique")
    typed = _attach(first, distinct, by).withColumn("n_unique", F.coalesce("n_unique", F.lit(0))).withColumn("kind", _type(facts))
    listed = [r["ordinal"] for r in typed.where("kind = 'categorical'").select("ordinal").distinct().collect()]  # bounded by the schema
    values = freq.drop("v")
    picked = smallest_digests(values, distinct, SAMPLE_VALUES, by).withColumn("list", F.lit("sample"))
    if listed:
        of_listed = [x for x in facts if x.field.ordinal in listed]
        top = first_k(values.where(of_columns(listed)), df, of_listed, TOP_VALUES, by)
        picked = picked.unionByName(top.withColumn("list", F.lit("top")))
    # One scan fetches the texts of both lists.
    full = settle(restore(picked, df, facts, by))
    out = _attach(first, _second_pass(freq, spread, by), by)
    samples = in_order(full.where("list = 'sample'").withColumn("_md5", F.md5("value")), [F.col("_md5")], by)
    out = _attach(out, _listed(samples, by, F.col("value"), "sample_values"), by)
    top = in_order(full.where("list = 'top'"), value_order(), by)
    out = _attach(out, _listed(top, by, F.struct("value", F.col("cnt").alias("count")), "_top"), by)
    out = out.withColumn("n_unique", F.coalesce("n_unique", F.lit(0))).withColumn("inferred_type", _type(facts))
    return quality_flags(_by_type(out, by))


def _by_type(wide: DataFrame, by: Sequence[str]) -> DataFrame:
    """Final column list: statistics of other types blanked out, shares derived."""
    kind = F.col("inferred_type")
    numeric = lambda e: F.when(kind == "numeric", e)
    n = F.col("non_null")
    # A numeric column without numbers has all statistics zero.
    number = lambda c: numeric(F.coalesce(c, F.lit(0.0)))
    whole = lambda c: numeric(F.coalesce(F.col(c).cast("bigint"), F.lit(0)))
    share = lambda c: numeric(percent(F.coalesce(F.col(c).cast("bigint"), F.lit(0)), n))
    categorical = (kind == "categorical") & (n > 0)
    dated = (kind == "datetime") & (n > 0)
    texts = (kind == "text") & (n > 0)
    top = F.transform(
        F.col("_top"),
        lambda t: F.struct(
            t["value"].alias("value"), t["count"].alias("count"), percent(t["count"], n).alias("frequency_pct")
        ),
    )
    return wide.select(
        *[col(k) for k in by],
        "ordinal",
        "name",
        "inferred_type",
        "n_rows",
        "non_null",
        percent(n, F.col("n_rows")).alias("non_null_pct"),
        "n_unique",
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
        number(F.col("mean")).alias("mean"),
        # One value has no deviation.
        numeric(F.when(n == 0, 0.0).otherwise(F.col("std"))).alias("std"),
        number(F.col("min")).alias("min"),
        number(F.col("max")).alias("max"),
        *(number(F.col(c)).alias(c) for c in ("q1", "median", "q3")),
        whole("outliers_count").alias("outliers_count"),
        share("outliers_count").alias("outliers_pct"),
        whole("negative_count").alias("negative_count"),
        share("negative_count").alias("negative_pct"),
        whole("zeros_count").alias("zeros_count"),
        share("zeros_count").alias("zeros_pct"),
        number(F.col("skewness")).alias("skewness"),
        number(F.col("kurtosis")).alias("kurtosis"),
        F.when(categorical, top).alias("top_values"),
        F.when(categorical, F.col("rare_values")).alias("rare_values"),
        F.when(dated, iso(F.col("first"))).alias("min_date"),
        F.when(dated, iso(F.col("last"))).alias("max_date"),
        F.when(dated, elapsed_days(F.col("first"), F.col("last"))).alias("coverage_days"),
        F.when(texts, F.col("avg_length")).alias("avg_length"),
        F.when(texts, percent(F.col("empty_count"), n)).alias("pct_empty"),
        "bytes",
    )


def profile_by(df: DataFrame, keys: Sequence[str], total: bool = False) -> DataFrame:
    """The column profile of every segment, types included, in the same passes.

    ``total=True`` adds the profile of the whole table, with NULL keys, and ``is_total`` to tell it from a segment of NULLs: counts, date ranges and
    frequencies of the segments are added up, so neither is computed from the table again.
    """
    if not keys:
        raise ValueError("profile_by needs at least one key")
    by = tuple(keys)
    if not total:
        return profile_columns(df, by)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    table = normalise(df)
    facts = look(table, by)
    if not facts:
        return profile_columns(df, by).withColumn("is_total", F.lit(False))
    counts = settle(_pass_one(table, facts, by).where("n_rows > 0"))
    freq = counted(frequencies(table, facts, by), facts)
    freq_all = counted(added_up(freq, facts), facts)
    counts_all = settle(merged_counts(counts, ["ordinal", "name"]))
    parts = _profile(table, facts, by, counts, freq).withColumn("is_total", F.lit(False))
    whole = _profile(table, facts, (), counts_all, freq_all).withColumn("is_total", F.lit(True))
    return parts.unionByName(whole.select("*", *(F.lit(None).cast(kinds[k]).alias(k) for k in by)))
