"""Column profile on literal columns, with the values the reference's own tests expect."""

import datetime as dt
import math

import pytest

from plumbline.operators.columns import profile_columns, quartiles, skewness
from plumbline.operators.correlation import correlations
from plumbline.operators.dataset import duplicate_rows, profile
from plumbline.operators.frequency import n_unique, top_values
from plumbline.operators.selection import select_columns
from plumbline.operators.types import infer_types


def test_table_without_columns(spark):
    p = profile(spark.createDataFrame([(1,)], "a int").select(), "none")
    assert p.columns.collect() == [] and p.dataset.first().n_cols == 0
    assert p.completeness.first().completeness_pct == 100.0 and p.correlations.collect() == []


def test_profile_keeps_correlations_per_segment(spark):
    rows = [(s, float(i), float(i * (1 if s == "a" else -1))) for s in "ab" for i in range(20)]
    p = profile(spark.createDataFrame(rows, "s string, x double, y double"), by=["s"])
    assert {(r.dataset, round(r.correlation, 6)) for r in p.correlations.collect()} == {("a", 1.0), ("b", -1.0)}


def test_tiny_spreads_are_flat_everywhere(spark):
    df = spark.createDataFrame([(v,) for v in (1e-9, 1e-9, 1e-9, 5e-9)], "x double")
    assert skewness(df).first().skewness == profile_columns(df).first().skewness == 0.0


def column(spark, values, kind):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return profile_columns(df).first()


def test_numeric_block(spark):
    p = column(spark, [1, 2, 3, 4, 5], "int")
    assert (p.inferred_type, p.min, p.max, p.mean, p.q1, p.median, p.q3) == ("numeric", 1, 5, 3, 2, 3, 4)
    assert round(p.std, 2) == 1.58
    assert column(spark, [1, 2, 3, 4, 5, 100], "int").outliers_count == 1
    assert column(spark, [-2, -1, 0, 1, 2], "int").negative_count == 2
    assert column(spark, [0, 0, 1, 2, 3], "int").zeros_pct == 40.0


def test_moments_match_pandas(spark):
    import pandas as pd

    values = [0.1, 0.5, 2.5, 3.25, 100.0, -7.0, 3.25]
    s = pd.Series(values)
    p = column(spark, values, "double")
    assert math.isclose(p.skewness, s.skew(), rel_tol=1e-9)
    assert math.isclose(p.kurtosis, s.kurt(), rel_tol=1e-9)
    assert math.isclose(p.std, s.std(), rel_tol=1e-9)


def test_few_or_equal_numbers(spark):
    one = column(spark, [7], "int")
    assert (one.std, one.skewness, one.kurtosis, one.outliers_count) == (None, 0.0, 0.0, 0)
    flat = column(spark, [0.1] * 9, "double")
    assert (flat.skewness, flat.kurtosis, flat.outliers_count) == (0.0, 0.0, 0)
    none = column(spark, [None, None], "double")
    assert (none.inferred_type, none.mean, none.std, none.outliers_count, none.n_unique) == ("numeric", 0.0, 0.0, 0, 0)


def test_nan_is_missing(spark):
    p = column(spark, [1.0, float("nan"), 3.0, None], "double")
    assert (p.non_null, p.n_unique, p.mean, p.max) == (2, 2, 2.0, 3.0)


def test_categorical_block(spark):
    p = column(spark, list("ABACAB"), "string")
    assert p.inferred_type == "categorical"
    assert tuple(p.top_values[0]) == ("A", 3, 50.0)
    assert column(spark, ["Common"] * 198 + ["Rare1", "Rare2"], "string").rare_values == 2


def test_datetime_block(spark):
    days = [dt.datetime(2023, 1, 1) + dt.timedelta(days=i) for i in range(10)]
    p = column(spark, days, "timestamp")
    assert (p.inferred_type, p.min_date, p.coverage_days) == ("datetime", "2023-01-01T00:00:00", 9)
    p = column(spark, ["2023-01-01", "2023-01-10"], "string")
    assert (p.inferred_type, p.coverage_days) == ("datetime", 9)


def test_text_block(spark):
    many = [f"Text entry {i}" for i in range(100)]
    p = column(spark, many, "string")
    assert (p.inferred_type, p.quality_issues) == ("text", ["likely_id"])
    p = column(spark, many + [""] * 150, "string")
    assert p.pct_empty == 60.0 and "mostly_empty" in p.quality_issues


@pytest.mark.parametrize(
    "values,kind,expected",
    [
        (["1", "2", "3", "4", "5"], "string", "numeric"),
        ([f"Text entry {i}" for i in range(100)], "string", "text"),
        (["A", "B", "C"] * 20, "string", "categorical"),
        (["2023-01-01", "2023-01-02"], "string", "datetime"),
        (["2023-01-01", "2023/01/02"] + [f"x{i}" for i in range(60)], "string", "text"),
        (["2023", "1999"], "string", "datetime"),
        (["1234", "5"], "string", "numeric"),
        (["1d", "2"], "string", "categorical"),
        ([True, None, False], "boolean", "categorical"),
        ([None, None], "string", "numeric"),
    ],
)
def test_types(spark, values, kind, expected):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    assert infer_types(df).first().inferred_type == expected


def test_flags(spark):
    assert "high_missing" in column(spark, [1, 2, None, None, None], "int").quality_issues
    assert "high_missing" not in column(spark, [1, 2, 3, 4, None], "int").quality_issues  # exactly 80%
    assert "likely_id" in column(spark, [f"ID_{i}" for i in range(10)], "string").quality_issues


def test_nested_columns_are_text(spark):
    df = spark.createDataFrame([([1, 2], {"a": 1}), ([1, 2], {"a": 2}), (None, None)], "xs array<int>, m map<string,int>")
    got = {r.name: (r.inferred_type, r.n_unique, r.non_null) for r in profile_columns(df).collect()}
    assert got == {"xs": ("text", 1, 2), "m": ("text", 2, 2)}


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "`a.b` int, `c ``d` string")
    assert [r.name for r in profile_columns(df).orderBy("ordinal").collect()] == ["a.b", "c `d"]


def test_dataset(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (1, "x")], "a int, b string")
    assert round(duplicate_rows(df).first().duplicate_rows_pct, 2) == 33.33
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0), (4, None), (5, 5.0)], "complete int, partial double")
    p = profile(df, "d")
    assert [(m.name, m.missing_count, m.missing_pct) for m in p.missing.collect()] == [("partial", 2, 40.0)]
    assert p.completeness.first().completeness_pct == 80.0
    row = p.dataset.first()
    assert (row.n_rows, row.n_cols, row.n_numeric, row.duplicate_rows_pct) == (5, 2, 2, 0.0)


def test_duplicates_tell_null_positions_apart(spark):
    df = spark.createDataFrame([(None, 5), (5, None), (None, 5)], "a int, b int")
    assert duplicate_rows(df).first().duplicate_rows == 1


def test_empty_table(spark):
    p = profile(spark.createDataFrame([], "a int, b string"), "none")
    assert p.columns.count() == 0
    row = p.dataset.first()
    assert (row.n_rows, row.n_cols, row.duplicate_rows_pct) == (0, 0, 0.0)
    assert p.completeness.first().completeness_pct == 100.0


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1, 2, 7), (2, 4, 7), (3, 6, 7)], "a int, b int, k int")
    got = {(r.column1, r.column2): r.correlation for r in correlations(df).collect()}
    assert round(got[("a", "b")], 9) == 1.0 and got[("a", "k")] is None


def test_unknown_columns_are_named(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError, match="c, d"):
        select_columns(df, "a, c, d")


def test_long_values_keep_apart_and_come_back_whole(spark):
    head = "same beginning " * 20
    rows = [(head + "one",)] * 5 + [(head + "two",)] * 3 + [("short",)] * 2
    df = spark.createDataFrame(rows, "x string")
    assert n_unique(df).first().n_unique == 3
    got = [(r.value, r["count"]) for r in top_values(df).orderBy("rank").collect()]
    assert got == [(head + "one", 5), (head + "two", 3), ("short", 2)]


def test_large_integers_stay_distinct(spark):
    df = spark.createDataFrame([(2**53,), (2**53 + 1,)], "x bigint")
    assert n_unique(df).first().n_unique == 2


def test_quartiles_without_numbers(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert tuple(quartiles(df).first())[1:] == (0.0, 0.0, 0.0)
