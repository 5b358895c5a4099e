"""Mergeable profiles: parts merged equal the whole; totals come from segments."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import columns as C
from plumbline.operators.state import merge_states, profile_state, read_state

EXACT = (
    "inferred_type", "n_rows", "non_null", "mean", "std", "min", "max", "negative_count", "zeros_count", "skewness", "kurtosis",
    "min_date", "max_date", "coverage_days", "avg_length", "pct_empty", "bytes",
)


def table(spark, n=2000):
    i = F.col("id")
    return spark.range(n).select(
        "id",
        (F.lit(1e9) + i % 97).alias("far"),
        F.when(i % 3 > 0, (i * 7919 % 1009 - 500).cast("double")).alias("v"),
        F.lit(4.5).alias("constant"),
        F.lit(None).cast("double").alias("never"),
        F.concat(F.lit("2023-01-"), F.lpad((i % 28 + 1).cast("string"), 2, "0")).alias("day"),
        (i % 50).cast("string").alias("digits"),
        F.when(i % 2 == 0, "").otherwise(F.concat(F.lit("text "), i.cast("string"))).alias("text"),
        (i % 3 == 0).alias("flag"),
        F.timestamp_seconds(i * 3600).alias("ts"),
        F.when(i < n / 2, i.cast("string")).otherwise(F.concat(F.lit("x"), i.cast("string"))).alias("half"),
    )


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9)
    return a == b


def compare(got, want, names):
    got, want = {r.name: r for r in got}, {r.name: r for r in want}
    assert set(got) == set(want)
    for c in want:
        for k in names:
            assert same(got[c][k], want[c][k]), (c, k, got[c][k], want[c][k])


@pytest.mark.parametrize("parts", [3])
def test_merged_parts_equal_the_whole_and_the_profile(spark, tmp_path, parts):
    df = table(spark)
    # Each part is profiled by itself, in ranges, and its state kept as a file.
    for k in range(parts):
        part = df.where(F.floor(F.col("id") * parts / 2000) == k)
        profile_state(part).write.mode("append").parquet(str(tmp_path / "states"))
    merged = read_state(merge_states(spark.read.parquet(str(tmp_path / "states")))).collect()
    compare(merged, read_state(profile_state(df)).collect(), EXACT)
    exact = C.profile_columns(df).collect()
    compare(merged, exact, EXACT)
    for got in merged:
        want = next(r for r in exact if r.name == got.name)
        assert abs(got.n_unique - want.n_unique) <= 0.06 * want.n_unique
        if want.inferred_type == "numeric" and want.non_null:
            v = np.sort([float(r[0]) for r in df.select(got.name).collect() if r[0] is not None])
            for q, p in ((got.q1, 0.25), (got.median, 0.5), (got.q3, 0.75)):
                assert np.searchsorted(v, q, "left") / len(v) - 0.01 <= p <= np.searchsorted(v, q, "right") / len(v) + 0.01


def test_states_by_segment_and_their_total(spark):
    df = table(spark).withColumn("s", F.when(F.col("id") % 5 == 0, "a").when(F.col("id") % 5 == 1, "b"))
    states = profile_state(df, ["s"])
    segments = read_state(states, ["s"]).collect()
    exact = C.profile_by(df, ["s"]).collect()
    for s in ("a", "b", None):
        compare([r for r in segments if r.s == s], [r for r in exact if r.s == s], EXACT)
    compare(read_state(merge_states(states)).collect(), C.profile_columns(df.drop("s")).collect(), EXACT)
    # A second merge of what was merged before changes nothing.
    compare(read_state(merge_states(merge_states(states, ["s"]))).collect(), read_state(merge_states(states)).collect(), EXACT)


def test_profile_without_exact_values(spark):
    compare(C.profile_columns(table(spark), exact=False).collect(), C.profile_columns(table(spark)).collect(), EXACT)
    assert C.profile_columns(table(spark, 0), exact=False).count() == 0


def test_a_state_reads_the_table_twice_and_moves_no_values(spark):
    from tests.test_scale import counted

    df, scans = counted(spark, table(spark, 500))
    assert profile_state(df).count() == 11 and scans() <= 5


def test_total_equals_the_profile_of_the_whole(spark):
    df = table(spark).withColumn("s", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 5 == 1, "b"))
    got = C.profile_by(df, ["s"], total=True).collect()
    segments, whole = [r for r in got if not r.is_total], [r for r in got if r.is_total]
    names = [c for c in C.profile_columns(df).columns if c != "ordinal"]
    compare(whole, C.profile_columns(df.drop("s")).collect(), names)
    exact = C.profile_by(df, ["s"]).collect()
    for s in ("a", "b", None):
        compare([r for r in segments if r.s == s], [r for r in exact if r.s == s], names)
