"""The paths that large tables take, forced on small ones, with one key holding a third of the rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.coerce import DATE_START, to_datetime
from plumbline.operators import columns as C
from plumbline.operators import correlation
from plumbline.operators import frequency
from plumbline.operators import selection as S
from plumbline.operators.correlation import correlations
from plumbline.operators.distribution import missing_raster
from plumbline.operators.frequency import frequencies
from plumbline.operators.quantiles import counted_quantiles, select_quantiles
from plumbline.operators.ranking import global_rank
from plumbline.operators.types import look
from plumbline.plans.report import exploration_digest
from plumbline.session import settle


def skewed(spark, n=3000):
    """A third of the rows share one key and one value."""
    hot = F.col("id") % 3 == 0
    return spark.range(n).select(
        "id",
        F.when(hot, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("k"),
        F.when(hot, 7.0).otherwise((F.col("id") * 7919 % 1009).cast("double") / 4).alias("v"),
        F.when(F.col("id") % 5 > 0, F.col("id") * F.col("id")).alias("w"),
    )


@pytest.fixture()
def large(monkeypatch):
    """Few values may be sorted, and sketches are coarse: bounds are narrowed down, and missed at times."""
    monkeypatch.setattr("plumbline.operators.quantiles.SORTED_ROWS", 4)
    monkeypatch.setattr("plumbline.operators.quantiles.SKETCH_K", 12)
    monkeypatch.setattr("plumbline.operators.quantiles.BROADCAST_ROWS", 0)


def test_selected_quartiles_equal_numpy(spark, large):
    df = skewed(spark)
    got = {r.name: (r.q1, r.median, r.q3) for r in C.quartiles(df).collect()}
    pdf = df.toPandas()
    for c in ("id", "v", "w"):
        assert np.allclose(got[c], np.quantile(pdf[c].dropna(), [0.25, 0.5, 0.75]))


def test_any_probabilities_and_few_values(spark):
    rows = [("a", float(i % 7)) for i in range(1000)] + [("b", 2.0), (None, 1.0), (None, 4.0), ("c", None)]
    df = spark.createDataFrame(rows, "s string, v double")
    ps = [0.9, 0.0, 0.31, 1.0]
    got = {r.s: r.quartiles for r in select_quantiles(df, [(0, F.col("v"))], ["s"], ps, sorted_rows=1).collect()}
    assert set(got) == {"a", "b", None}
    for s in got:
        assert np.allclose(got[s], np.quantile([v for k, v in rows if k == s], ps))
    whole = select_quantiles(df, [(3, F.col("v")), (5, F.col("v") * 0)], (), ps, sorted_rows=1).collect()
    assert {r.ordinal for r in whole} == {3, 5}
    assert np.allclose(next(r for r in whole if r.ordinal == 3).quartiles, np.quantile([v for _, v in rows if v is not None], ps))


def test_bounds_hold_a_small_part_of_the_table(spark, monkeypatch):
    """Of a million distinct values a few hundredths are kept by value; the rest are counts per stretch."""
    kept = []
    monkeypatch.setattr("plumbline.operators.quantiles.settle", lambda d: kept.append(settle(d)) or kept[-1])
    df = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_003).cast("double").alias("v"))
    got = select_quantiles(df, [(0, F.col("v"))], sorted_rows=40_000).first().quartiles
    assert np.allclose(got, np.quantile(np.arange(1_000_000, dtype=np.int64) * 7919 % 1_000_003, [0.25, 0.5, 0.75]))
    first = kept[0].first()
    assert first.left1 < 40_000 and first.hi1 - first.lo1 < 60_000


def test_narrowed_profile_equals_direct(spark, monkeypatch):
    df = skewed(spark)
    direct = {r.name: r for r in C.profile_columns(df).collect()}
    monkeypatch.setattr("plumbline.operators.quantiles.SORTED_ROWS", 30)
    assert {r.name: r for r in C.profile_columns(df).collect()} == direct


def test_segments_equal_separate_profiles(spark, large):
    df = skewed(spark).withColumn("s", F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 3 == 1, "b"))
    got = {(r.s, r.name): r.asDict() for r in C.profile_by(df, ["s"]).collect()}
    for s in ("big", "b", None):
        part = df.where(F.col("s").eqNullSafe(s)).drop("s")
        for r in C.profile_columns(part).collect():
            want, have = r.asDict(), got[(s, r.name)]
            for c in want:
                if c != "ordinal":
                    assert have[c] == want[c] or np.isclose(have[c], want[c]), (s, r.name, c)


def test_types_are_decided_per_segment(spark):
    rows = [("n", str(i)) for i in range(60)] + [("d", f"2023-01-{i % 28 + 1:02d}") for i in range(60)] + [("t", f"w{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "s string, x string")
    got = {r.s: (r.inferred_type, r.mean, r.coverage_days) for r in C.profile_by(df, ["s"]).collect()}
    assert got == {"n": ("numeric", 29.5, None), "d": ("datetime", None, 27), "t": ("text", None, None)}


def test_sample_is_the_smallest_hashes(spark):
    df = spark.range(5000)
    want = sorted(range(5000), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())
    for n in (1, 3, 700, 5000, 9000):
        assert sorted(r.id for r in S.sample_rows(df, n, "id").collect()) == sorted(want[:n])


def test_hot_segment_is_spread_over_tasks(spark, monkeypatch):
    """One segment holds 90 % of the rows, all distinct: no task of the join gets more than a few shares of it."""
    df = spark.range(40_000).select("id", F.when(F.col("id") % 10 > 0, "hot").otherwise("cold").alias("s"), (F.col("id") * 3).alias("v"))
    facts = look(df, ["s"])
    freq = frequencies(df, facts, ["s"])
    right = df.groupBy("s").agg(F.lit(0).alias("ordinal"), F.max("v").alias("m"))
    right = right.unionByName(right.withColumn("ordinal", F.lit(2)))
    monkeypatch.setattr("plumbline.operators.quantiles.BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.shuffle.partitions", 32)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        sizes = C._beside(freq, right, ["s"]).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", True)
    assert sum(r["count"] for r in sizes) == 80_000
    assert max(r["count"] for r in sizes) < 80_000 / 6


def test_global_rank(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 10007).alias("k"))
    got = [(r["rank"], r.k) for r in global_rank(df, [F.col("k")], 9).orderBy("rank").collect()]
    keys = sorted(i * 7919 % 10007 for i in range(1000))
    assert got == list(enumerate(keys, 1))


def test_raster_of_sparse_key_equals_dense(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 7 > 2, 1).alias("x"))
    dense = missing_raster(df, "id", 13).orderBy("band", "name").collect()
    sparse = missing_raster(df.withColumn("id", F.col("id") * 11), "id", 13).orderBy("band", "name").collect()
    assert dense == sparse


def counted(spark, df):
    """The table, and a function that tells how often it has been read."""
    seen, n = spark.sparkContext.accumulator(0), df.count()

    def note(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    return df.mapInPandas(note, df.schema), lambda: seen.value / n


def test_scans(spark):
    """However much is derived, the table is read a few times only."""
    df, scans = counted(spark, skewed(spark))
    assert C.profile_columns(df).count() == 4
    # Facts, cheap counts, frequencies, and three for the quartiles, which move no table.
    assert scans() <= 6
    df, scans = counted(spark, skewed(spark))
    assert "Correlated" in exploration_digest(df.withColumn("u", F.col("v") * 2)).first().digest
    assert scans() < 10


def test_many_columns_correlate_in_blocks(spark, monkeypatch):
    wide = spark.range(0, 200, 1, 3).select(*(((F.col("id") * (k + 3)) % (17 + k)).cast("double").alias(f"c{k}") for k in range(200)))
    df, scans = counted(spark, wide.withColumn("c7", F.when(F.col("c0") > 3, F.col("c7"))))
    got = {(r.column1, r.column2): r.correlation for r in correlations(df).collect()}
    assert len(got) == 199 * 100 and scans() <= 8  # the means take a scan per 100 expressions
    pdf = wide.toPandas()
    assert np.isclose(got["c3", "c150"], pdf.c3.corr(pdf.c150))
    pdf.loc[pdf.c0 <= 3, "c7"] = np.nan
    assert np.isclose(got["c7", "c50"], pdf.c7.corr(pdf.c50))
    monkeypatch.setattr("plumbline.operators.correlation.BLOCK", 64)
    blocks = {(r.column1, r.column2): r.correlation for r in correlations(df).collect()}
    assert set(blocks) == set(got) and all(a == blocks[k] or np.isclose(a, blocks[k]) for k, a in got.items())


def test_a_task_gives_one_row_per_pair_of_columns(spark):
    df = spark.range(0, 5000, 1, 4).select(*((F.col("id") * (k + 3) % 101).cast("double").alias(f"c{k}") for k in range(500)))
    sums = correlation._sums(df, [], [F.col(c) for c in df.columns])
    seen = spark.sparkContext.accumulator(0)

    def note(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    parts = [df.select(*df.columns[:256]).mapInArrow(correlation._gram(0, 256, 0, 10**9), "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")]
    assert parts[0].mapInPandas(note, parts[0].schema).count() == seen.value == 4 * 256 * 255 // 2
    assert sums.count() == 500 * 499 // 2


def test_correlations_per_segment_with_gaps_and_infinities(spark, monkeypatch):
    monkeypatch.setattr("plumbline.operators.correlation.HELD_VALUES", 100)
    df = skewed(spark).select("k", "v", "w", F.when(F.col("id") == 7, float("inf")).otherwise((F.col("id") % 13).cast("double")).alias("x"))
    df = df.withColumn("w", F.when(F.col("x") != float("inf"), F.col("w")))
    got = {(r.k, r.column1, r.column2): r.correlation for r in correlations(df, by=["k"]).collect()}
    pdf = df.toPandas()
    for k, part in pdf.groupby("k"):
        for a, b in (("v", "w"), ("w", "x")):
            both = part[[a, b]].dropna()
            want = both[a].corr(both[b]) if both[a].nunique() > 1 and both[b].nunique() > 1 else None
            assert got.get((k, a, b)) is None if want is None else np.isclose(got[k, a, b], want), (k, a, b)


def test_scan_reads_only_wanted_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    skewed(spark).write.parquet(path)
    plan = C.numeric_moments(spark.read.parquet(path), ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<v:double>" in plan


def test_unique_values_with_a_long_common_prefix(spark, monkeypatch):
    """10^5 different texts share 80 characters, others 400: longer prefixes decide, no task holds the texts of a class."""
    start, deep = "https://example.org/" + "x" * 60, "y" * 400
    n = 100_000
    texts = F.when(F.col("id") < n, F.concat(F.lit(start), F.lpad((F.col("id") * 7919 % 1_000_003).cast("string"), 7, "0")))
    df = spark.range(n + 40).select(
        "id",
        texts.otherwise(F.concat(F.lit(deep), (F.col("id") % 10).cast("string"))).alias("url"),
        F.when(F.col("id") < n, F.lit(start[:64])).otherwise(F.lit(start)).alias("two"),
    )
    kept = []
    monkeypatch.setattr(frequency, "settle", lambda d: kept.append(settle(d)) or kept[-1])
    got = {(r.name, r["rank"]): (r.value, r["count"]) for r in frequency.top_values(df, 12, ["url", "two"]).collect()}
    rest = sorted(start + f"{i * 7919 % 1_000_003:07d}" for i in range(n))[:2]
    want = [(deep + str(d), 4) for d in range(10)] + [(v, 1) for v in rest]
    assert [got["url", k + 1] for k in range(12)] == want
    assert [got["two", k] for k in (1, 2)] == [(start[:64], n), (start, 40)]
    # The frequency table comes first; of all that follows, nothing is longer than k + 1 rows per column.
    assert all(d.count() <= 13 * 2 for d in kept[1:])
    falling = frequency.most_frequent(kept[0], df, [x for x in look(df) if x.field.name != "id"], 3, descending=False)
    assert [r.value for r in falling.where("ordinal = 1").orderBy("rank").collect()] == sorted((start + f"{i * 7919 % 1_000_003:07d}" for i in range(n)), reverse=True)[:3]


@pytest.mark.parametrize("key", ["id", "id * 11 - 70000", "cast(id as double) * 0.37", "timestamp_seconds(id * 977)", "pow(1.01, id)", "concat('k', lpad(id, 6, '0'))"])
def test_raster_borders_are_refined(spark, monkeypatch, key):
    """Few keys may be ranked and few bins counted: pieces are divided again and again."""
    monkeypatch.setattr("plumbline.operators.distribution.RANKED_KEYS", 20)
    monkeypatch.setattr("plumbline.operators.distribution.BORDER_BINS", 60)
    n = 1000
    df = spark.range(n).select(F.expr(key).alias("k"), F.when(F.col("id") % 7 > 2, 1).alias("x"))
    got = {(r.band, r.name): r.null_rate for r in missing_raster(df, "k", 13).collect()}
    for band in range(13):
        rows = [i for i in range(n) if i * 13 // n == band]
        assert np.isclose(got[band, "x"], sum(i % 7 <= 2 for i in rows) / len(rows))
    assert len(got) == 26


def test_raster_of_few_rows(spark):
    df = spark.range(3).select("id", F.when(F.col("id") > 0, 1).alias("x"))
    assert sorted((r.band, r.name, r.null_rate) for r in missing_raster(df, "id", 100).collect()) == [
        (0, "id", 0.0), (0, "x", 1.0), (33, "id", 0.0), (33, "x", 0.0), (66, "id", 0.0), (66, "x", 0.0),
    ]


def test_profile_selects_quartiles_from_counts(spark, monkeypatch):
    """No scan of the table besides the counts: text is parsed once a value, whatever the ranks need."""
    monkeypatch.setattr(C, "select_quantiles", lambda *a: pytest.fail("the table is scanned for quartiles"))
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(50, 20, 900), 1)
    df = spark.createDataFrame([("ab"[i % 2], str(x), float(x)) for i, x in enumerate(v)], "s string, t string, x double")
    for r in C.profile_by(df, ["s"], total=True).collect():
        want = np.quantile(v if r.is_total else v["ab".index(r.s) :: 2], (0.25, 0.5, 0.75)) if r.name != "s" else None
        assert want is None or np.allclose([r.q1, r.median, r.q3], want)


def test_long_numbers_keep_their_quartiles(spark):
    """Of texts of more than 64 characters the counts know a digest only."""
    df = spark.createDataFrame([("0" * 70 + str(k),) for k in range(9)] + [(None,)], "t string")
    r = C.profile_columns(df).first()
    assert (r.inferred_type, r.q1, r.median, r.q3) == ("numeric", 2.0, 4.0, 6.0)


@pytest.mark.parametrize("limit", [0, 7, 100_000])
@pytest.mark.filterwarnings("ignore:invalid value")
def test_counted_quantiles(spark, limit):
    """Outliers, magnitudes, infinities and skewed counts, told apart by buckets, by sorting or both; segments may be null."""
    rng = np.random.default_rng(5)
    big = 1.7976931348623157e308
    groups = {
        "a": rng.normal(size=200), None: np.exp(rng.normal(0, 100, 200)), "b": np.array([1.0] * 50 + [1e300, -1e300]), "c": np.array([7.0]),
        "d": np.array([5e-324, 0.0, 1e-323, -5e-324]), "e": np.r_[rng.integers(0, 5, 60), 1e308, -1e308, big, -big].astype(float), "f": np.array([1.0, 2.0]),
        "g": np.array([-np.inf, -1.0, 0.5, 2.0, np.inf]),
    }
    ps, rows, want = (0.5, 0.1, 0.9), [], {}
    for s, x in groups.items():
        n = rng.choice([1, 1, 2, 90], len(x))
        rows += [(s, 0, float(v), int(k)) for v, k in zip(x, n)] + [(s, 1, float(x[0]), 3), (s, 2, None, 3)]
        all_ = np.sort(np.repeat(x, n))
        at = [p * (len(all_) - 1) for p in ps]
        want[s, 0] = [all_[int(a)] + (all_[int(np.ceil(a))] - all_[int(a)]) * (a % 1) for a in at]
        want[s, 1] = [x[0] + (x[0] - x[0])] * 3
    df = spark.createDataFrame(rows, "s string, ordinal int, v double, cnt long")
    got = {(r.s, r.ordinal): r.quartiles for r in counted_quantiles(df, ["s"], ps, limit).collect()}
    assert got.keys() == want.keys()
    for k, q in want.items():
        assert np.allclose(got[k], q, rtol=1e-12, atol=0, equal_nan=True), k


def test_samples_are_looked_for_among_small_digests(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id", "id % 2 AS few", "concat('t', id) AS t")
    sizes = []
    ranked = frequency.ranked
    monkeypatch.setattr(frequency, "ranked", lambda freq, *a: sizes.append(freq.count()) or ranked(freq, *a))
    want = [sorted(map(str, v), key=lambda x: hashlib.md5(x.encode()).hexdigest())[:3] for v in (range(3000), range(2), [f"t{k}" for k in range(3000)])]
    take = lambda: [r.sample_values for r in C.profile_columns(df).orderBy("ordinal").collect()]
    assert take() == want and len(sizes) == 1 and sizes[0] < 400
    # Too few below the bound: all are sorted.
    monkeypatch.setattr(frequency, "SAMPLED", 1e-9)
    assert take() == want and len(sizes) == 3


def test_dates_are_tried_where_they_may_be(spark):
    """Days and years of the range keep their layouts; keys of eight digits are tried for none."""
    dates = ["19990131", "2000", "1678", "2261", "Mar 3, 2001", "3 Mar 2001", "1/2/2003", "2003/01/02", "2003-01", "2003-01-02T03:04:05Z", "2003-01-02 03:04"]
    others = ["19991331", "19990132", "19990100", "12345678", "1234567", "12.5", " 2000", "x", "123-"]
    df = spark.createDataFrame([(v,) for v in dates + others], "v string")
    for r in df.select("v", F.col("v").rlike(DATE_START).alias("tried"), to_datetime(F.col("v")).alias("ts")).collect():
        assert (r.ts is not None) == (r.v in dates) and (r.tried or r.v in others), r
        assert not r.tried or r.v in dates or r.v == "123-", r
    for v in dates + others:
        assert bool(look(spark.createDataFrame([(v,)], "v string"))[0].formats) == (v in dates), v
