from pyspark.sql import functions as F

from plumbline.llm import sharding

ROWS = [(k, f"text {k % 40} " * (k % 7)) for k in range(600)] + [(None, "a"), (None, None), (5, "twice"), (5, "twice"), (700, "long " * 50_000)]


def result(df, **options):
    return [(r.shard, r.slot, r.doc_id, r.text, r.grown_shard) for r in sharding.shard(df, **options).collect()]


def test_slots_and_law(make):
    for bytes_ in (sharding.BUCKET_BYTES, 500):
        got = result(make(ROWS), bucket_bytes=bytes_)
        assert sorted(map(str, ((i, t) for _, _, i, t, _ in got))) == sorted(map(str, ROWS))
        for s in range(8):
            assert sorted(g[1] for g in got if g[0] == s) == list(range(sum(g[0] == s for g in got)))
        place = {}
        for s, _, i, _, grown in got:
            assert place.setdefault(i, s) == s and grown in (s, 8)
        assert 30 < sum(g[4] == 8 for g in got) < 110
        assert sorted(map(str, result(make(ROWS[::-1]), bucket_bytes=bytes_))) == sorted(map(str, got))


def test_grown_shard_is_the_next_one(make):
    small = {g[2]: g[4] for g in result(make(ROWS))}
    large = {g[2]: g[0] for g in result(make(ROWS), shards=9)}
    assert small == large


def test_order_is_shuffled(make):
    got = sorted(g for g in result(make(ROWS)) if g[0] == 0 and g[2] is not None)
    ids = [g[2] for g in got]
    runs = sum(a < b for a, b in zip(ids, ids[1:]))
    assert 0.3 * len(ids) < runs < 0.7 * len(ids)


def test_columns_and_empty(make):
    df = make(ROWS[:5])
    out = sharding.shard(df)
    assert out.columns == [c for c in df.columns if c != "shard"] + ["shard", "slot", "grown_shard"]
    assert {r.shard for r in out.collect()} <= set(range(8))
    assert sharding.shard(make([])).collect() == []


def test_files(make, tmp_path):
    sharded = sharding.shard(make(ROWS))
    sharding.write_shards(sharded, str(tmp_path / "out"))
    back = make([]).sparkSession.read.parquet(str(tmp_path / "out"))
    assert sorted((r.shard, r.slot, str(r.doc_id)) for r in back.collect()) == sorted((g[0], g[1], str(g[2])) for g in result(make(ROWS)))


def test_rows_without_text_are_dealt_to_many_buckets(spark, make):
    # Buckets that fit a broadcast are not worth dealing; here none may be.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = sharding.shard(make([(k, None if k % 2 else "") for k in range(800)]), bucket_bytes=1024)
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 800 and max(sizes) < 80


def test_shards_by_plain_hashes(spark, make):
    """Each row's shard and grown shard, from the hashes of its key one by one."""
    ids = [*range(60), 2**40, -5]
    got = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.shard(make([(k, f"text {k}") for k in ids])).collect()}
    hashes = {}
    for s in range(sharding.SHARDS + 1):
        df = spark.createDataFrame([(k, str(k)) for k in ids], "k long, t string")
        for r in df.select("k", F.xxhash64(F.lit(sharding.SEED), F.lit(s), "t").alias("h")).collect():
            hashes.setdefault(r.k, []).append(r.h)
    for k in ids:
        h = hashes[k]
        assert got[k] == (h.index(max(h[:-1])), h.index(max(h)))
