"""Sharding by a two-pass external shuffle: scatter into memory-sized buckets, then shuffle each bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.values import col
from plumbline.llm.common import row_key

SHARDS = 8
SEED = 11
#: Bytes that a bucket holds on average; a task holds one bucket, or the few that fall into its partition.
BUCKET_BYTES = 8 << 20
#: What a row counts besides its text, so that rows without text are dealt to many buckets too.
ROW_BYTES = 128


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard whose seeded hash with the key is highest: one more shard only takes rows into itself."""
    scores = F.array(*(F.xxhash64(F.lit(seed), F.lit(s), key.cast("string")) for s in range(shards)))
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def shard(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shards: int = SHARDS,
    seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """All rows and columns of ``df`` with shard, slot (place in the shard, gapless from 0) and grown_shard.

    First pass: rows are scattered by seeded hashes, the key deciding the shard (law ``key``) and the
    whole row the bucket in it, so that copies of a text spread. Second pass: each bucket, small enough
    for memory, is put in a fixed order and shuffled (Spark's seeded ``shuffle`` is a Fisher-Yates
    shuffle). The buckets of a shard follow one another. A rerun over the same rows with the same number of
    buckets gives the same slots.

    grown_shard is the shard with one more shard. A null key is one key. Null texts count as empty ones. Rows equal
    in all columns share a bucket. A column of ``df`` named as one of the three results is replaced. Columns must be
    comparable (no maps). An empty table gives an empty result.
    """
    results = ("shard", "slot", "grown_shard")
    kept = df.drop(*[c for c in df.columns if c.lower() in results])
    size = df.agg(F.sum(F.coalesce(F.octet_length(col(text)), F.lit(0)).cast("long") + ROW_BYTES)).first()[0] or 0
    buckets = max(1, -(-size // (shards * bucket_bytes)))
    k1, k2 = row_key(df)
    rows = df.select(
        shard_of(col(key), shards, seed).alias("shard"),
        F.pmod(F.xxhash64(F.lit(seed), k1, k2), F.lit(buckets)).alias("bucket"),
        F.struct(
            k1.alias("k1"),
            k2.alias("k2"),
            shard_of(col(key), shards + 1, seed).alias("grown_shard"),
            F.struct(*(col(c) for c in kept.columns)).alias("row"),
        ).alias("item"),
    )
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select(
        F.col("shard").alias("s_"), F.col("bucket").alias("b_"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")
    )
    # An explicit number of partitions stays as it is, and rows in them are sorted: the shuffle's seed
    # counts from the partition's number.
    gathered = rows.repartition(shards * buckets, "shard", "bucket").groupBy("shard", "bucket").agg(F.collect_list("item").alias("items"))
    placed = gathered.join(starts, (F.col("shard") == F.col("s_")) & (F.col("bucket") == F.col("b_")))
    placed = placed.sortWithinPartitions("shard", "bucket")
    dealt = placed.select("shard", "start", F.shuffle(F.sort_array("items"), F.lit(seed)).alias("items"))
    out = dealt.select("shard", "start", F.posexplode("items").alias("pos", "item"))
    return out.select(
        *(F.col("item.row")[c].alias(c) for c in kept.columns),
        "shard",
        (F.col("start") + F.col("pos")).cast("long").alias("slot"),
        F.col("item.grown_shard").alias("grown_shard"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; a file holds whole buckets in the order of their slots."""
    sharded.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
