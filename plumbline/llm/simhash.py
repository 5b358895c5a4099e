"""Near duplicates by SimHash, found at the anchor points of a covering code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.values import col
from plumbline.llm.common import row_key
from plumbline.session import settle

HASH_SEED = 42
MAX_BITS = 3
SHINGLE_WORDS = 3
#: Anchors that are home to more fingerprints than this are divided further.
SPLIT_ABOVE = 4096
SMALL_RUN = 32
COUNTED_AT_ONCE = 1 << 15

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, n: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a text as a signed long; no words give zero."""
    # bytes.split() parts at exactly the six ASCII separators.
    words = text.encode("utf-8", "replace").translate(LOWER).split() if text else []
    if not words:
        return 0
    shingles = [b" ".join(s) for s in zip(*(words[i:] for i in range(n)), strict=False)] or [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, HASH_SEED) for s in shingles), np.uint64, len(shingles))
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), COUNTED_AT_ONCE):
        part = hashes[k : k + COUNTED_AT_ONCE]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint_udf(n: int):
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, n) for t in texts], dtype="int64")

    return of


# Anchor points. A fingerprint is two halves of 32 bits. The anchors of a half are the
# codewords of the Hamming code on its low 31 bits, with either value of the last bit: a
# covering code of radius 1, in which every point has one nearest anchor (its home).
# Fingerprints within 3 bits differ by at most 1 in one half; there, the second lies within
# 1 + 1 of the first one's home. So each fingerprint goes to every anchor within 2 of a half.
PARITY = [sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)]
SYNDROME = " + ".join(f"shiftleft(bit_count(h & {m}L) & 1, {k})" for k, m in enumerate(PARITY))


def anchors(nodes: DataFrame) -> DataFrame:
    """(anchor, fp, home) for each half of each fingerprint."""
    halves = nodes.select(
        "fp", F.expr("inline(array(struct(0L as half, fp & 4294967295L as h), struct(1L as half, shiftrightunsigned(fp, 32) as h)))")
    )
    coded = halves.withColumn("s", F.expr(SYNDROME)).withColumn(
        "home", F.expr("if(s = 0, h, h ^ shiftleft(1L, cast(s - 1 as int)))")
    )
    near = F.expr(
        "transform(filter(sequence(1, 31), i -> s > 0 and (i ^ s) > i),"
        " i -> h ^ shiftleft(1L, cast(i - 1 as int)) ^ shiftleft(1L, cast((i ^ s) - 1 as int)))"
    )
    every = F.concat(F.array("home"), near, F.array(F.expr("home ^ shiftleft(1L, 31)")))
    at = coded.select("half", "fp", "home", F.explode(every).alias("a"))
    return at.select(
        F.expr("half * 4294967296L + a").alias("anchor"), "fp", (F.col("a") == F.col("home")).alias("home")
    )


def divided(members: DataFrame, limit: int) -> DataFrame:
    """Adds ``part``: fingerprints at crowded anchors meet only where a byte of the other half is equal too.

    The other half differs by at most 3 bits, so one of its 4 bytes is equal:
    each pair still meets at least once.
    """
    crowded = settle(members.where("home").groupBy("anchor").count().where(F.col("count") > limit).select("anchor"))
    if crowded.isEmpty():
        return members.withColumn("part", F.lit(0))
    marked = members.join(crowded.withColumn("crowded", F.lit(True)), "anchor", "left")
    other = "if(anchor >= 4294967296L, fp, shiftrightunsigned(fp, 32))"
    parts = F.expr(
        f"if(crowded, transform(sequence(0, 3), b -> cast(b * 256 + (shiftrightunsigned({other}, b * 8) & 255) as int)), array(0))"
    )
    return marked.select("anchor", "fp", "home", F.explode(parts).alias("part"))


def forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside one run: fewer rows out than rows in."""
    left, right = [], []
    rest = np.unique(fps)
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= max_bits
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), x))
                right.append(found)
                queue.extend(found)
                rest = rest[~near]
    none = np.empty(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def run_links(key: np.ndarray, fp: np.ndarray, home: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each run of equal keys."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    useful = (sizes > 1) & (np.add.reduceat(home, starts) > 0)
    left, right = [], []
    for s, n in zip(starts[useful & (sizes > SMALL_RUN)], sizes[useful & (sizes > SMALL_RUN)], strict=True):
        a, b = forest(fp[s : s + n], max_bits)
        left.append(a)
        right.append(b)
    small = np.repeat(useful & (sizes <= SMALL_RUN), sizes)
    key, fp = key[small], fp[small]
    for k in range(1, SMALL_RUN):
        same = key[k:] == key[:-k] if len(key) > k else np.zeros(0, bool)
        if not same.any():
            break
        near = same & (np.bitwise_count(fp[k:] ^ fp[: len(fp) - k]) <= max_bits)
        left.append(fp[: len(fp) - k][near])
        right.append(fp[k:][near])
    none = np.empty(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def link_finder(max_bits: int):
    """Over rows sorted by key: holds back the last run of a batch until it is complete."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def out(parts):
            if parts and sum(len(p[0]) for p in parts):
                a, b = run_links(*(np.concatenate(c) for c in zip(*parts, strict=True)), max_bits)
                keep = a != b
                if keep.any():
                    u, v = a[keep].view(np.int64), b[keep].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, part, fp, home = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            key = anchor * 1024 + part
            last = int(np.flatnonzero(key != key[-1])[-1] + 1) if key[0] != key[-1] else 0
            # Bits of a signed number are counted on its absolute value.
            cols = (key, fp.astype(np.int64).view(np.uint64), home.astype(np.int64))
            if last or (held and held[-1][0][-1] != key[0]):
                yield from out([*held, tuple(c[:last] for c in cols)])
                held = []
            held.append(tuple(c[last:] for c in cols))
        yield from out(held)

    return find


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component, by alternating large and small stars.

    Every round moves edges to the smallest neighbour, found by an aggregation that combines before
    it shuffles, so a hub costs one row per task. Rounds are few: path lengths shrink by squares.
    """
    edges = settle(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
        edges = settle(small.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        state = seen


def fingerprint_links(nodes: DataFrame, max_bits: int = MAX_BITS, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """(u, v): links that join all distinct fingerprints (column fp) within ``max_bits``, 3 at most."""
    if not 0 <= max_bits <= 3:
        raise ValueError("anchors are laid out for distances up to 3")
    members = divided(anchors(nodes), split_above).select("anchor", "part", "fp", "home")
    sorted_ = members.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return sorted_.mapInArrow(link_finder(max_bits), "u long, v long")


def grouped(members: DataFrame, max_bits: int, split_above: int) -> DataFrame:
    """Adds ``label``, a fingerprint that stands for the group, to rows that have ``fp``."""
    nodes = members.select("fp").distinct()
    labels = components(fingerprint_links(nodes, max_bits, split_above)).withColumnRenamed("node", "fp")
    return members.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def near_duplicates(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    split_above: int = SPLIT_ABOVE,
) -> DataFrame:
    """One row per row of ``df``: key, fingerprint (16 hex digits) and component_id.

    Two texts are linked if their fingerprints differ in at most ``max_bits`` bits; component_id
    is the smallest key reachable over links. Equal fingerprints are one node, so copies are
    never paired. Null and wordless texts have fingerprint zero and are linked like any other. A
    null key takes part but never names a group; a group of null keys only has a null component_id.
    Other columns of ``df`` are not read. An empty table gives an empty result.
    """
    rows = settle(df.select(col(key).alias("key"), fingerprint_udf(shingle_words)(col(text)).alias("fp")))
    nodes = rows.groupBy("fp").agg(F.min("key").alias("key"))
    labelled = grouped(nodes, max_bits, split_above)
    named = labelled.groupBy("label").agg(F.min("key").alias("component_id")).select(F.col("label").alias("l_"), "component_id")
    of_fp = settle(labelled.join(named, F.col("label") == F.col("l_")).select("fp", "component_id"))
    return rows.join(of_fp, "fp").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    split_above: int = SPLIT_ABOVE,
) -> DataFrame:
    """The rows of ``df`` without near duplicates: of each group the row with the smallest key stays.

    Null keys come last; among equal keys, and for repeated rows, a hash of the whole row decides,
    so exactly one row of each group is left. Texts move once, by that hash, never by group.
    """
    k1, k2 = row_key(df)
    rows = settle(df.select(col(key).alias("key"), fingerprint_udf(shingle_words)(col(text)).alias("fp"), k1.alias("k1"), k2.alias("k2")))
    first = F.min(F.struct(F.isnull("key").alias("absent"), "key", "k1", "k2")).alias("first")
    nodes = rows.groupBy("fp").agg(first)
    kept = grouped(nodes, max_bits, split_above).groupBy("label").agg(F.min("first").alias("first"))
    kept = settle(kept.select(F.col("first.k1").alias("k1_"), F.col("first.k2").alias("k2_")))
    keyed = df.select(F.struct("*").alias("row_"), k1.alias("k1"), k2.alias("k2"))
    stay = keyed.join(kept, (F.col("k1") == F.col("k1_")) & (F.col("k2") == F.col("k2_"))).dropDuplicates(["k1", "k2"])
    return stay.select("row_.*")
