"""How far sources of a language diverge in their words, by bitmaps of the terms that have the same count."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.values import col
from plumbline.session import settle

MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
SMOOTHING = 2
#: Distinct terms that a task holds before it hands its counts on.
HELD_TERMS = 400_000
#: Kept terms per block of a language on average, and sources per bucket: a task compares the bitmaps of two buckets in one block.
BLOCK_TERMS = 1 << 13
BUCKET_SOURCES = 24
#: Tasks among which the counts of one language are dealt to meet its sources.
SALTS = 16

# ASCII letters become small, other ASCII characters part terms, all else stays.
TERMS = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, cnt, docs) summed over what a task has read; a row with a null term for each group it has seen."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out():
        for (lang, source), (cnt, docs) in held.items():
            terms = list(cnt)
            n = len(terms) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * n, pa.string()),
                    pa.array([source] * n, pa.string()),
                    pa.array([*terms, None], pa.binary()),
                    pa.array([*cnt.values(), 0], pa.int64()),
                    pa.array([*(docs[t] for t in terms), 0], pa.int64()),
                ],
                names=["lang", "source", "term", "cnt", "docs"],
            )
        held.clear()

    size = 0
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, batch.column(2), strict=True):
            if (lang, source) not in held:
                held[lang, source] = Counter(), Counter()
                size += 1
            cnt, docs = held[lang, source]
            words = text.as_py().translate(TERMS).split()
            before = len(cnt)
            cnt.update(words)
            docs.update(set(words))
            size += len(cnt) - before
            if size > HELD_TERMS:
                yield from out()
                size = 0
    yield from out()


def group_counts(df: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, cnt, docs) over the whole table, and a row with a null term for each group."""
    empty = F.lit("")
    rows = df.select(
        F.coalesce(col(lang).cast("string"), empty).alias("lang"),
        F.coalesce(col(source).cast("string"), empty).alias("source"),
        F.coalesce(col(text), empty).cast("binary").alias("text"),
    )
    parts = rows.mapInArrow(term_counter, "lang string, source string, term binary, cnt long, docs long")
    parts = parts.withColumn("term", F.col("term").cast("string"))
    return parts.groupBy("lang", "source", "term").agg(F.sum("cnt").alias("cnt"), F.sum("docs").alias("docs"))


def share(cnt: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (cnt + 2) / (total + 2 V)), exact: products are decimals of 38 digits."""
    above = (cnt + F.lit(SMOOTHING)).cast("decimal(25,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (total + SMOOTHING * terms).cast("decimal(25,0)")
    # A language without kept terms has no shares.
    return F.call_function("div", above, F.nullif(below, F.lit(0).cast("decimal(25,0)"))).cast("long") + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of longs of at most 10^9 + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def placed(kept: DataFrame, n_kept: int, block_terms: int) -> DataFrame:
    """Adds block, word and bit to (lang, term, lang_cnt): the place of a term in the bitmaps of its language.

    Blocks are dealt by hash; inside one, terms are numbered by falling count, so that words of rare terms
    hold few counts, and those many terms each.
    """
    blocks = max(1, -(-n_kept // block_terms))
    inside = Window.partitionBy("lang", "block").orderBy(F.desc("lang_cnt"), "term")
    rows = kept.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int")).withColumn("no", F.row_number().over(inside) - 1)
    return rows.withColumn("word", F.floor(F.col("no") / 64).cast("int")).withColumn("bit", (F.col("no") % 64).cast("int")).drop("no")


def joint_cells(own: np.ndarray, other: np.ndarray, cols: tuple[np.ndarray, ...], same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For the bitmaps of two buckets at one word: (source, source, value) sums over the cells that both have.

    ``cols`` are source number, bits, p and p of count zero. AND and popcount give the terms that have count a in
    one source and count b in the other; each is worth f(a, b) - f(a, 0) - f(0, b) + f(0, 0), because
    the margins have counted it as (a, 0), (0, b) and not as (0, 0).
    """
    src, bits, p, zero = cols

    def f(x, y):
        return (x - y) * (x - y) // (x + y)

    starts = np.flatnonzero(np.r_[True, src[other][1:] != src[other][:-1]])
    for at in range(0, len(own), 512):
        a = own[at : at + 512]
        n = np.bitwise_count(bits[a][:, None] & bits[other][None, :])
        if same:
            n[src[a][:, None] >= src[other][None, :]] = 0
        i, j = np.nonzero(n)
        if not len(i):
            continue
        pa_, pb, za, zb = p[a][i], p[other][j], zero[a][i], zero[other][j]
        worth = n[i, j].astype(np.int64) * (f(pa_, pb) - f(pa_, zb) - f(za, pb) + f(za, zb))
        block = np.searchsorted(starts, j, side="right") - 1
        key = src[a][i].astype(np.int64) * len(starts) + block
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        total = np.add.reduceat(worth[order], cuts)
        yield key[order][cuts] // len(starts), src[other][starts[key[order][cuts] % len(starts)]], total


def pair_summer(key: tuple, table: pa.Table) -> pa.Table:
    """Grouped map over the bitmaps of one language, block and pair of buckets: (lang, a, b, value)."""
    lang = key[0].as_py()
    b1, b2 = key[2].as_py(), key[3].as_py()
    word, side, src = (table.column(c).to_numpy() for c in ("word", "bucket", "no"))
    order = np.lexsort((src, side, word))
    word, side = word[order], side[order]
    cols = tuple(table.column(c).to_numpy()[order] for c in ("no", "bits", "p", "zero"))
    cols = (cols[0], cols[1].view(np.uint64), cols[2], cols[3])
    sums: dict[tuple[int, int], int] = {}
    cuts = np.r_[np.flatnonzero(np.r_[True, word[1:] != word[:-1]]), len(word)]
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        at = np.arange(s, e)
        own, other = at[side[s:e] == b1], at[side[s:e] == b2]
        if len(own) and len(other):
            for a, b, v in joint_cells(own, other, cols, b1 == b2):
                for x, y, z in zip(a.tolist(), b.tolist(), v.tolist(), strict=True):
                    sums[x, y] = sums.get((x, y), 0) + z
    return pa.table(
        {
            "lang": pa.array([lang] * len(sums), pa.string()),
            "a": pa.array([k[0] for k in sums], pa.int64()),
            "b": pa.array([k[1] for k in sums], pa.int64()),
            "value": pa.array(list(sums.values()), pa.int64()),
        }
    )


def ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    """lang, source, part, item, value and rank by falling value, then item."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = rows.withColumn("rank", F.row_number().over(order))
    out = out if most is None else out.where(F.col("rank") <= most)
    return out.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def divergence(
    df: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    min_docs: int = MIN_DOCS,
    top: int = TOP_TERMS,
    block_terms: int = BLOCK_TERMS,
    bucket_sources: int = BUCKET_SOURCES,
) -> DataFrame:
    """(lang, source, part, item, value, rank): per source its distance to each other source, and the terms it has more of.

    Part ``pair`` sums f over all terms kept for the language (those in ``min_docs`` of its documents); part ``term``
    has the ``top`` terms above the share in the whole language. Bitmaps hold the terms of one count in one source;
    only nonzero words of 64 terms are stored. The cells of two sources come from AND and popcount, those with
    a zero from the sizes of the bitmaps.

    A task counts what it reads before anything is shuffled, so a source that holds most rows costs as much as
    any; a task compares the bitmaps of two buckets of sources in one block of terms. The number of pairs is what the result has.

    Null text, lang and source are empty. Ties are ranked by item in UTF-8 order. Repeated rows count as often as they come. Texts are read whole;
    one longer than others only takes longer. A source without terms has pairs, but no terms; a language with one source
    has no pairs. Other columns are not read. An empty table gives an empty result.
    """
    counts = settle(group_counts(df, text, lang, source))
    groups = counts.where("term IS NULL").select("lang", "source")
    terms = counts.where("term IS NOT NULL")
    kept = terms.groupBy("lang", "term").agg(F.sum("cnt").alias("lang_cnt"), F.sum("docs").alias("lang_docs"))
    kept = settle(kept.where(F.col("lang_docs") >= min_docs).drop("lang_docs"))
    n_kept = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("V"), F.sum("lang_cnt").alias("lang_N"))
    cells = settle(terms.drop("docs").join(placed(kept, n_kept, block_terms), ["lang", "term"]))

    # Per group: its number and the buckets of its language, totals, share of count zero.
    totals = cells.groupBy("lang", "source").agg(F.sum("cnt").alias("N"))
    zero = F.lit(0)
    numbered = Window.partitionBy("lang").orderBy("source")
    known = (
        groups.join(totals, ["lang", "source"], "left")
        .join(sizes, "lang", "left")
        .select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("N", "V", "lang_N")))
        .withColumn("no", F.row_number().over(numbered) - 1)
        .withColumn("buckets", F.ceil(F.count(F.lit(1)).over(Window.partitionBy("lang")) / bucket_sources).cast("int"))
        .withColumn("zero", share(zero, F.col("N"), F.col("V")))
    )
    known = settle(known)

    p = share(F.col("cnt"), F.col("N"), F.col("V"))
    levels = (
        cells.groupBy("lang", "source", "cnt", "block", "word")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
        .join(known, ["lang", "source"])
        .select("lang", "no", "buckets", "cnt", "block", "word", "bits", "zero", p.alias("p"))
    )
    levels = settle(levels)
    dealt = levels.withColumn("bucket", F.pmod("no", F.col("buckets")).cast("int"))
    each = F.transform(
        F.sequence(F.lit(0), F.col("buckets") - 1),
        lambda k: F.struct(F.least(k, F.col("bucket")).alias("b1"), F.greatest(k, F.col("bucket")).alias("b2")),
    )
    met = dealt.withColumn("both", F.explode(each)).select("lang", "block", "both.b1", "both.b2", "bucket", "no", "word", "bits", "p", "zero")
    joint = (
        met.groupBy("lang", "block", "b1", "b2")
        .applyInArrow(pair_summer, "lang string, a long, b long, value long")
        .select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "value")
    )

    # Margins: the terms of a count in one source, all set against count zero in the other.
    level_sizes = levels.groupBy("lang", "no", "p", "zero").agg(F.sum(F.bit_count("bits")).alias("size"))
    other = known.select("lang", F.col("no").alias("o"), F.col("zero").alias("o_zero"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = level_sizes.withColumn("salt", F.pmod(F.xxhash64("no", "p"), F.lit(SALTS)).cast("int"))
    margin = salted.join(other, ["lang", "salt"]).where("no != o")
    worth = F.col("size") * (gap(F.col("p"), F.col("o_zero")) - gap(F.col("zero"), F.col("o_zero")))
    margin = margin.select("lang", F.least("no", "o").alias("a"), F.greatest("no", "o").alias("b"), worth.alias("value"))
    left = known.select("lang", "V", F.col("no").alias("a"), F.col("source").alias("s1"), F.col("zero").alias("z1"))
    right = known.select("lang", F.col("no").alias("b"), F.col("source").alias("s2"), F.col("zero").alias("z2"))
    pairs = left.join(right, "lang").where("a < b")
    summed = joint.union(margin).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    base = F.coalesce(F.col("V") * gap(F.col("z1"), F.col("z2")), zero)
    pairs = pairs.join(summed, ["lang", "a", "b"], "left").select(
        "lang", "s1", "s2", (base + F.coalesce("value", zero)).cast("long").alias("value")
    )
    both = pairs.select("lang", F.col("s1").alias("source"), F.col("s2").alias("item"), "value").union(
        pairs.select("lang", F.col("s2").alias("source"), F.col("s1").alias("item"), "value")
    )

    above = (
        cells.join(known, ["lang", "source"])
        .select("lang", "source", "term", p.alias("p"), share(F.col("lang_cnt"), F.col("lang_N"), F.col("V")).alias("q"))
        .where("p > q")
        .select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    )
    return ranked(both, "pair").union(ranked(above, "term", top))
