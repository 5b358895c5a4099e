"""Mixing sources to target weights: a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.values import col
from plumbline.llm.common import row_key, running_total, words
from plumbline.session import settle

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_PASSES = 2
BLOCK_WORDS = 64
SEED = 20
#: Rows that one task sorts when positions are counted.
CELL_ROWS = 50_000
CHUNK = 4096


@dataclass
class Mix:
    members: DataFrame  # key, size, k1, k2, source (as text, null kept), place, at: first word in the shuffled source
    sources: DataFrame  # place, source_size, target, take: words the schedule gives it
    pieces: DataFrame  # slot, place, block, at, key, epoch, start, n_words: what each slot of the schedule holds


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, passes: int) -> DataFrame:
    """(grp, place, source_size, target) from one row per source, grp being null-free text that sorts by code point.

    The level is the common words-per-weight of all sources below their limit. With sources in the
    order in which they reach it, capping one more raises the level until the first that stays below.
    """
    by_name = Window.orderBy(F.col("grp") == "", "grp")
    cycle = F.array(*(F.lit(w) for w in weights))
    s = sizes.withColumn("place", F.row_number().over(by_name).cast("long") - 1)
    s = s.withColumn("w", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", F.lit(float(passes)) * F.col("source_size"))
    everything = Window.orderBy(F.col("cap") / F.col("w"), "place")
    before = everything.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_ = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    s = s.withColumn("level", left / open_)
    s = s.withColumn("target", F.least(F.col("cap"), F.max("level").over(whole) * F.col("w")))
    return s.select("grp", "place", "source_size", "target")


def mix(
    df: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    passes: int = MAX_PASSES,
    block_words: int = BLOCK_WORDS,
    seed: int = SEED,
) -> Mix:
    """A mixture of all rows, as a schedule of blocks of words.

    Sources, by code point and null last, take the weights in turn and share ``share`` times all
    words; none takes more than ``passes`` times its own, the excess going to the others by weight.
    The schedule has 2^m slots. Slot k stands at the van der Corput point of k, which the cumulative
    targets map to a source; the slots of a source, ranked, take the blocks of its shuffled words
    one after the other, from the start again when they are used up. A full period of points splits
    evenly: each source comes within one block below its target, and any stretch of slots close to it.

    Nulls and wordless texts have size 0: they are members of which no word is taken. A null key
    is a key like any other. Repeated rows are separate members. Order within a source is by md5 of
    seed and key, then size and row. An empty table, or one without words, gives an empty schedule.
    Other columns only tell rows apart. Positions and ranks are counted in cells, so no task holds a source.
    """
    k1, k2 = row_key(df)
    src = col(source).cast("string")
    rows = df.select(
        col(key).alias("key"),
        F.size(words(col(text))).cast("long").alias("size"),
        F.coalesce(F.concat(F.lit("s"), src), F.lit("")).alias("grp"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(col(key).cast("string"), F.lit("")))).alias("h"),
        k1.alias("k1"),
        k2.alias("k2"),
    )
    rows = settle(rows)
    sizes = rows.groupBy("grp").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    placed = settle(targets(sizes, weights, share, passes).withColumn("want", F.round("target").cast("long")))
    every, n_rows = placed.agg(F.sum("want")).first()[0] or 0, rows.count()
    exponent = max(0, (-(-every // block_words) - 1).bit_length()) if every else 0
    slots = 1 << exponent
    block = max(1, -(-every // slots))

    # The points j / slots that fall into a source's stretch of the cumulative targets, in whole numbers.
    upto = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    wide = "decimal(38,0)"
    at_point = lambda c: F.expr(
        f"cast(case when {every} = 0 then 0 else (cast({c} as {wide}) * {slots} + {every} - 1) div {max(every, 1)} end as bigint)"
    )
    sources = placed.withColumn("end_", F.sum("want").over(upto)).withColumn("begin_", F.col("end_") - F.col("want"))
    sources = sources.withColumn("j0", at_point("begin_")).withColumn("j1", at_point("end_"))
    sources = settle(sources.withColumn("take", F.least(F.col("want"), (F.col("j1") - F.col("j0")) * block)))

    chunks = sources.where("j1 > j0").select(
        "place", "j0", "j1", F.explode(F.expr(f"sequence(j0 div {CHUNK}, (j1 - 1) div {CHUNK})")).alias("chunk")
    )
    points = chunks.repartition("chunk").select(
        "place", F.explode(F.expr(f"sequence(greatest(j0, chunk * {CHUNK}), least(j1, (chunk + 1) * {CHUNK}) - 1)")).alias("j")
    )
    reverse = f"cast(conv(reverse(lpad(bin(j), {exponent}, '0')), 2, 10) as bigint)" if exponent else "j"
    cell_bits = max(0, (slots // CELL_ROWS).bit_length())
    ranked = points.select(
        "place", F.expr(reverse).alias("slot"), F.lit(1).alias("one")
    ).withColumn("cell", F.expr(f"shiftright(slot, {max(0, exponent - cell_bits)})"))
    ranked = running_total(ranked, "place", "cell", [F.col("slot")], "one", "block").select("place", "block", "slot")

    cells = n_rows // CELL_ROWS + 1
    named = rows.join(sources.select("grp", "place"), "grp").withColumn(
        "cell", F.expr(f"cast(conv(substr(h, 1, 8), 16, 10) as bigint) * {cells} div 4294967296")
    )
    members = running_total(named, "place", "cell", [F.col(c) for c in ("h", "size", "k1", "k2")], "size", "at")
    shown = F.when(F.col("grp") != "", F.expr("substr(grp, 2)")).alias("source")
    members = settle(members.select("key", "size", "k1", "k2", shown, "place", "at"))

    cut = members.where("size > 0").join(sources.select("place", "source_size", "take"), "place")
    cut = cut.select("*", F.explode(F.expr(f"sequence(0, {passes - 1})")).alias("epoch"))
    cut = cut.withColumn("from_", F.expr("at + epoch * source_size")).where("from_ < take")
    cut = cut.withColumn("to_", F.least(F.col("from_") + F.col("size"), F.col("take")))
    cut = cut.withColumn("block", F.explode(F.expr(f"sequence(from_ div {block}, (to_ - 1) div {block})")))
    first = F.greatest(F.col("from_"), F.col("block") * block)
    last = F.least(F.col("to_"), (F.col("block") + 1) * block)
    cut = cut.select(
        "place", "block", "at", "key", "epoch", (first - F.col("from_")).alias("start"), (last - first).alias("n_words")
    )
    # Exploded rows are more than the planner expects: no side of these joins may be broadcast on its word.
    pieces = cut.join(ranked.hint("merge"), ["place", "block"]).select(
        "slot", "place", "block", "at", "key", "epoch", "start", "n_words"
    )
    return Mix(members, sources.select("place", "source_size", "target", "take"), pieces)


def taken(mixed: Mix) -> DataFrame:
    """One row per member: key, size, source, source_size, target, taken (words over all slots), k1, k2."""
    # Of the members of a source, those with words differ in their first word's position.
    used = mixed.pieces.groupBy("place", "at").agg(F.sum("n_words").alias("used_"))
    m = mixed.members.withColumn("at_", F.when(F.col("size") > 0, F.col("at")))
    used = used.select(F.col("place").alias("p_"), F.col("at").alias("a_"), "used_")
    m = m.join(used.hint("merge"), (F.col("place") == F.col("p_")) & (F.col("at_") == F.col("a_")), "left")
    m = m.join(mixed.sources, "place")
    return m.select(
        "key", "size", "source", "source_size", "target", F.coalesce("used_", F.lit(0)).cast("long").alias("taken"), "k1", "k2"
    )


def mixed_rows(df: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` as often as the mixture takes them, whole: a pass counts if it takes half of the words or more.

    Rows without words are no part of a mixture by words and are not returned.
    """
    t = taken(mix(df, **options)).where("size > 0")
    copies = t.groupBy("k1", "k2").agg(F.sum(F.expr("(2 * taken + size) div (2 * size)")).alias("n_"))
    copies = settle(copies.where("n_ > 0").select(F.col("k1").alias("k1_"), F.col("k2").alias("k2_"), "n_"))
    k1, k2 = row_key(df)
    keyed = df.select(F.struct("*").alias("row_"), k1.alias("k1"), k2.alias("k2"))
    one = keyed.join(copies, (F.col("k1") == F.col("k1_")) & (F.col("k2") == F.col("k2_"))).dropDuplicates(["k1", "k2"])
    return one.select("row_", F.explode(F.expr("sequence(1, cast(n_ as int))")).alias("copy_")).select("row_.*")
