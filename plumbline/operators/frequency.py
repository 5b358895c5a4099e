"""The value-frequency table and what follows from it: distinct counts, top, rare and sample values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import col, percent
from ..session import settle
from .quantiles import beside
from .schema import Field, fields, normalise
from .types import KEY_CHARS, Facts, look

TOP_VALUES = 5
SAMPLE_VALUES = 3
RARE_SHARE = 0.01
# Keys of at most 96 characters: more of them are joined by a shuffle.
BROADCAST_ROWS = 20_000
# A sample of values is looked for among about so many, whose digests are small.
SAMPLED = 64


def text_key(c: Column) -> Column:
    """A string as grouping key: itself, or its prefix and digest if long.

    Documents would otherwise cross the network whole just to be counted.
    """
    return F.when(F.length(c) <= KEY_CHARS, c).otherwise(F.concat(F.left(c, F.lit(KEY_CHARS)), F.md5(c)))


def _channels(f: Field, long_values: bool) -> dict[str, Column]:
    """Integers, doubles and floats keep their own type, the rest is text; exactly one channel is set."""
    out = {
        "lng": F.lit(None).cast("bigint"),
        "dbl": F.lit(None).cast("double"),
        "flt": F.lit(None).cast("float"),
        "txt": F.lit(None).cast("string"),
        "digest": F.lit(False),
    }
    if f.kind == "integral":
        out["lng"] = f.value.cast("bigint")
    elif f.dtype == "double":
        out["dbl"] = f.value
    elif f.dtype == "float":
        out["flt"] = f.value
    elif long_values:
        out["txt"] = text_key(f.label)
        out["digest"] = F.coalesce(F.length(f.label) > KEY_CHARS, F.lit(False))
    else:
        out["txt"] = f.label
    return out


CHANNELS = {"lng": "bigint", "dbl": "double", "flt": "float", "txt": "string"}


def _channel(f: Field) -> str:
    return "lng" if f.kind == "integral" else {"double": "dbl", "float": "flt"}.get(f.dtype, "txt")


def _grouped(cells: DataFrame, facts: Sequence[Facts], by: Sequence[str], count: Column) -> DataFrame:
    """Counts by value. Channels that no column uses are no keys, which makes the others cheaper to compare."""
    used = {_channel(x.field) for x in facts}
    names = [c for c in CHANNELS if c in used] + ["digest"] * any(x.long_values for x in facts)
    keys = [*(col(k) for k in by), F.col("ordinal")]
    none = {c: F.lit(None).cast(t) for c, t in CHANNELS.items()} | {"digest": F.lit(False)}
    out = [F.col(c) if c in names else e.alias(c) for c, e in none.items()]
    return cells.groupBy(*keys, *names).agg(count.alias("cnt")).select(*keys, *out, "cnt")


def added_up(freq: DataFrame, facts: Sequence[Facts]) -> DataFrame:
    """The frequency table of the whole from that of its segments."""
    return _grouped(freq, facts, (), F.sum("cnt"))


def frequencies(df: DataFrame, facts: Sequence[Facts], by: Sequence[str] = ()) -> DataFrame:
    """(by, ordinal, lng, dbl, flt, txt, digest, cnt): one row per distinct value of a column.

    One shuffle for all columns, keyed by column and value, so that it spreads
    over the cluster; map-side counts absorb hot values.
    """
    keys = [col(k) for k in by]
    cells = [
        F.struct(
            F.lit(x.field.ordinal).alias("ordinal"),
            *(c.alias(n) for n, c in _channels(x.field, x.long_values).items()),
        )
        for x in facts
    ]
    present = df.select(*keys, F.inline(F.array(*cells))).where("lng IS NOT NULL OR dbl IS NOT NULL OR flt IS NOT NULL OR txt IS NOT NULL")
    return _grouped(present, facts, by, F.count(F.lit(1)))


def value_text() -> Column:
    """The counted value as text (the key, for long values)."""
    return F.coalesce(F.col("lng").cast("string"), F.col("dbl").cast("string"), F.col("flt").cast("string"), F.col("txt"))


def value_digest() -> Column:
    """md5 of the full value, long or short."""
    return F.when(F.col("digest"), F.right("txt", F.lit(32))).otherwise(F.md5(value_text()))


def of_columns(ordinals: Sequence[int]) -> Column:
    """Keep some columns of the frequency table.

    Tied to the count on purpose: a plain test on ``ordinal`` would sink below
    the shuffle, and the branches of a profile could no longer share it.
    """
    return F.when(F.col("cnt") > 0, F.col("ordinal").isin(list(ordinals)))


def ranked(freq: DataFrame, order: list[Column], k: int, by: Sequence[str] = ()) -> DataFrame:
    """First k values per column. The rank filter becomes a group limit before the shuffle.

    The test on the count keeps it in the plan, so that all branches of a profile
    share one shuffle of the frequency table.
    """
    freq = freq.where("cnt > 0")
    w = W.partitionBy(*[col(b) for b in by], "ordinal").orderBy(*order)
    return freq.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def smallest_digests(freq: DataFrame, sizes: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The k values of each column (and segment) with the smallest md5; ``sizes`` has the distinct values as n_unique.

    Digests are spread evenly, so some ``SAMPLED`` of them lie below a bound that follows from their number: only those are sorted. Should
    a group have less than k there, all are sorted instead.
    """
    names = [*by, "ordinal"]
    share = F.lit(float(SAMPLED)) / F.col("n_unique")
    # Thirteen hexadecimal digits are 52 bits.
    bound = F.lower(F.lpad(F.hex((share * F.lit(float(1 << 52))).cast("bigint")), 13, "0"))
    few = sizes.select(*[col(n) for n in names], F.when(share >= 1, F.lit("g")).otherwise(bound).alias("_bound"), F.col("n_unique").alias("_distinct"))
    near = beside(freq, few, names, by, ["lng", "dbl", "flt", "txt"], sizes.count() if by else None)
    near = near.where(value_digest() < F.col("_bound")).drop("_bound", "_distinct")
    picked = settle(ranked(near, [value_digest()], k, by))
    found = picked.groupBy(*[col(n) for n in names]).agg(F.count(F.lit(1)).alias("_found"))
    for n in names:
        found = found.withColumnRenamed(n, f"_{n}")
    same = F.lit(True)
    for n in names:
        same = same & col(n).eqNullSafe(col(f"_{n}"))
    short = few.join(found, same, "left").where(F.coalesce("_found", F.lit(0)) < F.least(F.lit(k), F.col("_distinct")))
    if not short.isEmpty():
        picked = ranked(freq, [value_digest()], k, by)
    return picked.drop("rank")


def most_frequent(
    freq: DataFrame, df: DataFrame, facts: Sequence[Facts], k: int, by: Sequence[str] = (), descending: bool = True
) -> DataFrame:
    """The k most (or least) frequent values per column with ``rank`` and ``value``; ties by value, rising (falling).

    Long values are known by prefix and digest only. Where the k-th place falls among values that tie by count and
    prefix, longer prefixes decide; k rows per column are restored and sorted.
    """
    return in_order(restore(first_k(freq, df, facts, k, by, descending), df, facts, by), value_order(descending), by)


def in_order(rows: DataFrame, order: list[Column], by: Sequence[str] = ()) -> DataFrame:
    """Adds ``rank`` within column (and segment); ``rows`` has a few of each."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*[col(b) for b in by], "ordinal").orderBy(*order)))


def value_order(descending: bool = True) -> list[Column]:
    """Order of restored rows: by count, then by value as number or text."""
    return [*_known_order(descending), _ends(descending)("value")]


def _ends(descending: bool):
    return F.asc if descending else F.desc


def _known_order(descending: bool) -> list[Column]:
    way, ends = (F.desc, F.asc) if descending else (F.asc, F.desc)
    return [way("cnt"), ends("lng"), ends("dbl"), ends("flt")]


# The prefixes that decide a tie grow by this factor from round to round.
PREFIX_GROWTH = 4


def first_k(
    freq: DataFrame, df: DataFrame, facts: Sequence[Facts], k: int, by: Sequence[str] = (), descending: bool = True
) -> DataFrame:
    """At most k rows of the frequency table per column: the first by count and value.

    k + 1 rows by count and prefix show whether the k-th place is tied. A tied class gives way to the
    first of its members by a longer prefix, which one more scan of the long values counts, and so on until no
    place is tied. No task sees more than k + 1 members of a class from each other task.
    """
    names = [*by, "ordinal"]
    w = W.partitionBy(*[col(n) for n in names])
    order = _known_order(descending)
    near = freq.where("cnt > 0").withColumn("_p", F.left("txt", F.lit(KEY_CHARS))).withColumn("_need", F.lit(k))
    decided, chars = None, KEY_CHARS
    while True:
        near = near.withColumn("rank", F.row_number().over(w.orderBy(*order, _ends(descending)("_p")))).where(F.col("rank") <= k + 1)
        if decided is None and not any(x.long_values for x in facts):
            return near.where(F.col("rank") <= k).drop("rank", "_p", "_need")
        near = near.where(F.col("rank") <= F.col("_need") + 1)
        whole = w.orderBy("rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        last = F.last(F.struct("cnt", "_p", "rank")).over(whole)
        near = near.withColumn("_last", last).withColumn(
            "_like_last", F.coalesce((F.col("cnt") == F.col("_last.cnt")) & (F.col("_p") == F.col("_last._p")), F.lit(False))
        )
        # The last of need + 1 rows drops out, unless it shares the class of the one before it: then the class is open.
        first = F.min(F.when(F.col("_like_last"), F.col("rank"))).over(w)
        near = settle(near.withColumn("_from", F.when(F.col("_last.rank") > F.col("_need"), first)))
        is_open = F.coalesce(F.col("_like_last") & (F.col("_from") <= F.col("_need")), F.lit(False))
        free = near.where(~is_open & (F.col("rank") <= F.col("_need"))).drop("rank", "_p", "_need", "_last", "_like_last", "_from")
        decided = free if decided is None else decided.unionByName(free)
        classes = near.where(is_open & (F.col("rank") == F.col("_from")))
        n = classes.count()
        if not n:
            return decided
        classes = settle(classes.select(*[col(n) for n in names], "cnt", "_p", (F.col("_need") - F.col("_from") + 1).alias("_need")))
        near = _members(df, facts, by, classes, n, chars)
        chars *= PREFIX_GROWTH


def _members(df: DataFrame, facts: Sequence[Facts], by: Sequence[str], classes: DataFrame, n: int, chars: int) -> DataFrame:
    """Rows of the frequency table for the members of tied classes (by, ordinal, cnt, _p, _need), with a longer prefix."""
    names = [*by, "ordinal"]
    cells = [F.struct(F.lit(x.field.ordinal).alias("ordinal"), x.field.label.alias("v")) for x in facts if x.long_values]
    rows = df.select(*[col(b) for b in by], F.inline(F.array(*cells)))
    on = F.left("v", F.lit(chars)) == F.col("_p")
    for k in [*names, "cnt"]:
        classes = classes.withColumnRenamed(k, f"_{k}")
    for k in names:
        on = on & col(k).eqNullSafe(col(f"_{k}"))
    # One class per column and segment at most.
    met = rows.join(F.broadcast(classes) if n <= BROADCAST_ROWS else classes, on)
    longer = F.left("v", F.lit(chars * PREFIX_GROWTH)).alias("_longer")
    counted = met.groupBy(*[col(k) for k in names], text_key(F.col("v")).alias("txt"), longer, "_cnt", "_need").agg(
        F.count(F.lit(1)).alias("cnt"), F.max(F.length("v") > KEY_CHARS).alias("digest")
    )
    null = lambda t: F.lit(None).cast(t)
    return counted.where("cnt = _cnt").select(
        *[col(k) for k in names], null("bigint").alias("lng"), null("double").alias("dbl"), null("float").alias("flt"), "txt", "digest",
        "cnt", F.col("_longer").alias("_p"), "_need",
    )


def restore(picked: DataFrame, df: DataFrame, facts: Sequence[Facts], by: Sequence[str] = ()) -> DataFrame:
    """Add ``value``: the full text of picked rows, read back from the table where only a digest is known.

    ``picked`` has a few rows per column (and segment); the table is scanned again
    only for columns that hold long strings.
    """
    long = [x for x in facts if x.long_values]
    if not long:
        return picked.withColumn("value", value_text())
    keys = [col(k).alias(f"_{k}") for k in by]
    cells = [F.struct(F.lit(x.field.ordinal).alias("_o"), x.field.label.alias("_v")) for x in long]
    source = (
        df.select(*keys, F.inline(F.array(*cells)))
        .where(F.length("_v") > KEY_CHARS)
        .withColumn("_t", text_key(F.col("_v")))
    )
    picked = settle(picked)
    wanted = picked.where("digest").select(*[col(k) for k in by], "ordinal", "txt").distinct()
    on = (F.col("ordinal") == F.col("_o")) & (F.col("txt") == F.col("_t"))
    for k in by:
        on = on & col(k).eqNullSafe(col(f"_{k}"))
    # A few rows per column and segment, as a rule: then the texts are filtered where they are read.
    n = picked.where("digest").count()
    small = F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted
    full = (
        source.join(small, on)
        .groupBy(*[col(f"_{k}") for k in by], "_o", "_t")
        .agg(F.first("_v").alias("_v"))
    )
    back = (F.col("ordinal") == F.col("_o")) & (F.col("txt") == F.col("_t"))
    for k in by:
        back = back & col(k).eqNullSafe(col(f"_{k}"))
    return (
        picked.join(full, back, "left")
        .withColumn("value", F.coalesce("_v", value_text()))
        .drop("_o", "_t", "_v", *[f"_{k}" for k in by])
    )


def _names(df: DataFrame, facts: Sequence[Facts]) -> Column:
    """Column name by ordinal, as a literal map: the schema bounds its size."""
    pairs = [x for f in facts for x in (F.lit(f.field.ordinal), F.lit(f.field.name))]
    return F.create_map(*pairs)[F.col("ordinal")]


def value_counts(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(name, value, cnt) for every distinct non-null value, whole."""
    df = normalise(df)
    # All values are in the result, so long ones are grouped by themselves.
    facts = [replace(x, long_values=False) for x in _chosen(df, names)]
    return frequencies(df, facts).select(_names(df, facts).alias("name"), value_text().alias("value"), "cnt")


def _chosen(df: DataFrame, names: list[str] | None) -> list[Facts]:
    return [x for x in look(df) if names is None or x.field.name in names]


def n_unique(df: DataFrame, exact: bool = True, names: list[str] | None = None) -> DataFrame:
    """(name, n_unique): distinct non-null values; ``exact=False`` uses sketches in a single scan."""
    from .aggregate import by_column

    df = normalise(df)
    if not exact:
        cols = [f for f in fields(df) if names is None or f.name in names]
        return by_column(df, cols, lambda f: {"n_unique": F.approx_count_distinct(f.value)}).select("name", "n_unique")
    facts = _chosen(df, names)
    found = frequencies(df, facts).groupBy("ordinal").agg(F.count(F.lit(1)).alias("n"))
    return every_column(df, facts, found).select("name", F.coalesce("n", F.lit(0)).alias("n_unique"))


def every_column(df: DataFrame, facts: Sequence[Facts], found: DataFrame) -> DataFrame:
    """One row per chosen column, also for columns without values."""
    rows = [(x.field.ordinal, x.field.name) for x in facts]
    base = df.sparkSession.createDataFrame(rows, "ordinal int, name string")
    return F.broadcast(base).join(F.broadcast(found), "ordinal", "left")


def sample_values(df: DataFrame, k: int = SAMPLE_VALUES, names: list[str] | None = None) -> DataFrame:
    """(name, rank, value): the k distinct values with the smallest md5, a repeatable random pick."""
    df = normalise(df)
    facts = _chosen(df, names)
    picked = ranked(frequencies(df, facts), [value_digest()], k)
    return restore(picked, df, facts).select(_names(df, facts).alias("name"), "rank", "value")


def top_values(df: DataFrame, k: int = TOP_VALUES, names: list[str] | None = None) -> DataFrame:
    """(name, rank, value, count, frequency_pct): the k most frequent values, share of non-nulls."""
    df = normalise(df)
    facts = _chosen(df, names)
    freq = settle(frequencies(df, facts))
    totals = freq.groupBy("ordinal").agg(F.sum("cnt").alias("total"))
    picked = most_frequent(freq, df, facts, k).join(F.broadcast(totals), "ordinal")
    return picked.select(
        _names(df, facts).alias("name"),
        "rank",
        "value",
        F.col("cnt").alias("count"),
        percent(F.col("cnt"), F.col("total")).alias("frequency_pct"),
    )


def rare_values(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(name, rare_values): distinct values seen less than max(1, 1% of all rows) times."""
    df = normalise(df)
    facts = _chosen(df, names)
    n_rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    rare = F.count_if(F.col("cnt") < F.greatest(F.lit(1.0), n_rows * RARE_SHARE))
    found = frequencies(df, facts).groupBy("ordinal").agg(rare.alias("n"))
    return every_column(df, facts, found).select("name", F.coalesce("n", F.lit(0)).alias("rare_values"))


def category_summary(df: DataFrame, k: int = 10) -> DataFrame:
    """Per string column: distinct count, most and least frequent value, top-k distribution (long form).

    Columns: name, n_unique, most_frequent, most_frequent_count, least_frequent, rank, value, count.
    """
    df = normalise(df)
    facts = [x for x in look(df) if x.field.kind == "string"]
    freq = settle(frequencies(df, facts))
    size = freq.groupBy("ordinal").agg(F.count(F.lit(1)).alias("n_unique"))
    top = settle(most_frequent(freq, df, facts, k))
    most = top.where("rank = 1").select(
        "ordinal", F.col("value").alias("most_frequent"), F.col("cnt").alias("most_frequent_count")
    )
    # The end of a list sorted by falling count, ties by rising value.
    least = most_frequent(freq, df, facts, 1, descending=False).select("ordinal", F.col("value").alias("least_frequent"))
    out = top.select("ordinal", "rank", "value", F.col("cnt").alias("count"))
    for side in (size, most, least):
        out = out.join(F.broadcast(side), "ordinal")
    return out.withColumn("name", _names(df, facts)).drop("ordinal")
