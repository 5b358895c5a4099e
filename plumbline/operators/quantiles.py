"""Exact quantiles by selection: a sketch proposes where a rank lies, counts prove it, and only what lies there is sorted."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import col
from ..session import settle

QUARTILES = (0.25, 0.5, 0.75)

Columns = Sequence[tuple[int, Column]]
# Columns per scan: generated code for more stops compiling.
WIDTH = 25

# A sketch of this size (some 20 KB) misses a rank by about half the margin at most; a miss costs another scan, not the result.
SKETCH_K = 800
MARGIN = 0.008
STEPS = 128

# Values around a rank that are sorted, by the sketch's estimate; more of them are narrowed down by another scan.
SORTED_ROWS = 500_000

# Counted values of a group that one task sorts; more of them are told apart by buckets first.
SORTED_VALUES = 100_000
# Buckets on each of the two scales between the bounds of a rank.
BUCKETS = 1024
# Natural logarithms of shares that a double can hold reach down to this.
LEAST_LOG = -745.0
LARGEST = 1.7976931348623157e308

# Rows of statistics that are sent to every task; more of them are joined by a shuffle.
BROADCAST_ROWS = 20_000
# Parts into which the values of a column and segment are dealt for such a join.
SALTS = 32


def beside(rows: DataFrame, right: DataFrame, on: Sequence[str], by: Sequence[str], spread: Sequence[str], n_right: int | None = None) -> DataFrame:
    """``rows``, each with what ``right`` has under its keys ``on``.

    Without segments that is one row per column of the schema, and broadcast, as are ``n_right`` rows up to a limit. Else a segment may hold most
    values, so its rows are dealt to several keys by a hash of ``spread``.
    """
    for k in on:
        right = right.withColumnRenamed(k, f"_{k}")
    same = F.lit(True)
    for k in on:
        same = same & col(k).eqNullSafe(col(f"_{k}"))
    if not by or (n_right is not None and n_right <= BROADCAST_ROWS):
        return rows.join(F.broadcast(right), same).drop(*[f"_{k}" for k in on])
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    right = right.withColumn("_salt_no", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = salted.join(right, same & (F.col("_salt") == F.col("_salt_no")))
    return joined.drop("_salt", "_salt_no", *[f"_{k}" for k in on])


def _grid(sketch: Column, n: Column) -> Column:
    """Values of the sketch at equal steps of the rank; NULL for an empty one, which has none."""
    ranks = F.array(*(F.lit(i / STEPS) for i in range(STEPS + 1)))
    return F.when(n > 0, F.kll_sketch_get_quantile_double(sketch, ranks))


def _around(grid: Column, n: Column, first: Column, last: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    """Values that should have the ranks ``first`` to ``last`` of ``n`` between them; ``lo`` and ``hi`` at the ends."""
    below, above = F.try_divide(first, n) - MARGIN, F.try_divide(last + 1, n) + MARGIN
    at = lambda place: F.get(grid, place.cast("int"))
    return F.when(below <= 0, lo).otherwise(at(F.floor(below * STEPS))), F.when(above >= 1, hi).otherwise(at(F.ceil(above * STEPS)))


def _left_to_sort(n: Column, lo: Column, hi: Column) -> Column:
    return F.when(lo == hi, F.lit(1.0)).otherwise(n * (2 * (MARGIN + 1 / STEPS)))


def _first_look(df: DataFrame, columns: Columns, by: Sequence[str], ps: Sequence[float]) -> DataFrame:
    """Per group: n, and per rank wanted the bounds proposed (lo, hi), those that are certain (olo, ohi), and the values to sort."""
    look = lambda v: {
        "n": F.count(v), "least": F.min(v), "most": F.max(v), "sketch": F.kll_sketch_agg_double(v, F.lit(SKETCH_K))
    }
    if by:
        keys = [*(col(k) for k in by), F.col("ordinal")]
        seen = _cells(df, columns, by).groupBy(*keys).agg(*(e.alias(n) for n, e in look(F.col("v")).items()))
    else:
        # Without segments columns are aggregated side by side, and no row is taken apart.
        keys = [F.col("ordinal")]
        seen = _wide(df, columns, lambda _, v: look(v)).where("n > 0")
    n = F.col("n")
    seen = seen.withColumn("grid", _grid(F.col("sketch"), n)).drop("sketch")
    out = [*keys, n]
    for i, p in enumerate(ps):
        spot = F.lit(float(p)) * (n - 1)
        lo, hi = _around(F.col("grid"), n, F.floor(spot), F.ceil(spot), F.col("least"), F.col("most"))
        out += [lo.alias(f"lo{i}"), hi.alias(f"hi{i}"), F.col("least").alias(f"olo{i}"), F.col("most").alias(f"ohi{i}")]
        out.append(_left_to_sort(n, lo, hi).alias(f"left{i}"))
    return seen.select(*out)


def _cells(df: DataFrame, columns: Columns, by: Sequence[str]) -> DataFrame:
    """(by, ordinal, v): one row per value."""
    cells = F.array(*(F.struct(F.lit(o).alias("ordinal"), v.alias("v")) for o, v in columns))
    return df.select(*[col(k) for k in by], F.inline(cells)).where("v IS NOT NULL")


def _wide(df: DataFrame, columns: Columns, build: Callable[[int, Column], dict[str, Column]]) -> DataFrame:
    """(ordinal, ...): aggregates of every column in one scan, or in several if there are many."""
    parts = []
    for start in range(0, len(columns), WIDTH):
        rows = [F.struct(F.lit(o).alias("ordinal"), *(e.alias(n) for n, e in build(o, v).items())) for o, v in columns[start : start + WIDTH]]
        parts.append(df.agg(*(r.alias(f"r{i}") for i, r in enumerate(rows))).select(F.inline(F.array(*(F.col(f"r{i}") for i in range(len(rows)))))))
    return reduce(DataFrame.unionByName, parts)


def _spots(ps: Sequence[float]) -> list[tuple[Column, Column, Column]]:
    """pandas interpolates between the two values around position p * (n - 1)."""
    spots = [F.lit(float(p)) * (F.col("n") - 1) for p in ps]
    return [(s, F.floor(s).cast("bigint"), F.ceil(s).cast("bigint")) for s in spots]


def _narrowed(cells: DataFrame, state: DataFrame, names: Sequence[str], by: Sequence[str], ps: Sequence[float], n_state: int) -> DataFrame:
    """One more scan: values below and inside the proposed bounds are counted, those inside are sketched anew.

    If the counts prove that a rank lies inside, the bounds become certain and the new sketch proposes closer
    ones; if not, the certain bound takes the place of the one that was missed.
    """
    v = F.col("v")
    aggs = []
    for i in range(len(ps)):
        inside = v.between(F.col(f"lo{i}"), F.col(f"hi{i}"))
        aggs += [
            F.count_if(v < F.col(f"lo{i}")).alias(f"below{i}"),
            F.count_if(inside).alias(f"in{i}"),
            F.kll_sketch_agg_double(F.when(inside, v), F.lit(SKETCH_K)).alias(f"sketch{i}"),
        ]
    keys = [col(k) for k in names]
    counted = beside(cells, state, names, by, ["ordinal", "v"], n_state).groupBy(*keys).agg(*aggs)
    for k in names:
        counted = counted.withColumnRenamed(k, f"_{k}")
    same = F.lit(True)
    for k in names:
        same = same & col(k).eqNullSafe(col(f"_{k}"))
    known = state.join(counted, same)
    out = [*keys, F.col("n")]
    for i, (_, first, last) in enumerate(_spots(ps)):
        lo, hi, olo, ohi, below, n = (F.col(f"{c}{i}") for c in ("lo", "hi", "olo", "ohi", "below", "in"))
        early, late = first < below, last >= below + n
        sure = ~early & ~late
        near, far = _around(_grid(F.col(f"sketch{i}"), n), n, first - below, last - below, lo, hi)
        new_lo = F.when(sure, near).when(early, olo).otherwise(lo)
        new_hi = F.when(sure, far).when(late, ohi).otherwise(hi)
        out += [new_lo.alias(f"lo{i}"), new_hi.alias(f"hi{i}"), F.when(sure, lo).otherwise(olo).alias(f"olo{i}"), F.when(sure, hi).otherwise(ohi).alias(f"ohi{i}")]
        # Missed bounds are looked at once more before anything is sorted between them.
        out.append(F.when(sure, _left_to_sort(n, new_lo, new_hi)).otherwise(F.lit(float("inf"))).alias(f"left{i}"))
    return known.select(*out)


def _sorted_inside(df: DataFrame, columns: Columns, state: DataFrame, ps: Sequence[float]) -> DataFrame:
    """(ordinal, q0, q1, ..): one scan counts what lies below the bounds, another fetches what is inside, by value.

    Their counts in order give the values inside their exact ranks. NULL where a rank is not inside its bounds.
    """
    known = {r["ordinal"]: r for r in state.collect()}  # one row per column of the schema
    columns = [(o, v) for o, v in columns if o in known]
    n_ps = range(len(ps))

    def place(o: int, v: Column) -> dict[str, Column]:
        out = {}
        for i in n_ps:
            lo, hi = F.lit(known[o][f"lo{i}"]), F.lit(known[o][f"hi{i}"])
            out |= {f"below{i}": F.count_if(v < lo), f"in{i}": F.count_if(v.between(lo, hi))}
        return out

    counted = state.join(F.broadcast(_wide(df, columns, place)), "ordinal")
    parts = []
    for start in range(0, len(columns), WIDTH):
        cells = []
        for o, v in columns[start : start + WIDTH]:
            # Bounds that are one value need no values.
            apart = [(known[o][f"lo{i}"], known[o][f"hi{i}"]) for i in n_ps if known[o][f"lo{i}"] != known[o][f"hi{i}"]]
            if apart:
                inside = reduce(Column.__or__, (v.between(F.lit(lo), F.lit(hi)) for lo, hi in apart))
                cells.append(F.struct(F.lit(o).alias("ordinal"), F.when(inside, v).alias("x")))
        if cells:
            parts.append(df.select(F.inline(F.array(*cells))).where("x IS NOT NULL"))
    none = "struct<x:double,cnt:bigint,upto:bigint>"
    if parts:
        counts = reduce(DataFrame.unionByName, parts).groupBy("ordinal", "x").agg(F.count(F.lit(1)).alias("cnt"))
        upto = F.sum("cnt").over(W.partitionBy("ordinal").orderBy("x"))
        values = counts.select("ordinal", F.struct("x", "cnt", upto.alias("upto")).alias("_v"))
        placed = values.join(F.broadcast(counted), "ordinal", "right")
    else:
        placed = counted.withColumn("_v", F.lit(None).cast(none))
    x, cnt = F.col("_v.x"), F.col("_v.cnt")
    of_column = W.partitionBy("ordinal")
    # All values from a lower bound on are here: ranks follow from what is below it.
    for i in n_ps:
        earlier = F.coalesce(F.sum(F.when(x < F.col(f"lo{i}"), cnt)).over(of_column), F.lit(0))
        placed = placed.withColumn(f"_top{i}", F.col(f"below{i}") + F.col("_v.upto") - earlier)
    ends = []
    for i, (_, first, last) in enumerate(_spots(ps)):
        lo, hi, below, top = F.col(f"lo{i}"), F.col(f"hi{i}"), F.col(f"below{i}"), F.col(f"_top{i}")

        def at(k: Column) -> Column:
            alone = F.when((lo == hi) & (k >= below) & (k < below + F.col(f"in{i}")), lo)  # noqa: B023
            return F.max(F.coalesce(alone, F.when(x.between(lo, hi) & (k < top) & (k >= top - cnt), x)))  # noqa: B023

        ends += [at(first).alias(f"a{i}"), at(last).alias(f"b{i}")]
    return _interpolated(placed.groupBy("ordinal", "n").agg(*ends), ["ordinal"], ps)


def _interpolated(found: DataFrame, names: Sequence[str], ps: Sequence[float]) -> DataFrame:
    value = lambda i, s: F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * (s - F.floor(s))
    return found.select(*[col(k) for k in names], *(value(i, s).alias(f"q{i}") for i, (s, _, _) in enumerate(_spots(ps))))


def _sorted_by_segment(cells: DataFrame, state: DataFrame, names: Sequence[str], by: Sequence[str], ps: Sequence[float], n_state: int) -> DataFrame:
    """The same per segment: one scan counts all values between the bounds by stretch, and those inside by value."""
    v, many = F.col("v"), len(ps)
    keys = [col(k) for k in names]
    lows = [F.least(*(F.col(f"lo{j}") for j in range(i, many)), F.col(f"lo{many - 1}")) for i in range(many)]
    highs = [F.greatest(*(F.col(f"hi{j}") for j in range(i + 1)), F.col("hi0")) for i in range(many)]
    bounds = state.select(*keys, F.array(*lows).alias("lows"), *(h.alias(f"high{i}") for i, h in enumerate(highs)))
    met = beside(cells, bounds, names, by, ["ordinal", "v"], n_state)
    met = met.withColumn("stretch", sum(((v > F.col(f"high{i}")).cast("int") for i in range(many)), F.lit(0)))
    inside = F.when(v >= F.get("lows", F.col("stretch")), v)
    counts = met.groupBy(*keys, "stretch", inside.alias("x")).agg(F.count(F.lit(1)).alias("cnt"))
    upto = F.sum("cnt").over(W.partitionBy(*keys).orderBy("stretch", F.asc_nulls_first("x")))
    placed = counts.withColumn("upto", upto)
    reached = lambda k: (k < F.col("upto")) & (k >= F.col("upto") - F.col("cnt"))
    ends = []
    for i, (_, first, last) in enumerate(_spots(ps)):
        ends += [F.max(F.when(reached(first), F.col("x"))).alias(f"a{i}"), F.max(F.when(reached(last), F.col("x"))).alias(f"b{i}")]
    # A few values per rank and group are left here.
    found = beside(placed, state.select(*keys, "n"), names, by, ["stretch", "x"], n_state).groupBy(*keys, "n").agg(*ends)
    return _interpolated(found, names, ps)


def select_quantiles(
    df: DataFrame, columns: Columns, by: Sequence[str] = (), probabilities: Sequence[float] = QUARTILES, sorted_rows: int | None = None
) -> DataFrame:
    """(by, ordinal, quartiles array): exact interpolated quantiles of (ordinal, column) pairs of doubles, NULLs left out.

    The first scan sketches each column (and segment). Its bounds hold about 3% of the values around a rank. While that
    is more than ``sorted_rows``, another scan narrows them down, thirty times each; the last ones count and fetch what is inside. So the table is
    never sorted nor moved, and the number of tasks is that of the scans.
    """
    sorted_rows = SORTED_ROWS if sorted_rows is None else sorted_rows
    ps = sorted(probabilities)
    names = [*by, "ordinal"]
    keys = [col(k) for k in names]
    columns = list(columns)
    none = df.limit(0).select(*[col(k) for k in by], F.lit(0).alias("ordinal"), F.array().cast("array<double>").alias("quartiles"))
    if not columns:
        return none
    cells = _cells(df, columns, by)
    state = settle(_first_look(df, columns, by, ps))
    while True:
        n_state = state.count()
        if not n_state:
            return none
        left = state.agg(F.max(F.greatest(*(F.col(f"left{i}") for i in range(len(ps))), F.lit(0.0)))).first()[0]
        if left is not None and left > sorted_rows:
            state = settle(_narrowed(cells, state, names, by, ps, n_state))
            continue
        sorted_ = _sorted_by_segment(cells, state, names, by, ps, n_state) if by else _sorted_inside(df, columns, state, ps)
        found = settle(sorted_)
        missed = F.lit(False)
        for i in range(len(ps)):
            missed = missed | F.col(f"q{i}").isNull()
        if found.count() == n_state and found.where(missed).isEmpty():
            order = [F.col(f"q{ps.index(p)}") for p in probabilities]
            return found.select(*keys, F.array(*order).alias("quartiles"))
        # The sketch has missed a rank: counts tell on which side.
        state = settle(_narrowed(cells, state, names, by, ps, n_state))


def _bucket(v: Column, lo: Column, hi: Column) -> Column:
    """Number of ``v`` between the bounds, rising with it: 0 and the last are the bounds alone, so a bucket never holds both.

    Equal steps and equal ratios are added up: outliers and values of many magnitudes are told apart in few rounds.
    """
    finite = lambda c: F.greatest(F.least(c, F.lit(LARGEST)), F.lit(-LARGEST))
    # Halves, since the difference of two doubles may not be one.
    share = F.coalesce(F.try_divide(finite(v) / 2 - finite(lo) / 2, finite(hi) / 2 - finite(lo) / 2), F.lit(0.0))
    share = F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0))
    ratio = F.when(share > 0, F.greatest(1 - F.ln(share) / LEAST_LOG, F.lit(0.0))).otherwise(0.0)
    inner = (F.floor(share * BUCKETS) + F.floor(ratio * BUCKETS)).cast("int") + 1
    return F.when(v <= lo, F.lit(0)).when(v >= hi, F.lit(2 * BUCKETS + 2)).otherwise(inner)


def _located(counts: DataFrame, state: DataFrame, names: Sequence[str], by: Sequence[str], ps: Sequence[float], n_state: int, sort: bool) -> DataFrame:
    """One scan of the counts: per rank the bounds (lo, hi) of the stretch of values that has it, and how many values lie in that.

    ``sort`` makes every value between the bounds a stretch of its own, else they are dealt to buckets. Values outside are one stretch on either side.
    """
    v, many = F.col("v"), len(ps)
    keys = [col(k) for k in names]
    # Ranks rise, and so do their bounds; what two of them share belongs to the first.
    bounds = state.select(*keys, *(F.col(f"{c}{i}") for i in range(many) for c in ("lo", "hi")))
    met = beside(counts, bounds, names, by, ["ordinal", "v"], n_state)
    met = met.withColumn("_part", sum(((v > F.col(f"hi{i}")).cast("int") for i in range(many)), F.lit(0)))
    lo, hi = (F.get(F.array(*(F.col(f"{c}{i}") for i in range(many))), F.col("_part")) for c in ("lo", "hi"))
    met = met.select(*keys, "v", "cnt", "_part", lo.alias("_lo"), hi.alias("_hi"))
    place = v if sort else _bucket(v, F.col("_lo"), F.col("_hi"))
    stretch = met.groupBy(*keys, "_part", F.when(v >= F.col("_lo"), place).alias("_place")).agg(
        F.sum("cnt").alias("cnt"), F.min("v").alias("_least"), F.max("v").alias("_most"), F.count(F.lit(1)).alias("_distinct")
    )
    upto = F.sum("cnt").over(W.partitionBy(*keys).orderBy("_part", F.asc_nulls_first("_place")))
    placed = beside(stretch.withColumn("_upto", upto), state.select(*keys, "n"), names, by, ["_part", "_place"], n_state)
    reached = lambda k: (k < F.col("_upto")) & (k >= F.col("_upto") - F.col("cnt"))
    ends = []
    for i, (_, first, last) in enumerate(_spots(ps)):
        both = F.max(F.when(reached(first) & reached(last), F.col("_distinct")))
        # Neighbours in two stretches are the last value of one and the first of the other.
        ends += [
            F.max(F.when(reached(first), F.when(reached(last), F.col("_least")).otherwise(F.col("_most")))).alias(f"lo{i}"),
            F.max(F.when(reached(last), F.when(reached(first), F.col("_most")).otherwise(F.col("_least")))).alias(f"hi{i}"),
            F.coalesce(both, F.lit(0)).alias(f"left{i}"),
        ]
    found = placed.groupBy(*keys, "n").agg(*ends)
    # A stretch of one value, or two neighbours known: nothing is left to tell apart.
    done = lambda i: (F.col(f"left{i}") <= 1) | (F.col(f"lo{i}") == F.col(f"hi{i}"))
    return found.select(
        *keys, "n", *(F.col(f"{c}{i}") for i in range(many) for c in ("lo", "hi")), *(F.when(~done(i), F.col(f"left{i}")).otherwise(0).alias(f"left{i}") for i in range(many))
    )


def counted_quantiles(
    counts: DataFrame,
    by: Sequence[str] = (),
    probabilities: Sequence[float] = QUARTILES,
    sorted_values: int | None = None,
    ends: DataFrame | None = None,
) -> DataFrame:
    """The same as ``select_quantiles`` from (by, ordinal, v, cnt), values with their counts: each may come in several rows.

    Counts by buckets between the least and the largest value tell in which bucket a rank lies, which then is divided in turn, until
    few enough values are left to be sorted. Nothing is guessed, so no round is in vain. ``ends`` may give (by, ordinal, n, lo, hi, left): the number of
    values, least, largest, and how many are distinct at most.
    """
    sorted_values = SORTED_VALUES if sorted_values is None else sorted_values
    ps = sorted(probabilities)
    names = [*by, "ordinal"]
    keys = [col(k) for k in names]
    counts = counts.where("v IS NOT NULL").select(*keys, "v", "cnt")
    if ends is None:
        ends = counts.groupBy(*keys).agg(F.sum("cnt").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("left"))
    state = settle(ends.select(*keys, "n", *(F.col(c).alias(f"{c}{i}") for i in range(len(ps)) for c in ("lo", "hi", "left"))))
    while True:
        n_state, left = state.agg(F.count(F.lit(1)), F.max(F.greatest(*(F.col(f"left{i}") for i in range(len(ps))), F.lit(0)))).first()
        if not left:
            break
        state = settle(_located(counts, state, names, by, ps, n_state, left <= sorted_values))
    value = lambda i, s: F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (s - F.floor(s))
    found = {p: value(i, s) for i, (p, (s, _, _)) in enumerate(zip(ps, _spots(ps)))}
    return state.select(*keys, F.array(*(found[p] for p in probabilities)).alias("quartiles"))
