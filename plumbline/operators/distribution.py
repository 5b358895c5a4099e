"""The numbers behind each plot: histograms, densities, box plots, category counts, missingness."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import col
from .columns import _number_facts, _quartiles, iqr_bounds
from .ranking import ROWS_PER_SLICE, global_rank
from .schema import fields, kind_of, normalise

CELLS_PER_BANDWIDTH = 128
# Bandwidths over which a value is felt.
REACH = 8

# Bins of the key in each round of the border search, and keys that are ranked at the end.
BORDER_BINS = 100_000
RANKED_KEYS = 1_000_000


def _values(df: DataFrame, name: str) -> DataFrame:
    """The non-null values of one number column as ``x``; the scan reads nothing else."""
    return normalise(df.select(col(name))).select(col(name).cast("double").alias("x")).where("x IS NOT NULL")


def _quartile_struct(df: DataFrame, name: str) -> Column:
    """Quartiles of one column as a scalar subquery (NULL without values)."""
    df, facts = _number_facts(df, [name])
    return _quartiles(df, facts).select("quartiles").scalar()


def bin_layout(df: DataFrame, name: str) -> DataFrame:
    """One row (n, lo, hi, width, bins): equal-width bins by the automatic rule.

    The width is the smaller of the spread rule (2 IQR n^-1/3) and the count rule
    (range / (log2 n + 1)), the latter alone if the IQR is zero, at least 1 for
    whole numbers. A constant column gets one bin around its value.
    """
    whole = kind_of(df.schema[name].dataType) == "integral"
    q = _quartile_struct(df, name)
    s = _values(df, name).agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")
    ).where("n > 0")
    n = F.col("n").cast("double")
    span = F.col("hi") - F.col("lo")
    by_count = span / (F.log2(n) + 1)
    by_spread = (q[2] - q[0]) * 2.0 / F.pow(n, F.lit(1 / 3))
    width = F.when(by_spread > 0, F.least(by_spread, by_count)).otherwise(by_count)
    if whole:
        width = F.greatest(width, F.lit(1.0))
    flat = span == 0
    bins = F.when(flat, F.lit(1)).otherwise(F.ceil(F.try_divide(span, F.col("target"))))
    return (
        s.withColumn("target", width)
        .withColumn("bins", bins.cast("bigint"))
        .withColumn("lo", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")))
        .withColumn("hi", F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")))
        .select("n", "lo", "hi", ((F.col("hi") - F.col("lo")) / F.col("bins")).alias("width"), "bins")
    )


def _even_bins(df: DataFrame, name: str, bins: int) -> DataFrame:
    """The same row for a given number of bins, without a look at the quartiles."""
    s = _values(df, name).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    s = s.where("n > 0").withColumn("bins", F.lit(bins).cast("bigint")).withColumn("flat", flat)
    s = s.withColumn("lo", F.when(F.col("flat"), F.col("lo") - 0.5).otherwise(F.col("lo")))
    s = s.withColumn("hi", F.when(F.col("flat"), F.col("hi") + 0.5).otherwise(F.col("hi")))
    return s.select("n", "lo", "hi", ((F.col("hi") - F.col("lo")) / F.col("bins")).alias("width"), "bins")


def histogram(df: DataFrame, name: str, bins: int | str = "auto", empty: bool = True) -> DataFrame:
    """(bin, lo, hi, count); the last bin includes the maximum.

    The automatic width suits the bulk of the values, so a heavy tail may ask for
    very many bins, nearly all empty. ``empty=False`` returns those that hold values,
    at most one per distinct value; empty ones come from a range that is dealt to all tasks.
    """
    layout = bin_layout(df, name) if bins == "auto" else _even_bins(df, name, int(bins))
    one = layout.first()
    if one is None:
        return df.sparkSession.createDataFrame([], "bin bigint, lo double, hi double, count bigint")
    lo, width = F.lit(one["lo"]), F.lit(one["width"])
    place = F.least(F.floor((F.col("x") - lo) / width), F.lit(one["bins"] - 1))
    counts = _values(df, name).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    if empty:
        counts = df.sparkSession.range(one["bins"]).withColumnRenamed("id", "bin").join(counts, "bin", "left")
    edge = lambda k: lo + k * width
    return counts.select(
        "bin",
        edge(F.col("bin")).alias("lo"),
        edge(F.col("bin") + 1).alias("hi"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def kde(df: DataFrame, name: str, grid: int = 200) -> DataFrame:
    """(point, x, density): Gaussian density on a grid from minimum to maximum, bandwidth std * n^(-1/5).

    Values are gathered into cells of 1/128 bandwidth, of which only those that hold values exist, however far a tail reaches. Each
    stands at its mean with its variance, which leaves an error below 10^-7 of the curve's peak, and reaches the points of the grid within eight
    bandwidths; beyond, the kernel is below 10^-14. A constant has no bandwidth and gives no rows.
    """
    v = _values(df, name)
    s = v.agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.min("x").alias("lo"),
        F.max("x").alias("hi"),
        F.stddev_samp("x").alias("sd"),
    )
    one = s.first()
    if not one["sd"] or not math.isfinite(one["sd"]):
        return df.sparkSession.createDataFrame([], "point int, x double, density double")
    n, lo, sd = one["n"], one["lo"], one["sd"]
    h, step = sd * n**-0.2, (one["hi"] - lo) / (grid - 1)
    cell = F.floor((F.col("x") - F.lit(lo)) / F.lit(h / CELLS_PER_BANDWIDTH))
    # Sums about the cell's own edge keep their digits far from zero.
    off = F.col("x") - F.lit(lo) - F.col("cell") * F.lit(h / CELLS_PER_BANDWIDTH)
    cells = v.withColumn("cell", cell).groupBy("cell").agg(F.count(F.lit(1)).alias("w"), F.avg(off).alias("d"), F.var_pop(off).alias("var"))
    at_cell = F.lit(lo) + F.col("cell") * F.lit(h / CELLS_PER_BANDWIDTH) + F.col("d")
    first = F.greatest(F.ceil((F.col("m") - F.lit(lo + REACH * h)) / F.lit(step)), F.lit(0))
    last = F.least(F.floor((F.col("m") - F.lit(lo - REACH * h)) / F.lit(step)), F.lit(grid - 1))
    near = cells.withColumn("m", at_cell).withColumn("first", first.cast("int")).withColumn("last", last.cast("int"))
    spread = near.where("first <= last").select("w", "m", "var", F.explode(F.sequence("first", "last")).alias("point"))
    z = (F.lit(lo) + F.col("point") * F.lit(step) - F.col("m")) / F.lit(h)
    kernel = F.exp(-0.5 * z * z) * (1 + 0.5 * (z * z - 1) * F.col("var") / F.lit(h * h))
    sums = spread.select("point", (F.col("w") * kernel).alias("k")).groupBy("point").agg(F.sum("k").alias("k"))
    points = F.broadcast(df.sparkSession.range(grid).select(F.col("id").cast("int").alias("point")))
    return points.join(sums, "point", "left").select(
        "point",
        (F.lit(lo) + F.col("point") * F.lit(step)).alias("x"),
        (F.coalesce("k", F.lit(0.0)) / F.lit(n * h * math.sqrt(2 * math.pi))).alias("density"),
    )


def outlier_bounds(df: DataFrame, name: str) -> DataFrame:
    """(q1, q3, lower_bound, upper_bound)."""
    df, facts = _number_facts(df, [name])
    q = F.col("quartiles")
    lo, hi = iqr_bounds(q[0], q[2])
    found = _quartiles(df, facts)
    return found.select(q[0].alias("q1"), q[2].alias("q3"), lo.alias("lower_bound"), hi.alias("upper_bound"))


def boxplot(df: DataFrame, name: str) -> DataFrame:
    """(q1, median, q3, whisker_low, whisker_high, fliers): whiskers are the furthest points inside the bounds."""
    q = _quartile_struct(df, name)
    lo, hi = iqr_bounds(q[0], q[2])
    inside = F.col("x").between(lo, hi)
    s = _values(df, name).agg(
        F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
        F.count_if(~inside).alias("fliers"),
    )
    return s.select(q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"), "whisker_low", "whisker_high", "fliers")


def fliers(df: DataFrame, name: str) -> DataFrame:
    """The rows outside the whiskers."""
    q = _quartile_struct(df, name)
    lo, hi = iqr_bounds(q[0], q[2])
    x = col(name).cast("double")
    return df.where((x < lo) | ((x > hi) & ~F.isnan(x)))


def category_counts(df: DataFrame, name: str, k: int = 10) -> DataFrame:
    """(value, count) of the k most frequent values."""
    return (
        normalise(df.select(col(name)))
        .where(col(name).isNotNull())
        .groupBy(col(name).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "value")
        .limit(k)
    )


def _borders(df: DataFrame, order_by: str, n: int, bands: int) -> list[tuple[int, object]]:
    """(band, first key) of each band that has rows, in order; row r of n, from 0, lies in band r * bands // n.

    Numbers and times: keys are counted in equal bins of their range, and bins that hold a border are divided again, until few keys
    are left in them, which alone are ranked. Other keys are ranked by a range partition.
    """
    kind = kind_of(df.schema[order_by].dataType)
    wanted = sorted({-(-b * n // bands): b for b in range(bands) if -(-b * n // bands) < n and (-(-b * n // bands)) * bands // n == b}.items())
    if kind not in ("integral", "time", "float"):
        place = (F.col("rank") - 1) * bands
        keys = global_rank(df.select(col(order_by).alias("_k")), [F.col("_k")], n // ROWS_PER_SLICE + 1)
        found = keys.select("_k", F.floor(place / F.lit(max(n, 1))).alias("band")).groupBy("band").agg(F.min("_k").alias("first"))
        return sorted((r["band"], r["first"]) for r in found.collect())  # at most ``bands`` rows
    value = col(order_by) if kind != "time" else F.unix_micros(col(order_by).cast("timestamp"))
    keys = df.select(value.alias("x"), col(order_by).alias("_k"))
    ends = keys.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    # Pieces of the range with the borders inside: (lo, hi, rows before, ranks wanted).
    pieces = [(ends["lo"], ends["hi"], 0, [r for r, _ in wanted])] if wanted else []
    left = n
    while pieces and left > RANKED_KEYS:
        bins = max(2, BORDER_BINS // len(pieces))
        inside, no, place = _in_pieces(pieces, bins, kind)
        counts = keys.where(inside).groupBy(no.alias("p"), place.alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")
        )
        finer, per_piece = [], {}
        for r in counts.collect():  # at most BORDER_BINS rows
            per_piece.setdefault(r["p"], []).append(r)
        for p, (_, _, before, ranks) in enumerate(pieces):
            for r in sorted(per_piece.get(p, []), key=lambda r: r["lo"]):
                here = [k for k in ranks if before <= k < before + r["n"]]
                if here:
                    finer.append((r["lo"], r["hi"], before, here, r["n"]))
                before += r["n"]
        now = sum(f[4] for f in finer)
        pieces = [f[:4] for f in finer]
        if now >= left:
            break  # bins hold one value each, as far as numbers can tell
        left = now
    if not pieces:
        return []
    inside, no, _ = _in_pieces(pieces, 2, kind)
    ranked = keys.where(inside).select(no.alias("p"), "_k", F.row_number().over(W.partitionBy(no).orderBy("_k")).alias("r"))
    before = F.get(F.array(*(F.lit(p[2]).cast("bigint") for p in pieces)), F.col("p"))
    hit = ranked.withColumn("rank", F.col("r") - 1 + before).where(F.col("rank").isin([k for p in pieces for k in p[3]]))
    band_of = dict(wanted)
    return sorted((band_of[r["rank"]], r["_k"]) for r in hit.select("rank", "_k").collect())


def _in_pieces(pieces: list[tuple], bins: int, kind: str) -> tuple[Column, Column, Column]:
    """Whether ``x`` lies in a piece, the number of that piece, and its bin inside."""
    typed = (lambda v: F.lit(float(v))) if kind == "float" else (lambda v: F.lit(int(v)).cast("bigint"))
    lows = F.array(*(typed(p[0]) for p in pieces))
    highs = F.array(*(typed(p[1]) for p in pieces))
    x = F.col("x")
    # Pieces are in order: the last one that begins at or before x.
    no = F.size(F.filter(lows, lambda v: v <= x)) - 1
    lo, hi = F.get(lows, no), F.get(highs, no)
    share = F.coalesce(F.try_divide((x - lo).cast("double"), (hi - lo).cast("double")), F.lit(0.0))
    return (no >= 0) & (x <= hi), no, F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")


def missing_raster(df: DataFrame, order_by: str, bands: int = 100) -> DataFrame:
    """(band, name, null_rate): share of missing cells in equal bands of the row order.

    ``order_by`` must be unique and present.
    """
    df = normalise(df)
    cols = fields(df)
    key = col(order_by)
    n = df.count()
    nulls = [f.value.isNull().cast("int").alias(f"n{f.ordinal}") for f in cols]
    # Rows find their band among at most ``bands`` borders: the key that begins it.
    starts = [(b, k) for b, k in _borders(df, order_by, n, bands)]
    kind = df.schema[order_by].dataType
    firsts = F.array(*(F.lit(first).cast(kind) for _, first in starts))
    band = F.get(F.array(*(F.lit(b).cast("bigint") for b, _ in starts)), F.size(F.filter(firsts, lambda b: b <= F.col("_k"))) - 1)
    rows = df.select(key.alias("_k"), *nulls)
    cells = F.array(
        *(F.struct(F.lit(f.name).alias("name"), F.col(f"r{f.ordinal}").alias("null_rate")) for f in cols)
    )
    return (
        rows.groupBy(band.alias("band"))
        .agg(*(F.avg(f"n{f.ordinal}").alias(f"r{f.ordinal}") for f in cols))
        .select("band", F.inline(cells))
    )


def missing_patterns(df: DataFrame) -> DataFrame:
    """(pattern, n_rows): one mark per column in table order, 1 for missing."""
    df = normalise(df)
    mask = F.concat(*(F.when(f.value.isNull(), F.lit("1")).otherwise(F.lit("0")) for f in fields(df)))
    return df.groupBy(mask.alias("pattern")).agg(F.count(F.lit(1)).alias("n_rows"))
