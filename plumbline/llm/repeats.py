"""Passages that repeat across documents, by a sparse suffix array over minimiser positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.values import col
from plumbline.session import settle

#: Words that a passage has at least, and words of the grams whose smallest hash marks a position.
MIN_WORDS = 50
GRAM_WORDS = 8
#: A gram at more positions than this is not compared in one task.
SPLIT_ABOVE = 50_000
MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0xD1342543DE82EF95)
#: 1 / BASE modulo 2^64.
BASE_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
SEPARATOR = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: A number for each byte.
BYTES = np.random.default_rng(9).integers(1, 2**63, 256, dtype=np.int64).view(np.uint64)
PLACE = np.uint64((1 << 26) - 1)
NO_DOC = np.iinfo(np.int64).max


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


class Powers:
    """Powers of the base and of its inverse, as many as were needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            self.up, self.down = (
                np.multiply.accumulate(np.r_[np.ones(1, np.uint64), np.full(size - 1, b)]) for b in (BASE, BASE_INVERSE)
            )
        return self.up[:n], self.down[:n]


def word_hashes(text: str | None, powers: Powers) -> np.ndarray:
    """A hash of each run of bytes between the six ASCII separators, from prefix sums of a polynomial."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    edges = np.flatnonzero(np.diff(np.r_[False, ~SEPARATOR[data], False].astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(len(data) + 1)
    sums = np.r_[np.zeros(1, np.uint64), np.add.accumulate(BYTES[data] * up[:-1])]
    return mixed((sums[ends] - sums[starts]) * down[starts])


def runs_hash(h: np.ndarray, size: int, powers: Powers) -> np.ndarray:
    """A hash of each run of ``size`` words, in the same way."""
    up, down = powers(len(h) + 1)
    sums = np.r_[np.zeros(1, np.uint64), np.add.accumulate(h * up[:-1])]
    n = len(h) - size + 1
    return mixed((sums[size:] - sums[:n]) * down[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values, by running minima forwards and backwards in blocks."""
    n = len(x)
    pad = -n % width
    y = np.r_[x, np.full(pad, np.iinfo(np.uint64).max)].reshape(-1, width)
    forward = np.minimum.accumulate(y, axis=1).ravel()
    backward = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def minimisers(h: np.ndarray, passage: int, gram: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each gram, and for each window of ``passage`` words the place of its smallest gram (of equals, the last).

    The choice depends on the window's words alone, so equal windows choose alike.
    """
    grams = runs_hash(h, gram, powers)
    # The place stands in the low bits: the smallest key is unique.
    keys = (mixed(grams) & ~PLACE) | (PLACE - np.arange(len(grams), dtype=np.uint64) % (PLACE + np.uint64(1)))
    low = sliding_min(keys, passage - gram + 1)
    chosen = (PLACE - (low & PLACE)).astype(np.int64)
    if len(grams) > int(PLACE):
        # Places are known up to a multiple of 2^26; the window says which.
        starts = np.arange(len(low))
        chosen += (starts - chosen + int(PLACE)) // (int(PLACE) + 1) * (int(PLACE) + 1)
    return grams, chosen


TEXTS = "t1 long, t2 long, doc long, text string"


def sampler(passage: int, gram: int):
    """(g, t1, t2, pos): each chosen place of each text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            t1, t2 = batch.column("t1").to_numpy(), batch.column("t2").to_numpy()
            g, rows, places = [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                h = word_hashes(text, powers)
                if len(h) < passage:
                    continue
                grams, chosen = minimisers(h, passage, gram, powers)
                at = chosen[np.r_[True, chosen[1:] != chosen[:-1]]]
                g.append(grams[at])
                places.append(at)
                rows.append(np.full(len(at), k))
            if g:
                r = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(g).view(np.int64)), pa.array(t1[r]), pa.array(t2[r]), pa.array(np.concatenate(places))],
                    names=["g", "t1", "t2", "pos"],
                )

    return of


def window_lister(passage: int, gram: int):
    """(g, many, t1, t2, doc, start, windows): for the places asked for, the hashes of the windows that choose them."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            out: list[tuple] = []
            cols = [batch.column(c).to_pylist() for c in ("t1", "t2", "doc", "text", "places")]
            for t1, t2, doc, text, places in zip(*cols, strict=True):
                h = word_hashes(text, powers)
                grams, chosen = minimisers(h, passage, gram, powers)
                windows = runs_hash(h, passage, powers)
                starts = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
                ends = np.r_[starts[1:], len(chosen)]
                many = {p["pos"]: p["many"] for p in places}
                for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                    pos = int(chosen[s])
                    if pos in many:
                        g = int(grams[pos : pos + 1].view(np.int64)[0])
                        out.append((g, many[pos], t1, t2, NO_DOC if doc is None else doc, s, windows[s:e].tobytes()))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=LISTED)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=LISTED)

    return of


LISTED = ["g", "many", "t1", "t2", "doc", "start", "windows"]
LISTED_TYPE = "g long, many boolean, t1 long, t2 long, doc long, start long, windows binary"
FOUND_NAMES = ["t1", "t2", "lo", "hi", "first", "value"]
FOUND = "t1 long, t2 long, lo long, hi long, first long, value long"
#: Tasks that share the positions of a gram at too many of them.
SALTS = 64


def unpacked(rows: list[tuple]) -> tuple[np.ndarray, ...]:
    """Hash, row, start of each window of some listed rows."""
    windows = [np.frombuffer(r[-1], np.uint64) for r in rows]
    sizes = np.array([len(w) for w in windows])
    row = np.repeat(np.arange(len(rows)), sizes)
    first = np.array([r[-2] for r in rows])
    start = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[row]
    return np.concatenate(windows), row, start


def shared_ranges(rows: list[tuple]) -> pa.RecordBatch | None:
    """Ranges of window starts whose windows stand in two texts or more, with the smallest document of these.

    The windows are sorted; equal ones are neighbours. Neighbouring starts join to a range, which
    is how a match extends left and right of its position.
    """
    value, row, start = unpacked(rows)
    text = np.array([r[0] for r in rows], np.int64)[row]
    doc = np.array([r[2] for r in rows], np.int64)[row]
    order = np.lexsort((text, value))
    v, t = value[order], text[order]
    begins = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    changes = np.r_[0, np.cumsum((v[1:] == v[:-1]) & (t[1:] != t[:-1]))]
    ends = np.r_[begins[1:], len(v)]
    several = changes[ends - 1] > changes[begins]
    first = np.minimum.reduceat(doc[order], begins)
    group = np.repeat(np.arange(len(begins)), ends - begins)
    keep = several[group]
    if not keep.any():
        return None
    at = order[keep]
    r, s, f = row[at], start[at], first[group[keep]]
    back = np.lexsort((s, r))
    r, s, f = r[back], s[back], f[back]
    new = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)])
    last = np.r_[new[1:], len(r)] - 1
    t1, t2 = (np.array([x[k] for x in rows], np.int64) for k in (0, 1))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(t1[r[new]]), pa.array(t2[r[new]]), pa.array(s[new]), pa.array(s[last]),
            pa.array(np.minimum.reduceat(f, new)), pa.nulls(len(new), pa.int64()),
        ],
        names=FOUND_NAMES,
    )


def one_by_one(rows: list[tuple]) -> pa.RecordBatch:
    """A row per window, with its hash: to be counted by all tasks together."""
    value, row, start = unpacked(rows)
    t1, t2, doc = (np.array([r[k] for r in rows], np.int64)[row] for k in (0, 1, 2))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (t1, t2, start, start, doc, value.view(np.int64))], names=FOUND_NAMES)


def neighbour_finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by gram: compares the windows of each gram once all its rows are there."""
    held: list[tuple] = []
    gram = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in LISTED]
        ready: list[tuple] = []
        crowded: list[tuple] = []
        for g, many, *row in zip(*columns, strict=True):
            if many:
                crowded.append(tuple(row))
                continue
            if g != gram:
                if len(held) > 1:
                    ready += held
                held, gram = [], g
            held.append(tuple(row))
        if crowded:
            yield one_by_one(crowded)
        # Windows of different grams differ, so all ready rows are compared at once.
        if ready and (out := shared_ranges(ready)) is not None:
            yield out
    if len(held) > 1 and (out := shared_ranges(held)) is not None:
        yield out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "end", "first_doc")])))
def merged_spans(ranges: pd.Series) -> pd.Series:
    """Overlapping ranges of windows as ranges of words; (start, end, smallest document)."""

    def merge(items):
        out: list[list[int]] = []
        for x in sorted((r["lo"], r["end"], r["first"]) for r in items):
            if out and x[0] <= out[-1][1]:
                out[-1][1:] = [max(out[-1][1], x[1]), min(out[-1][2], x[2])]
            else:
                out.append(list(x))
        return [{"start": s, "end": e, "first_doc": None if f == NO_DOC else f} for s, e, f in out]

    return ranges.map(merge)


def repeated_passages(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_words: int = MIN_WORDS,
    gram_words: int = GRAM_WORDS,
    split_above: int = SPLIT_ABOVE,
) -> DataFrame:
    """One row per passage of ``min_words`` words or more that another document has too.

    Columns: the key, start and end (words, end excluded), n_words, first_doc (the smallest key among the
    documents that share some of it; null if none has one). Words are runs between white space. Passages that
    overlap or touch in a document are one row. A passage that repeats only inside a document is none.

    Of every ``min_words`` words, the last smallest gram of ``gram_words`` words marks a position: equal windows
    mark alike, and about one position in 22 is kept. Positions whose gram is alone go. At the others, the
    hashes of the windows that chose them are sorted and compared; consecutive matches extend to the whole
    passage. Equal texts are read once (their copies repeat whole), texts move once, and a gram at more than ``split_above``
    positions is compared by a distributed count of its windows instead of in one task.

    Null and short texts have no passages. Null keys take part. Repeated rows count as copies. An empty table gives an
    empty result. Other columns are not read.
    """
    if not 1 <= gram_words <= min_words:
        raise ValueError("a gram must fit into a passage")
    t = col(text)
    rows = df.where(t.isNotNull()).select(
        col(key).alias("key"), F.xxhash64(F.lit(1), t).alias("t1"), F.xxhash64(F.lit(2), t).alias("t2"), t.alias("text")
    )
    texts = rows.groupBy("t1", "t2").agg(F.min("key").cast("long").alias("doc"), F.first("text").alias("text"))

    # One query up to ``found``: all three uses of the texts read the same shuffle.
    samples = texts.select("t1", "t2", "text").mapInArrow(sampler(min_words, gram_words), "g long, t1 long, t2 long, pos long")
    often = samples.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    often = often.select("g", (F.col("n") > split_above).alias("many"))
    asked = samples.join(often, "g").groupBy("t1", "t2").agg(F.collect_list(F.struct("pos", "many")).alias("places"))
    listed = texts.join(asked, ["t1", "t2"]).mapInArrow(window_lister(min_words, gram_words), LISTED_TYPE)
    salt = F.when(F.col("many"), F.pmod(F.xxhash64("t1", "start"), F.lit(SALTS))).otherwise(F.lit(0))
    dealt = listed.repartition("g", salt).sortWithinPartitions("g")
    found = settle(dealt.mapInArrow(neighbour_finder, FOUND))

    ranges = found.where("value IS NULL").drop("value")
    crowded = found.where("value IS NOT NULL")
    if not crowded.isEmpty():
        classes = crowded.groupBy("value").agg(F.min("t1").alias("a"), F.max("t1").alias("b"), F.min("first").alias("least"))
        hits = crowded.join(classes.where("a <> b").select("value", "least"), "value")
        ranges = ranges.union(hits.select("t1", "t2", "lo", "hi", F.col("least").alias("first")))
    word_range = F.struct("lo", (F.col("hi") + min_words).alias("end"), "first")
    spans = ranges.groupBy("t1", "t2").agg(F.collect_list(word_range).alias("ranges"))

    # Copies repeat whole.
    sized = rows.withColumn("end", F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"))
    copies = sized.groupBy("t1", "t2").agg(F.count("*").alias("n"), F.min("key").cast("long").alias("first"), F.first("end").alias("end"))
    whole = copies.where((F.col("n") > 1) & (F.col("end") >= min_words)).select(
        "t1", "t2", F.array(F.struct(F.lit(0).cast("long").alias("lo"), "end", F.coalesce("first", F.lit(NO_DOC)).alias("first"))).alias("ranges")
    )
    spans = settle(spans.union(whole).groupBy("t1", "t2").agg(F.flatten(F.collect_list("ranges")).alias("ranges")))
    spans = spans.select("t1", "t2", F.explode(merged_spans("ranges")).alias("s"))
    out = rows.select("key", "t1", "t2").join(spans, ["t1", "t2"])
    return out.select(
        F.col("key").alias(key),
        F.col("s.start").alias("start"),
        F.col("s.end").alias("end"),
        (F.col("s.end") - F.col("s.start")).alias("n_words"),
        F.col("s.first_doc").alias("first_doc"),
    )
