"""Benchmark decontamination: a prefix-filtered containment join of benchmark windows with documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.values import col

WINDOW_WORDS = 10
SHINGLE_WORDS = 3
#: Benchmark words held in memory at once. A larger benchmark is taken in several blocks, one pass each.
BLOCK_WORDS = 1_000_000

# ASCII letters lose their case, other ASCII characters but digits part words, the rest are letters.
WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []


@dataclass
class Windows:
    """The windows of a block of items, over word numbers 1, 2, ... (0: a word of no item)."""

    vocabulary: dict[bytes, int]
    ids: np.ndarray  # windows x window words, 0 after the end
    lengths: np.ndarray
    items: list[str]
    item: list[list[int]]  # per window, the places of its items
    shingle: np.ndarray  # windows x shingles per window, -1 after the end
    known: np.ndarray  # all shingles, sorted


def combined(ids: np.ndarray, q: int, base: int) -> np.ndarray:
    """Number of each run of q words; 0 where one of them is in no item."""
    n = max(0, len(ids) - q + 1)
    key = np.zeros(n, np.int64)
    whole = np.ones(n, bool)
    for k in range(q):
        part = ids[k : k + n]
        key = key * base + part
        whole &= part > 0
    return np.where(whole, key, 0)


def windows_of(rows: list[tuple[str, list[bytes]]], window: int) -> Windows:
    vocabulary: dict[bytes, int] = {}
    ids, lengths, items, item = [], [], [], []
    at: dict[tuple[int, ...], int] = {}
    for name, words in rows:
        if not words:
            continue
        numbers = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
        size = min(window, len(numbers))
        for k in range(len(numbers) - size + 1):
            run = tuple(numbers[k : k + size])
            place = at.setdefault(run, len(ids))
            if place == len(ids):
                ids.append([*run, *[0] * (window - size)])
                lengths.append(size)
                item.append([])
            if len(items) not in item[place][-1:]:
                item[place].append(len(items))
        items.append(name)
    matrix = np.array(ids, np.int64).reshape(-1, window)
    sizes = np.array(lengths, np.int64)
    base = len(vocabulary) + 1
    shingle = np.full(matrix.shape, -1, np.int64)
    for k, (row, size) in enumerate(zip(matrix, sizes, strict=True)):
        found = combined(row[:size], min(SHINGLE_WORDS, size), base)
        shingle[k, : len(found)] = found
    known = np.unique(shingle[shingle >= 0])
    return Windows(vocabulary, matrix, sizes, items, item, shingle, known)


def shingle_places(w: Windows, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a document has shingles of the benchmark, and which (as places in ``w.known``)."""
    at, which = [], []
    for q in np.unique(np.minimum(SHINGLE_WORDS, w.lengths)):
        keys = combined(ids, int(q), len(w.vocabulary) + 1)
        pos = np.flatnonzero(keys)
        if len(pos):
            k = np.minimum(np.searchsorted(w.known, keys[pos]), len(w.known) - 1)
            hit = w.known[k] == keys[pos]
            at.append(pos[hit])
            which.append(k[hit])
    none = np.empty(0, np.int64)
    return (np.concatenate(at), np.concatenate(which)) if at else (none, none)


def numbered(w: Windows, text: str | None) -> np.ndarray:
    words = split_words(text)
    get = w.vocabulary.get
    return np.fromiter((get(x, 0) for x in words), np.int64, len(words))


def shingle_counter(w: Windows):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(w.known), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                _, which = shingle_places(w, numbered(w, text))
                total += np.bincount(which, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["shingle", "n"])

    return count


def prefixes(w: Windows, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An index from shingle to the windows whose rarest shingle it is: bounds, window, offset in it.

    A window occurs only if all of its shingles do, so one, the rarest, is a sufficient prefix.
    """
    place = np.searchsorted(w.known, np.maximum(w.shingle, 0))
    rarity = np.where(w.shingle >= 0, counts[np.minimum(place, len(counts) - 1)], np.iinfo(np.int64).max)
    offset = rarity.argmin(1)
    of = place[np.arange(len(place)), offset]
    order = np.argsort(of, kind="stable")
    bounds = np.searchsorted(of[order], np.arange(len(w.known) + 1))
    return bounds, order, offset[order]


def matcher(w: Windows, counts: np.ndarray):
    bounds, window, offset = prefixes(w, counts)
    reach = np.arange(w.ids.shape[1])

    def match(text: str | None) -> tuple[int, list[int], list[str]]:
        ids = numbered(w, text)
        n = len(ids)
        at, which = shingle_places(w, ids)
        many = bounds[which + 1] - bounds[which]
        if not many.sum():
            return n, [], []
        at = np.repeat(at, many)
        k = np.repeat(bounds[which] - np.cumsum(many) + many, many) + np.arange(many.sum())
        win, start = window[k], at - offset[k]
        inside = (start >= 0) & (start + w.lengths[win] <= n)
        win, start = win[inside], start[inside]
        seen = ids[np.minimum(start[:, None] + reach, max(n - 1, 0))]
        same = ((seen == w.ids[win]) | (reach >= w.lengths[win][:, None])).all(1)
        win, start = win[same], start[same]
        if not len(win):
            return n, [], []
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, start, 1)
        np.add.at(change, start + w.lengths[win], -1)
        hit = np.cumsum(change)[:n] > 0
        edges = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
        return n, edges.tolist(), sorted({w.items[x] for k in np.unique(win) for x in w.item[k]})

    @F.pandas_udf("n_words long, edges array<long>, items array<string>")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([match(t) for t in texts], columns=["n_words", "edges", "items"])

    return of


@F.pandas_udf(T.ArrayType(T.LongType()))
def joined_edges(a: pd.Series, b: pd.Series) -> pd.Series:
    """Union of two lists of half-open ranges, each given as start, end, start, end, ..."""

    def join(x, y):
        out: list[int] = []
        for s, e in sorted([*zip(x[::2], x[1::2], strict=True), *zip(y[::2], y[1::2], strict=True)]):
            if out and s <= out[-1]:
                out[-1] = max(out[-1], int(e))
            else:
                out += [int(s), int(e)]
        return out

    return pd.Series([join(x, y) for x, y in zip(a, b, strict=True)])


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW_WORDS,
    block_words: int = BLOCK_WORDS,
) -> Column:
    """A column over ``docs``: struct of n_words, edges (start, end, ... of hit word ranges), items (found, sorted).

    Words are runs of ASCII letters (case folded), digits and all other characters from U+0080 on. An
    item's windows are its runs of ``window`` words; an item with fewer, but not none, is one window.
    Shingles are ordered by rarity, counted over all documents; a window is tried only where its rarest
    shingle stands, if it fits between the ends of the document there, and then compared word by word.

    Null and wordless texts have no words and no hits; null and wordless items have no windows. A null
    item is named by the empty string; items that share a name count once. Other columns are not read.
    The benchmark is read in blocks of about ``block_words`` words, so what each task holds is bounded;
    repeated rows of it are read once;
    documents are scanned twice per block and never shuffled.
    """
    sized = benchmark.select(
        F.coalesce(col(item).cast("string"), F.lit("")).alias("name"), F.coalesce(col(item_text), F.lit("")).alias("text")
    )
    sized = sized.distinct()
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (6 * block_words)))
    sized = sized.withColumn("block", F.pmod(F.xxhash64("name", "text"), F.lit(blocks)))
    found = None
    for b in range(blocks):
        w = windows_of([(r.name, split_words(r.text)) for r in sized.where(F.col("block") == b).orderBy("name").collect()], window)
        if not len(w.ids):
            continue
        rows = docs.select(col(text).alias("text")).mapInArrow(shingle_counter(w), "shingle long, n long")
        counts = np.zeros(len(w.known), np.int64)
        # At most one row per shingle of the block.
        for r in rows.groupBy("shingle").agg(F.sum("n").alias("n")).collect():
            counts[r.shingle] = r.n
        here = matcher(w, counts)(col(text))
        found = here if found is None else F.struct(
            here["n_words"].alias("n_words"),
            joined_edges(found["edges"], here["edges"]).alias("edges"),
            F.array_sort(F.array_union(found["items"], here["items"])).alias("items"),
        )
    if found is None:
        empty = windows_of([("", [b"-"])], window)  # no document has this word
        found = matcher(empty, np.zeros(1, np.int64))(col(text))
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: key, n_words, spans (hit word ranges, end excluded) and items."""
    found = docs.select(col(key), contamination(docs, benchmark, text, **options).alias("found_"))
    spans = F.expr("transform(sequence(1, cast(size(found_.edges) / 2 as int)), k -> struct(found_.edges[2*k-2] as start, found_.edges[2*k-1] as end))")
    return found.select(
        col(key),
        F.col("found_.n_words").alias("n_words"),
        F.when(F.size("found_.edges") > 0, spans).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"),
        F.col("found_.items").alias("items"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without any window of the benchmark, all columns as they are."""
    return docs.where(F.size(contamination(docs, benchmark, text, **options)["edges"]) == 0)
