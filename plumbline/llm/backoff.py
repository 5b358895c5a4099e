"""Language-model scoring: stupid backoff over n-gram count tables partitioned by hash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.values import col
from plumbline.llm.common import row_key

ORDER = 3
#: An n-gram of two or more words that occurs less often in the corpus counts as unseen.
MIN_COUNT = 1
BACKOFF = 0.4
#: Text bytes of a batch of documents, and n-grams of a part of the count tables, on average.
BATCH_BYTES = 16 << 20
PART_GRAMS = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """The words of a batch of texts as 64-bit hashes, one text after the other, and their n-grams."""

    def __init__(self, texts: list[str | None], order: int):
        known: dict[bytes, int] = {}
        each = []
        for text in texts:
            # bytes.split() parts at exactly the six ASCII separators.
            words = text.encode("utf-8", "replace").split() if text else []
            for w in set(words).difference(known):
                known[w] = xxhash.xxh64_intdigest(w, 29)
            each.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        self.lengths = np.array([len(e) for e in each], np.int64)
        h = np.concatenate(each) if each else np.empty(0, np.uint64)
        place = np.arange(len(h)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        #: Per n, where n-grams end, and their hashes.
        self.ends, self.hashes = [np.arange(len(h))], [h]
        with np.errstate(over="ignore"):
            at_end = h
            for n in range(2, order + 1):
                left = np.r_[np.zeros(1, np.uint64), at_end[:-1]]
                x = (left ^ (left >> np.uint64(29))) * MIX + h * np.uint64(2 * n + 1)
                at_end = x ^ (x >> np.uint64(32))
                self.ends.append(np.flatnonzero(place >= n - 1))
                self.hashes.append(at_end[self.ends[-1]])

    def all(self) -> np.ndarray:
        return np.concatenate(self.hashes)


def pack(counts: np.ndarray) -> bytes:
    """A byte per count, and eight more for each from 255 on."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.int64).tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, np.int64, offset=n) if len(data) > n else 255
    return out


def part_bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where the sorted keys of each part begin: parts are equal ranges of the hash."""
    edges = (np.arange(1, parts, dtype=object) * (1 << 64) // parts).astype(np.uint64)
    return np.r_[0, np.searchsorted(keys, edges), len(keys)]


def requests(order: int, parts: int):
    """Per batch, a row for each part that it has n-grams of: hashes in order, and how often each occurs."""

    def of(docs: pa.Table) -> pa.Table:
        keys, counts = np.unique(Grams(docs["text"].to_pylist(), order).all(), return_counts=True)
        at = part_bounds(keys, parts)
        some = np.flatnonzero(np.diff(at))
        return pa.table(
            {
                "part": pa.array(some, pa.int64()),
                "batch": pa.array([docs["batch"][0].as_py()] * len(some), pa.int64()),
                "keys": pa.array([keys[at[p] : at[p + 1]].tobytes() for p in some], pa.binary()),
                "counts": pa.array([pack(counts[at[p] : at[p + 1]]) for p in some], pa.binary()),
            }
        )

    return of


def answers(table: pa.Table) -> pa.Table:
    """One part of the count table: sums over all batches, given back to each batch in the order of its hashes."""
    keys = [np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()]
    counts = [unpack(x, len(k)) for x, k in zip(table["counts"].to_pylist(), keys, strict=True)]
    every, where = np.unique(np.concatenate(keys), return_inverse=True)
    # Sums of whole numbers are exact up to 2^53.
    total = np.bincount(where, np.concatenate(counts), len(every)).astype(np.int64)
    ends = np.cumsum([len(k) for k in keys])
    given = [pack(total[w]) for w in np.split(where, ends[:-1])]
    return pa.table({"batch": table["batch"], "part": table["part"], "totals": pa.array(given, pa.binary())})


def scores(order: int, parts: int, min_count: int, backoff: float, corpus_words: int):
    """Cogroups a batch of documents with its counts and sums over each document."""

    def of(docs: pa.Table, totals: pa.Table) -> pa.Table:
        grams = Grams(docs["text"].to_pylist(), order)
        keys, where = np.unique(grams.all(), return_inverse=True)
        at = part_bounds(keys, parts)
        total = np.zeros(len(keys), np.int64)
        for p, data in zip(totals["part"].to_pylist(), totals["totals"].to_pylist(), strict=True):
            total[at[p] : at[p + 1]] = unpack(data, at[p + 1] - at[p])
        counts = np.split(total[where].astype(float), np.cumsum([len(h) for h in grams.hashes])[:-1])
        # ln S of each word: that of the longest n-gram seen often enough, with a factor for each step back.
        best = np.log(counts[0] / corpus_words)
        context = counts[0]
        for ends, c in zip(grams.ends[1:], counts[1:], strict=True):
            seen = c >= min_count
            best[ends] += np.log(backoff)
            best[ends[seen]] = np.log(c[seen] / context[ends[seen] - 1])
            context = np.zeros(len(best))
            context[ends] = c
        some = grams.lengths > 0
        sums = np.zeros(len(grams.lengths))
        if some.any():
            sums[some] = np.add.reduceat(best, (np.cumsum(grams.lengths) - grams.lengths)[some])
        return pa.table({"key": docs["key"], "n_words": pa.array(grams.lengths), "log_score": pa.array(sums)})

    return of


def scored(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    order: int = ORDER,
    min_count: int = MIN_COUNT,
    backoff: float = BACKOFF,
    batch_bytes: int = BATCH_BYTES,
    part_grams: int = PART_GRAMS,
) -> DataFrame:
    """One row per row of ``df``: key, n_words and log_score, the sum of ln S over the text's words.

    S of a word after its context is count(n-gram) / count(context) for the longest n-gram (at most ``order``
    words, inside the text) that occurs ``min_count`` times in all texts, times ``backoff`` for each shorter step; for a
    single word, its count over the number of all words.

    Documents are dealt to batches by a hash of the row. Each batch asks for its distinct n-grams, a row
    of hashes and numbers per part of the count table; a part (a range of hashes) sums what all batches have and
    answers each. An n-gram is one entry of a batch however frequent, so none is hot, and counts cover all rows.
    Null and wordless texts have 0 words and score 0. Repeated rows count and score each. A table without any
    word scores 0 throughout; an empty table gives an empty result. Other columns only spread the rows.
    """
    size, n_words = df.agg(
        F.sum(F.octet_length(col(text)).cast("long")),
        F.sum(F.regexp_count(col(text), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")),
    ).first()
    batches = max(1, -(-(size or 0) // batch_bytes))
    parts = max(1, -(-(n_words or 0) * order // part_grams))
    k1, _ = row_key(df)
    rows = df.select(F.pmod(k1, F.lit(batches)).alias("batch"), col(key).alias("key"), col(text).alias("text"))
    # Both uses read all three columns, so that one shuffle of the texts serves them.
    rows = rows.repartition("batch")
    asked = rows.groupBy("batch").applyInArrow(
        requests(order, parts), "part long, batch long, keys binary, counts binary"
    )
    given = asked.groupBy("part").applyInArrow(answers, "batch long, part long, totals binary")
    kind = df.schema[key].dataType.simpleString()
    return rows.groupBy("batch").cogroup(given.groupBy("batch")).applyInArrow(
        scores(order, parts, min_count, backoff, max(1, n_words or 0)), f"key {kind}, n_words long, log_score double"
    ).withColumnRenamed("key", key)
