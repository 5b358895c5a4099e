"""Documents whose word n-grams overlap by Jaccard similarity, found by PartEnum signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.values import col
from plumbline.llm.simhash import LOWER, components
from plumbline.session import settle

SHINGLE_WORDS = 3
#: Least similarity in percent.
PERCENT = 90
#: Groups of one signature with more sets than this are divided by a second, independent set of signatures.
CROWD = 4096
#: Buckets of text hashes: at most so many integers are broadcast to choose the texts that are read again.
BUCKETS = 1 << 20
#: Each later round looks this many times as far inside a group.
STRIDE = 16
#: Fewest cells of a sketch.
CELLS = 256
#: Bytes of sketches that are compared at a time.
COMPARED = 1 << 23
#: Largest set that bands are laid out for.
MOST = 1 << 40

U = np.uint64
GOLDEN, MIX_1, MIX_2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> U(30))) * MIX_1
    x = (x ^ (x >> U(27))) * MIX_2
    return x ^ (x >> U(31))


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-word shingles; fewer words are one shingle, none give an empty set."""
    # bytes.split() parts at exactly the six ASCII separators.
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, U)
    shingles = {b" ".join(s) for s in zip(*(words[i:] for i in range(n)), strict=False)} or {b" ".join(words)}
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles), U, len(shingles)))


def size_bands(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """First size of each band, and the most elements by which two similar sets may differ if the larger is in the band.

    Bands are as wide as similarity lets sizes differ, so similar sets lie in the same band or in neighbours.
    """
    starts, limits = [1], []
    while starts[-1] < MOST:
        last = starts[-1] * 100 // percent
        limits.append(2 * last * (100 - percent) // (100 + percent))
        starts.append(last + 1)
    return np.array(starts[:-1]), np.array(limits)


def signatures(h: np.ndarray, bands: tuple[np.ndarray, np.ndarray], seed: int) -> np.ndarray:
    """PartEnum signatures of a set: two sets of one band or of neighbours that are similar share at least one.

    They differ in at most k elements. The domain of hashes is cut into k // 2 + 1 parts, so one part holds
    at most one difference, and each part into three cells, so two of its cells hold none. Each choice of two
    cells of a part is a signature: the elements in them, with the band, part and choice. A set has them for its band and for
    the next, where it may meet larger ones. With k = 0 only equal sets are similar, which needs no signature.
    """
    if not len(h):
        return h
    starts, limits = bands
    own = int(np.searchsorted(starts, len(h), side="right")) - 1
    e = mixed(h + U(seed) * GOLDEN)
    high, low = e >> U(32), e & U(0xFFFFFFFF)
    out = []
    for band in (own, own + 1):
        k = int(limits[band])
        if not k:
            continue
        parts = k // 2 + 1
        cell = ((high * U(parts)) >> U(32)) * U(3) + ((low * U(3)) >> U(32))
        sums = np.zeros(parts * 3, U)
        np.add.at(sums, cell.astype(np.int64), mixed(e))
        three = sums.reshape(-1, 3)
        two = (three.sum(axis=1, keepdims=True) - three).reshape(-1)
        place = np.arange(parts * 3, dtype=U) + U(1) + (U(band) << U(40))
        out.append(mixed(two + mixed(place * GOLDEN + U(seed))))
    return np.concatenate(out) if out else np.empty(0, U)


def sketch(h: np.ndarray) -> bytes:
    """A bit per cell of hashes, whether their number is odd, with half as many cells as hashes or more.

    The bits of two sets differ in no more places than the sets have differing elements. Half of the cells, laid over the other, are the sketch in half
    as many cells.
    """
    cells = CELLS
    while 2 * cells < len(h):
        cells *= 2
    odd = np.bincount((h & U(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """Sketches of rows, in their own number of cells and in half of it: sets of like size have one of the two in common."""

    def __init__(self, values: list[bytes]):
        self.width = np.fromiter(map(len, values), np.int64, len(values))
        self.bits, self.place = {}, {}
        for w in np.unique(self.width):
            rows = np.flatnonzero(self.width == w)
            own = np.frombuffer(b"".join(values[r] for r in rows), U).reshape(len(rows), -1)
            self._put(int(w), rows, own)
            if w > CELLS // 8:
                half = own.shape[1] // 2
                self._put(int(w) // 2, rows, own[:, :half] ^ own[:, half:])

    def _put(self, w: int, rows: np.ndarray, bits: np.ndarray) -> None:
        if w not in self.bits:
            self.bits[w], self.place[w] = bits[:0], np.full(len(self.width), -1)
        self.place[w][rows] = len(self.bits[w]) + np.arange(len(rows))
        self.bits[w] = np.concatenate([self.bits[w], bits])

    def within(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether rows i and j, of sizes that percent allows, differ in ``limit`` bits or fewer."""
        width = np.minimum(self.width[i], self.width[j])
        out = np.zeros(len(i), bool)
        for w in np.unique(width):
            bits, place = self.bits[int(w)], self.place[int(w)]
            of = np.flatnonzero(width == w)
            step = max(1, COMPARED // int(w))
            for at in range(0, len(of), step):
                k = of[at : at + step]
                apart = np.bitwise_count(bits[place[i[k]]] ^ bits[place[j[k]]]).sum(axis=1, dtype=np.int64)
                out[k] = apart <= limit[k]
        return out


def near_sizes(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def most_apart(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Elements by which similar sets of these sizes may differ."""
    return (n + m) * (100 - percent) // (100 + percent)


def set_ids(h: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    x = xxhash.xxh3_128_intdigest(h.tobytes())
    return (x >> 64) - (1 << 63), (x & ((1 << 64) - 1)) - (1 << 63)


def signer(n: int, percent: int):
    """key, text hash, text -> key, text hash, size, set id, sketch, signatures (once per set and task)."""
    bands = size_bands(percent)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            size, d1, d2, sketches, sigs, ends = [], [], [], [], [], [0]
            for text in batch.column(2):
                h = shingle_set(text.as_py(), n)
                a, b = set_ids(h)
                new = len(h) > 0 and (a, b) not in seen
                size.append(len(h))
                d1.append(a)
                d2.append(b)
                # Copies inside a task are signed once: a large group of copies shrinks to a row per task.
                if new:
                    seen.add((a, b))
                    sigs.append(signatures(h, bands, 0).view(np.int64))
                    sketches.append(sketch(h))
                else:
                    sketches.append(None)
                ends.append(ends[-1] + (len(sigs[-1]) if new else 0))
            values = np.concatenate(sigs) if sigs else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                    pa.array(sketches, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)),
                ],
                names=["key", "text_hash", "n", "d1", "d2", "sketch", "sigs"],
            )

    return sign


def set_reader(n: int):
    """text -> set id and set, once per set and task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            rows = []
            for text in batch.column(0):
                h = shingle_set(text.as_py(), n)
                ids = set_ids(h)
                if len(h) and ids not in seen:
                    seen.add(ids)
                    rows.append((*ids, h.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))],
                names=["d1", "d2", "set"],
            )

    return read


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of set numbers whose sets are similar: every candidate is compared element by element."""

    @F.pandas_udf("boolean")
    def alike(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(left, right):
            a, b = np.frombuffer(a, U), np.frombuffer(b, U)
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * both >= percent * (len(a) + len(b) - both))
        return pd.Series(out, dtype=bool)

    left = sets.select(F.col("node").alias("u"), F.col("set").alias("left"))
    right = sets.select(F.col("node").alias("v"), F.col("set").alias("right"))
    return pairs.join(left, "u").join(right, "v").where(alike("left", "right")).select("u", "v")


def possible(pairs: DataFrame, about: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that size and sketches allow."""

    @F.pandas_udf("boolean")
    def allowed(n: pd.Series, left: pd.Series, m: pd.Series, right: pd.Series) -> pd.Series:
        n, m = n.to_numpy(), m.to_numpy()
        out = near_sizes(n, m, percent)
        i = np.flatnonzero(out)
        if len(i):
            rows = Sketches([left[k] for k in i] + [right[k] for k in i])
            out[i] = rows.within(np.arange(len(i)), np.arange(len(i)) + len(i), most_apart(n, m, percent)[i])
        return pd.Series(out)

    left = about.select(F.col("node").alias("u"), F.col("n").alias("n_u"), F.col("sketch").alias("left"))
    right = about.select(F.col("node").alias("v"), F.col("n").alias("n_v"), F.col("sketch").alias("right"))
    return pairs.join(left, "u").join(right, "v").where(allowed("n_u", "left", "n_v", "right")).select("u", "v")


def pair_finder(low: int, high: int, percent: int):
    """Over rows sorted by group: pairs of members ``low`` to ``high`` - 1 places apart, of different labels, that size and sketches allow.

    Holds back the last group of a batch until it is complete. Groups that lie together have pairs in common, which are given once.
    """

    def found(parts):
        group, node, label, n = (np.concatenate([p[i] for p in parts]) for i in range(4))
        sketches = Sketches([x for p in parts for x in p[4]])
        pairs = []
        for d in range(low, min(high, len(group))):
            same = group[d:] == group[:-d]
            if not same.any():
                break
            i = np.flatnonzero(same & (label[d:] != label[:-d]))
            i = i[near_sizes(n[i], n[i + d], percent)]
            i = i[sketches.within(i, i + d, most_apart(n[i], n[i + d], percent))]
            if len(i):
                pairs.append(np.sort(np.stack([node[i], node[i + d]], axis=1), axis=1))
        if pairs:
            pairs = np.unique(np.concatenate(pairs), axis=0)
            for at in range(0, len(pairs), 1 << 16):
                some = pairs[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(some[:, 0].copy()), pa.array(some[:, 1].copy())], names=["u", "v"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            cols.append(batch.column(4).to_pylist())
            group = cols[0]
            last = int(np.flatnonzero(group != group[-1])[-1] + 1) if group[0] != group[-1] else 0
            if held and (last or held[-1][0][-1] != group[0]):
                yield from found([*held, [c[:last] for c in cols]] if last else held)
                held = []
            elif last:
                yield from found([[c[:last] for c in cols]])
            held.append([c[last:] for c in cols])
        if held:
            yield from found(held)

    return find


def still_open(members: DataFrame) -> DataFrame:
    """(g, node, n, sketch, label, members) of the groups whose members are not yet all of one component."""
    group = Window.partitionBy("g")
    apart = members.withColumn("lo", F.min("label").over(group)).withColumn("hi", F.max("label").over(group))
    apart = apart.withColumn("members", F.count(F.lit(1)).over(group)).where("lo != hi")
    return settle(apart.select("g", "node", "n", "sketch", "label", "members"))


def relabelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.select("node", F.col("label").alias("l_"))
    return members.drop("label", "members").join(known, "node", "left").withColumn("label", F.coalesce("l_", "node")).drop("l_")


def divided(members: DataFrame, sets_of, crowd: int, percent: int) -> DataFrame:
    """Members of crowded groups meet only where a signature of a second, independent kind is equal too; similar sets share one."""
    crowded = members.where(F.col("members") > crowd)
    if crowded.isEmpty():
        return members
    bands = size_bands(percent)

    @F.pandas_udf("array<long>")
    def second(values: pd.Series) -> pd.Series:
        return pd.Series([signatures(np.frombuffer(v, U), bands, 1).view(np.int64) for v in values])

    of = sets_of(crowded.select("node").distinct()).select("node", second("set").alias("sigs"))
    parted = crowded.join(of, "node").withColumn("s", F.explode("sigs")).withColumn("g", F.xxhash64("g", "s")).drop("s", "sigs", "members")
    rest = members.where(F.col("members") <= crowd)
    return still_open(rest.drop("members").unionByName(parted))


def similar_sets(df: DataFrame, key: str, text: str, shingle_words: int, percent: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` as (key, n, node), and (node, label) of the nodes that are similar to others; a node is a distinct set."""
    body = F.coalesce(col(text), F.lit(""))
    kind = df.select(col(key).alias("key")).schema[0].dataType.simpleString()
    signed = df.select(col(key).alias("key"), F.xxhash64(body).alias("text_hash"), body.cast("binary").alias("text")).mapInArrow(
        signer(shingle_words, percent), f"key {kind}, text_hash long, n long, d1 long, d2 long, sketch binary, sigs array<long>"
    )
    # Numbers of rows are frozen by the checkpoint.
    signed = settle(signed.withColumn("id", F.monotonically_increasing_id()))
    rows = signed.select("id", "key", "text_hash", "n", "d1", "d2")
    # An empty set is like no other, not even empty ones.
    full = rows.where("n > 0")
    nodes = settle(full.groupBy("d1", "d2").agg(F.min("id").alias("node")))
    numbered = settle(full.join(nodes, ["d1", "d2"]).select("id", "node", "text_hash", "n", "d1", "d2"))
    known = rows.select("id", "key", "n").join(numbered.select("id", "node"), "id", "left").select(
        "key", "n", F.coalesce("node", "id").alias("node")
    )

    # Members of each signature that two rows have; they meet at the first.
    of_sig = Window.partitionBy("g")
    exploded = signed.select("id", F.explode("sigs").alias("g"))
    shared = exploded.withColumn("lo", F.min("id").over(of_sig)).withColumn("hi", F.max("id").over(of_sig)).where("lo != hi")
    shared = settle(shared.select("g", "id", F.col("lo").alias("first")))
    node_of = numbered.select("id", "node")
    first_of = numbered.select(F.col("id").alias("first"), F.col("node").alias("u"))
    star = shared.select("first", "id").where("first != id").distinct().join(first_of, "first").join(node_of, "id")
    star = star.select(F.least("u", "node").alias("u"), F.greatest("u", "node").alias("v")).where("u != v").distinct()
    # The first row of a set has its sketch.
    whole = numbered.where("id = node")
    about = settle(whole.select("node", "n").join(signed.select(F.col("id").alias("node"), "sketch"), "node"))
    tried = settle(possible(star, about, percent))

    bucket = lambda c: F.pmod(c, F.lit(BUCKETS)).cast("int")

    def sets_of(chosen: DataFrame) -> DataFrame:
        """(node, set): their texts are read again, chosen by hash, so that other texts are not moved."""
        wanted = settle(chosen.join(whole, "node").select("node", "text_hash", "d1", "d2"))
        buckets = wanted.select(bucket(F.col("text_hash")).alias("b")).distinct()
        texts = df.select(body.cast("binary").alias("text"), bucket(F.xxhash64(body)).alias("b")).join(F.broadcast(buckets), "b", "left_semi")
        read = texts.select("text").mapInArrow(set_reader(shingle_words), "d1 long, d2 long, set binary")
        # Rows of one set are dealt alike for both steps.
        return settle(read.dropDuplicates(["d1", "d2"]).join(wanted.select("node", "d1", "d2"), ["d1", "d2"]).select("node", "set"))

    def linked(pairs: DataFrame) -> DataFrame:
        return settle(similar(pairs, sets_of(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()), percent))

    links = linked(tried)

    # Groups that are of one component now are done; only the others need sizes and sketches, those of the same members once.
    labels = components(links)
    label_of = node_of.join(labels, "node", "left").select("id", "node", F.coalesce("label", "node").alias("label"))
    group = Window.partitionBy("g")
    apart = shared.select("g", "id").join(label_of, "id")
    apart = apart.withColumn("lo", F.min("label").over(group)).withColumn("hi", F.max("label").over(group))
    apart = settle(apart.where("lo != hi").dropDuplicates(["g", "node"]).select("g", "node", "label"))
    made_of = apart.groupBy("g").agg(
        F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("x2"), F.count(F.lit(1)).alias("size")
    )
    kept = made_of.groupBy("x1", "x2", "size").agg(F.min("g").alias("g")).select("g")
    members = still_open(apart.join(kept, "g", "left_semi").join(about, "node"))
    members = divided(members, sets_of, crowd, percent)
    low, most = 1, members.agg(F.max("members")).first()[0] or 0
    while low < most:
        sorted_ = members.select("g", "node", "label", "n", "sketch").repartition("g").sortWithinPartitions("g", "node")
        near = sorted_.mapInArrow(pair_finder(low, low * STRIDE, percent), "u long, v long").distinct()
        near = settle(near.join(tried, ["u", "v"], "left_anti"))
        low *= STRIDE
        if near.isEmpty():
            continue
        tried = tried.union(near)
        found = linked(near)
        # Without new links all groups stay as they are.
        if not found.isEmpty():
            links = links.union(found)
            labels = components(links)
            members = still_open(relabelled(members, labels))
            most = members.agg(F.max("members")).first()[0] or 0
    return known, labels


def jaccard_groups(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    percent: int = PERCENT,
    crowd: int = CROWD,
) -> DataFrame:
    """One row per row of ``df``: key, n_shingles and component_id, the smallest key reachable over links.

    Two rows are linked if their sets of word shingles have a Jaccard similarity of ``percent`` or more; small letters for A-Z.
    Shingles are known by 64 bits, sets by 128. Rows with the same set are one node. Nodes that share a PartEnum signature
    are first compared with the first node of the signature; where a group is not of one component then,
    its other pairs follow, nearest places first, until no two members of different components are left uncompared. Pairs that size or
    sketches rule out are not compared, all others are, element by element.

    A set has about a third as many signatures as shingles, so a text costs what its length says, however long
    it is. Groups of one signature with more than ``crowd`` members are divided by second signatures. Null and wordless texts have an empty set
    and are linked with nothing, not even each other. A null key takes part but never names a group; a group of null keys only has a
    null component_id. Repeated keys and rows are rows of their own. Other columns are not read. An empty table gives an empty result.
    """
    if not 50 <= percent <= 99:
        raise ValueError("percent must be from 50 to 99")
    known, labels = similar_sets(df, key, text, shingle_words, percent, crowd)
    labels = labels.select("node", F.col("label").alias("l_"))
    per_node = known.groupBy("node").agg(F.min("key").alias("least"))
    named = settle(per_node.join(labels, "node", "left").select("node", "least", F.coalesce("l_", "node").alias("label")))
    of_label = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_node = settle(named.join(of_label, "label").select("node", "component_id"))
    return known.join(of_node, "node").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")
