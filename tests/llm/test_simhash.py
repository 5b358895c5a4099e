import random

import numpy as np
import xxhash

from plumbline.llm import simhash


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_labels(rows):
    ids, fps = [r[0] for r in rows], [plain_fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return ids, fps, group


def plain_groups(rows):
    ids, fps, group = plain_labels(rows)
    least = {}
    for g, i in zip(group, ids):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return [(i, f"{f:016x}", least.get(g)) for i, f, g in zip(ids, fps, group)]


def near_texts(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 40, 300]))] for _ in range(12)]
    rows = []
    for k in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((k * 3 % 101 + 1000 * (k % 2), " ".join(w)))
    return rows


ODD = [
    (None, "no id"), (None, "no id"), (5, None), (4, ""), (3, " \n\t"), (9, "A b"), (8, "a B"), (8, "a b"), (7, "é É x"),
    (6, "one two three"), (6, "one two three"), (1, "x y z " * 30_000), (2, "x y z " * 30_000),
]


def test_against_all_pairs(make):
    rows = near_texts(220) + ODD
    want = sorted(plain_groups(rows), key=str)
    for split in (simhash.SPLIT_ABOVE, 2):
        got = simhash.near_duplicates(make(rows), split_above=split).collect()
        assert sorted(map(tuple, got), key=str) == want
    assert len({w[2] for w in want}) < len(rows) - 20


def test_one_of_each_group_stays(make):
    rows = near_texts(120) + ODD
    kept = simhash.keep_one(make(rows))
    assert kept.columns == make(rows).columns
    groups = {}
    for row, g in zip(rows, plain_labels(rows)[2]):
        groups.setdefault(g, []).append(row)
    got = [(r.doc_id, r.text) for r in kept.collect()]
    least = [min((i for i, _ in g if i is not None), default=None) for g in groups.values()]
    assert sorted(str(g[0]) for g in got) == sorted(map(str, least))
    assert all(sum(g in group for g in got) >= 1 for group in groups.values()) and all(g in rows for g in got)


def test_every_close_pair_meets_at_a_home(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63 - 1, 300, dtype=np.int64)
    near = base.copy()
    for _ in range(3):
        near ^= np.int64(1) << rng.integers(0, 63, 300)
    nodes = spark.createDataFrame([(int(x),) for x in {*base.tolist(), *near.tolist()}], "fp long")
    at = {}
    for r in simhash.anchors(nodes).collect():
        at.setdefault(r.anchor, []).append((r.fp, r.home))
    met = {(a, b) for m in at.values() for a, h in m if h for b, _ in m}
    for a, b in zip(base.tolist(), near.tolist()):
        assert (a, b) in met or (b, a) in met


def test_dense_runs_give_fewer_links_than_rows():
    rng = np.random.default_rng(0)
    fps = np.unique(np.uint64(99) ^ (np.uint64(1) << rng.integers(0, 40, 500).astype(np.uint64)))
    left, right = simhash.forest(fps, 3)
    assert len(left) == len(fps) - 1 and len(set(right.tolist())) == len(right)


def test_chain_becomes_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    labels = {r.node: r.label for r in simhash.components(edges).collect()}
    assert labels == {**{k: 0 for k in range(1, 61)}, 101: 100}


def test_empty_table(make):
    assert simhash.near_duplicates(make([])).collect() == []
    assert simhash.keep_one(make([])).collect() == []
