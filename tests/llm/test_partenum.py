import random

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import partenum


def plain_set(text, n=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} or ({" ".join(w)} if w else set())


def plain_groups(rows, percent=90):
    sets = [plain_set(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if group[i] != group[j] and a and 100 * len(a & b) >= percent * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, r in zip(group, rows, strict=True):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    return sorted(((r[0], len(s), least.get(g)) for r, s, g in zip(rows, sets, group, strict=True)), key=str)


def found(df, **kw):
    return sorted((tuple(r) for r in partenum.jaccard_groups(df, **kw).collect()), key=str)


def texts(n, seed, lengths=(4, 14, 30, 80, 200), edits=(0, 0, 1, 2, 3, 6), bases=14):
    rng = random.Random(seed)
    words = [f"W{k}" for k in range(300)]
    base = [[rng.choice(words) for _ in range(rng.choice(lengths))] for _ in range(bases)]
    rows = []
    for k in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice(edits)):
            w[rng.randrange(len(w))] = rng.choice(words)
        if rng.random() < 0.2:
            w = w[: rng.randrange(len(w) * 8 // 10, len(w)) + 1]
        rows.append((k * 7 % 1009, " ".join(w)))
    return rows


ODD = [
    (None, "no id"), (None, "no id"), (5, None), (4, ""), (3, " \n\t"), (9, "A b"), (8, "a B"), (8, "a b"), (7, "é É x"),
    (6, "one two three"), (6, "one two three"), (2, "one\ttwo\x0bthree"), (1, "x y z " * 30_000), (2, "x y z " * 30_001),
]


@pytest.mark.parametrize("percent, seed", [(90, 1), (75, 2)])
def test_against_all_pairs(make, percent, seed):
    rows = texts(260, seed) + ODD
    assert found(make(rows), percent=percent) == plain_groups(rows, percent)


def test_crowded_groups_and_later_rounds(make, monkeypatch):
    """Many sets of like size that share a passage: groups stay open, are divided, and are compared place by place."""
    rng = random.Random(9)
    head = [f"h{k}" for k in range(90)]
    rows = [(k, " ".join(head + [f"t{rng.randrange(40)}" for _ in range(rng.choice([6, 8, 9]))])) for k in range(150)]
    want = plain_groups(rows)
    assert len({r[2] for r in want}) > 20
    assert found(make(rows)) == want
    assert found(make(rows), crowd=5) == want
    monkeypatch.setattr(partenum, "STRIDE", 2)
    assert found(make(rows), crowd=20) == want


def test_a_third_of_the_rows_are_copies(make):
    rows = [(k, "the same text in every one of these rows " * 4) for k in range(150)] + texts(150, 4) + [(900, "the same text in every one of these rows " * 4 + "and more")]
    rows += [(None, rows[0][1]), rows[0], rows[0]]
    assert found(make(rows)) == plain_groups(rows)


def test_chains_are_one_component(make):
    base = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join(f"x{j}" if j < k else w for j, w in enumerate(base))) for k in range(40)]
    assert found(make(rows)) == plain_groups(rows)


def test_empty_table_and_wordless_rows(make):
    assert found(make([])) == []
    assert found(make([(2, ""), (1, None), (3, " ")])) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for percent in (60, 80, 90, 95):
        bands = partenum.size_bands(percent)
        for _ in range(300):
            n = int(rng.integers(1, 400))
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            drop, add = (int(rng.integers(0, max(1, n * (100 - percent) // 100) + 1)) for _ in range(2))
            b = np.unique(np.r_[rng.permutation(a)[drop:], rng.integers(0, 1 << 63, add).astype(np.uint64)])
            both = len(np.intersect1d(a, b))
            if not len(b) or 100 * both < percent * (len(a) + len(b) - both) or (len(a) == len(b) == both):
                continue
            for seed in (0, 1):
                assert np.intersect1d(partenum.signatures(a, bands, seed), partenum.signatures(b, bands, seed)).size


def test_sketches_never_rule_out_similar_sets():
    rng = np.random.default_rng(3)
    draw = lambda k: rng.integers(0, 1 << 63, k).astype(np.uint64)
    for percent in (50, 75, 90):
        left, right = [], []
        for n in (1, 3, 40, 250, 500, 520, 700, 1030, 2100, 9000):
            for _ in range(20):
                a = np.unique(draw(n))
                drop = int(rng.integers(0, n * (100 - percent) // 100 + 1))
                left.append(a)
                right.append(np.unique(np.r_[rng.permutation(a)[drop:], draw(int(rng.integers(0, n // 10 + 1)))]))
        n, m = (np.array([len(x) for x in side]) for side in (left, right))
        both = np.array([len(np.intersect1d(a, b)) for a, b in zip(left, right)])
        alike = (100 * both >= percent * (n + m - both)) & (m > 0)
        i = np.flatnonzero(alike)
        assert len(i) > 50 and partenum.near_sizes(n, m, percent)[i].all()
        s = partenum.Sketches([partenum.sketch(left[k]) for k in i] + [partenum.sketch(right[k]) for k in i])
        assert s.within(np.arange(len(i)), np.arange(len(i)) + len(i), partenum.most_apart(n, m, percent)[i]).all()


def test_members_of_a_group_that_differ_make_no_pairs():
    """Long texts that share most, not enough: pairs that are alike are given once a batch, others not at all, however large their groups."""
    rng = np.random.default_rng(8)
    shared = rng.integers(0, 1 << 63, 1700).astype(np.uint64)
    sets = [np.unique(np.r_[shared, rng.integers(0, 1 << 63, 400).astype(np.uint64)]) for _ in range(40)]
    sets.append(np.unique(np.r_[sets[0][5:], rng.integers(0, 1 << 63, 5).astype(np.uint64)]))
    rows = [(g, k, k, len(x), partenum.sketch(x)) for g in (1, 2, 3) for k, x in enumerate(sets)]
    columns = list(zip(*rows, strict=True))
    batch = pa.RecordBatch.from_arrays(
        [*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], names=["g", "node", "label", "n", "sketch"]
    )
    for batches in ([batch], [batch.slice(0, 50), batch.slice(50)]):
        got = [tuple(r.values()) for b in partenum.pair_finder(1, 64, 90)(iter(batches)) for r in b.to_pylist()]
        assert set(got) == {(0, 40)} and len(got) <= len(batches) + 1
