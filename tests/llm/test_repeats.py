import random

import numpy as np
import pytest

from plumbline.llm import repeats


def plain(rows, size):
    """Words of each document covered by windows that another text has, copies included."""
    texts = {}
    for k, t in rows:
        texts.setdefault(t, []).append(k)
    where = {}
    for t in texts:
        w = (t or "").split()
        for i in range(len(w) - size + 1):
            where.setdefault(tuple(w[i : i + size]), set()).add(t)
    out = []
    for k, t in rows:
        w = (t or "").split()
        hit = np.zeros(len(w) + 1, bool)
        for i in range(len(w) - size + 1):
            if len(where[tuple(w[i : i + size])]) > 1 or len(texts[t]) > 1:
                hit[i : i + size] = True
        edges = np.flatnonzero(np.diff(np.r_[False, hit].astype(int)))
        out += [(k, int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]
    return sorted(out, key=str)


def documents(seed=3):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passages = [[word() for _ in range(n)] for n in (20, 21, 25, 60, 300)]
    rows = []
    for k in range(120):
        w = [word() for _ in range(rng.randrange(0, 200))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            p = rng.choice(passages)
            a = rng.randrange(3)
            w[at:at] = p[a:]
        rows.append((k, " ".join(w)))
    rows += [(500, "same " * 70), (501, "same " * 90 + "end"), (502, "a b c " * 40), (503, "x a b c " + "a b c " * 30)]
    rows += [(600 + k, rows[3][1]) for k in range(4)] + [(None, rows[5][1]), (700, None), (700, None), (701, ""), (702, "\n \t")]
    # A passage inside one document only is none.
    rows += [(800, " ".join(passages[3][:0] + [f"q{i}" for i in range(40)] * 2))]
    return rows


@pytest.mark.parametrize("split", [repeats.SPLIT_ABOVE, 3])
def test_against_all_windows(make, split):
    rows = documents()
    got = repeats.repeated_passages(make(rows), min_words=20, gram_words=4, split_above=split).collect()
    found = {}
    for r in got:
        assert r.n_words == r.end - r.start >= 20
        found.setdefault((r.doc_id, r.start, r.end), 0)
    want = set(plain(rows, 20))
    assert set(found) == want
    ids = {k for k, _ in rows}
    assert all(r.first_doc in ids and (r.doc_id is None or r.first_doc <= r.doc_id or r.first_doc in ids) for r in got)
    copies = {r.first_doc for r in got if r.doc_id in (600, 603)}
    assert min(copies) <= 3


def test_long_texts_and_default_size(make):
    rng = random.Random(1)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(55))
    fill = lambda n: " ".join(f"f{rng.randrange(10**9)}" for _ in range(n))
    rows = [(1, f"{fill(30_000)} {passage} {fill(10)}"), (2, f"{passage}"), (3, fill(500)), (4, " ".join(passage.split()[:49]))]
    got = sorted(tuple(r) for r in repeats.repeated_passages(make(rows)).collect())
    assert got == [(1, 30_000, 30_055, 55, 1), (2, 0, 55, 55, 1)]


def test_minimisers_depend_on_the_window_alone():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 40, 400).astype(np.uint64)
    _, whole = repeats.minimisers(h, 20, 4, repeats.Powers())
    for s in range(0, 380, 7):
        _, one = repeats.minimisers(h[s : s + 20], 20, 4, repeats.Powers())
        assert one[0] + s == whole[s]


def test_empty_table(make):
    assert repeats.repeated_passages(make([])).collect() == []
    assert repeats.repeated_passages(make([(1, None), (2, "short")])).collect() == []


def test_words_hash_alike_wherever_they_stand():
    texts = ["a bé c  bé\n", "\x0b bé", "", " \t", "abc"]
    got = [repeats.word_hashes(t, repeats.Powers()).tolist() for t in texts]
    assert [len(g) for g in got] == [4, 1, 0, 0, 1]
    assert got[0][1] == got[0][3] == got[1][0] and len({*got[0], *got[4]}) == 4
