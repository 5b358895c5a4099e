import math
import random
from collections import Counter

import pytest

from plumbline.llm import backoff


def plain(rows, order, min_count):
    docs = [(i, (t or "").split()) for i, t in rows]
    count = Counter(tuple(w[k : k + n]) for _, w in docs for n in range(1, order + 1) for k in range(len(w) - n + 1))
    every = sum(len(w) for _, w in docs)
    out = []
    for i, w in docs:
        total = 0.0
        for k in range(len(w)):
            steps = 0
            for n in range(min(order, k + 1), 0, -1):
                gram = tuple(w[k - n + 1 : k + 1])
                if n == 1 or count[gram] >= min_count:
                    total += math.log(count[gram] / (every if n == 1 else count[gram[:-1]])) + steps * math.log(0.4)
                    break
                steps += 1
        out.append((i, len(w), total))
    return out


@pytest.mark.parametrize("order, min_count, batch, part", [(2, 2, 16 << 20, 1 << 20), (3, 2, 300, 50), (1, 1, 300, 50), (4, 3, 1000, 7)])
def test_against_plain_counts(make, order, min_count, batch, part):
    rng = random.Random(order)
    words = ["a", "b", "c", "dé", "e,", "F"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randrange(30)))) for k in range(90)]
    rows += [(None, "a b c"), (5, "a b c"), (5, "a b c"), (200, None), (201, " \n"), (202, "long text here " * 5000)]
    got = backoff.scored(make(rows), order=order, min_count=min_count, batch_bytes=batch, part_grams=part).collect()
    got = sorted(((r.doc_id, r.n_words, r.log_score) for r in got), key=lambda r: (str(r[0]), r[2]))
    want = sorted(plain(rows, order, min_count), key=lambda r: (str(r[0]), r[2]))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-9)


def test_without_words(make):
    assert backoff.scored(make([])).collect() == []
    assert sorted(map(tuple, backoff.scored(make([(1, None), (2, "")])).collect())) == [(1, 0, 0.0), (2, 0, 0.0)]


def test_trigrams_are_counted_unless_told_otherwise(make):
    rows = [(1, "a b c a b d"), (2, "x b c"), (3, "a b"), (4, "a b c")]
    got = sorted((r.doc_id, r.n_words, r.log_score) for r in backoff.scored(make(rows)).collect())
    want = plain(rows, 3, 1)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-9)
