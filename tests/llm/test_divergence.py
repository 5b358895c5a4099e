import random
import re
from collections import Counter, defaultdict

import pytest

from plumbline.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_divergence(rows, min_docs, top):
    total, docs, group = defaultdict(Counter), defaultdict(Counter), {}
    for _, text, lang, source in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = TERM.findall(low)
        g = (lang or "", source or "")
        group.setdefault(g, Counter()).update(words)
        total[g[0]].update(words)
        docs[g[0]].update(set(words))
    out = []

    def ranked(g, part, items, most=None):
        items.sort(key=lambda x: (-x[1], x[0].encode()))
        out.extend((*g, part, i, v, k + 1) for k, (i, v) in enumerate(items[:most]))

    f = lambda p, q: (p - q) ** 2 // (p + q)
    for g in group:
        kept = [t for t, n in docs[g[0]].items() if n >= min_docs]
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        p, q = shares(group[g]), shares(total[g[0]])
        ranked(g, "pair", [(o[1], sum(f(p[t], r[t]) for t in kept)) for o in group if o[0] == g[0] and o != g for r in [shares(group[o])]])
        ranked(g, "term", [(t, f(p[t], q[t])) for t in kept if group[g][t] and p[t] > q[t]], top)
    return sorted(out)


def corpus(n, sources, seed=5):
    rng = random.Random(seed)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)] + ["Été", "日本", "Z", "z"]
    rows = []
    for k in range(n):
        s = f"s{min(rng.randrange(sources), rng.randrange(sources))}"
        w = [words[min(rng.randrange(len(words)), rng.randrange(len(words)))] for _ in range(rng.randrange(60))]
        rows.append((k, "-".join(w), rng.choice(["en", "de"]), s))
    return rows


ODD = [(1, None, None, None), (2, "", "en", None), (3, "1 2 3 _", "xx", "only"), (4, "lonely text", "yy", "a"), (5, "lonely text", "yy", "b"), (1, None, None, None)]


@pytest.mark.parametrize("block_terms, bucket_sources", [(1 << 13, 24), (40, 2), (64, 1)])
def test_against_counting(make, block_terms, bucket_sources):
    rows = corpus(250, 7) + ODD
    got = divergence.divergence(make(rows), min_docs=3, top=4, block_terms=block_terms, bucket_sources=bucket_sources)
    assert sorted(tuple(r) for r in got.collect()) == plain_divergence(rows, 3, 4)


def test_one_source_holds_most(make):
    rows = [(k, "same words again and again", "en", "hot") for k in range(60)] + corpus(60, 3)
    assert sorted(tuple(r) for r in divergence.divergence(make(rows)).collect()) == plain_divergence(rows, 10, 10)


def test_long_text_ties_and_no_terms_kept(make):
    rows = [(k, "aa bb cc " * 20_000, "en", f"s{k % 2}") for k in range(4)]
    assert sorted(tuple(r) for r in divergence.divergence(make(rows), min_docs=4).collect()) == plain_divergence(rows, 4, 10)
    # Nothing is kept: every distance is zero, items decide the ranks.
    assert sorted(tuple(r) for r in divergence.divergence(make(rows), min_docs=5).collect()) == [
        ("en", "s0", "pair", "s1", 0, 1), ("en", "s1", "pair", "s0", 0, 1),
    ]


def test_empty_table(make):
    assert divergence.divergence(make([])).collect() == []


def test_counts_beyond_64_bits_are_exact(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(10**13, 10**15, 10**9)], "c long, n long, v long")
    assert df.select(divergence.share(*map(F.col, "cnv"))).first()[0] == 1 + 10**9 * (10**13 + 2) // (10**15 + 2 * 10**9)


def test_counter_hands_on_what_it_holds(make, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 5)
    rows = corpus(60, 3) + ODD
    assert sorted(tuple(r) for r in divergence.divergence(make(rows), min_docs=3).collect()) == plain_divergence(rows, 3, 10)
