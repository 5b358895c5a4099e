import random
import re

import pytest

from plumbline.llm import decontaminate


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[0-9a-z\u0080-\U0010ffff]+", low)


def plain(rows, items):
    out = []
    for i, text in rows:
        w = plain_words(text)
        hit, found = set(), set()
        for item, t in items:
            x = plain_words(t)
            size = min(10, len(x))
            for k in range(len(x) - size + 1) if size else ():
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == x[k : k + size]:
                        hit |= set(range(p, p + size))
                        found.add("" if item is None else str(item))
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


ITEMS = [
    (11, "Alpha beta, gamma delta; epsilon zeta eta theta iota kappa LAMBDA mu nu"), (2, "one two"), (3, "solo"), (4, None), (5, ""),
    (6, "-- !"), (None, "Größe zählt hier"), (7, "a a a a a a a a a a a a"), (8, "solo"), (8, "beta gamma delta epsilon zeta eta theta iota kappa lambda"),
]


def documents():
    rng = random.Random(4)
    filler = ["the", "alpha", "beta", "gamma", "one", "two", "a", "Größe", "x1", "mu"]
    rows = [(k, " ".join(rng.choice(filler) for _ in range(rng.randrange(60)))) for k in range(60)]
    passage = "alpha BETA gamma delta epsilon zeta eta-theta iota, kappa lambda mu nu"
    rows += [(100, "x " * 20 + passage + " y"), (101, passage), (101, passage), (102, passage + " " + passage), (103, "the größe zählt hier")]
    rows += [(104, "Größe zählt hier"), (105, "a " * 40), (106, None), (None, "solo"), (107, ""), (108, "..."), (109, "one two " * 20_000)]
    return rows


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 4])
def test_against_plain_search(spark, make, block_words):
    rows = documents()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.contaminated(make(rows), items, block_words=block_words).collect()
    got = sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), list(r["items"])) for r in got), key=str)
    short = [(i, t) for i, t in rows if i != 109]
    assert [g for g in got if g[0] != 109] == plain(short, ITEMS)
    assert [g[1:] for g in got if g[0] == 109] == [(40_000, 40_000, ["2"])]


def test_clean_rows_stay_as_they_are(spark, make):
    rows = documents()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontaminate.without_contaminated(make(rows), items)
    assert kept.columns == make(rows).columns
    clean = {str(r[0]) for r in plain([r for r in rows if r[0] != 109], ITEMS) if r[2] == 0}
    assert {str(r.doc_id) for r in kept.collect()} == clean


def test_empty_tables(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = [(1, "a b"), (2, None)]
    got = decontaminate.contaminated(make(rows), none).collect()
    assert [(r.doc_id, r.n_words, r.spans, r["items"]) for r in sorted(got)] == [(1, 2, [], []), (2, 0, [], [])]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contaminated(make([]), items).collect() == []


def test_repeated_items_add_no_windows():
    words = [b"w%d" % k for k in range(30)]
    w = decontaminate.windows_of([("a", words), ("b", words), ("c", words[:10] * 2)], 10)
    assert len(w.ids) == 21 + 9 and w.item[0] == [0, 1, 2] and w.item[1] == [0, 1]


def test_repeated_benchmark_rows_fill_no_block(spark, make, monkeypatch):
    text = " ".join(f"w{k}" for k in range(30))
    seen = []
    whole = decontaminate.windows_of
    monkeypatch.setattr(decontaminate, "windows_of", lambda rows, window: seen.append(len(rows)) or whole(rows, window))
    benchmark = spark.createDataFrame([("a", text)] * 200 + [("b", text)], "item_id string, text string")
    got = decontaminate.contaminated(make([(1, f"x {text} y")]), benchmark, block_words=1000).collect()
    assert sum(seen) == 2 and [(r.spans[0].start, r.spans[0].end, r.items) for r in got] == [(1, 31, ["a", "b"])]
