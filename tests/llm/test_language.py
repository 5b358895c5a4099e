import random

import numpy as np
import pytest

from plumbline.llm import language

SYLLABLES = {
    "aa": ["the", "ing", "er", "and", "st"],
    "bb": ["sch", "ein", "ung", "ä", "keit"],
    "cc": ["que", "é", "tion", "eux", "aient"],
}


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rng.choice(list(SYLLABLES))
        w = ["".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(4, 60))]
        rows.append((k, " ".join(w).capitalize() + ".", lang))
    return rows


def test_held_out_documents(make):
    rows = corpus()
    truth = {k: lang for k, _, lang in rows}
    got = language.identified(make(rows)).collect()
    held = [r for r in got if r.held_out]
    assert 100 < len(held) < 200
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_labels_are_never_read(make):
    rows = corpus()
    held = {r.doc_id for r in language.identified(make(rows)).where("held_out").collect()}
    changed = [(k, t, "zz" if k in held else lang) for k, t, lang in rows]
    assert sorted(language.identified(make(changed)).collect()) == sorted(language.identified(make(rows)).collect())


def test_presence_is_the_set_of_grams():
    rng = random.Random(3)
    for text in ["", "a", "ab", "A-b c", "".join(rng.choices("abcé ,", k=500)), "xyz " * 40_000]:
        s = language.symbols(text)
        s = [int(x) for k, x in enumerate(s) if x or k == 0 or s[k - 1]]
        want = {tuple(s[k : k + n]) for n in (1, 2, 3) for k in range(len(s) - n + 1)}
        start, got = 0, set()
        for g in language.Presence().grams(text).tolist():
            n = 1 if g < 128 else 2 if g < 128 + 128**2 else 3
            start = {1: 0, 2: 128, 3: 128 + 128**2}[n]
            code = g - start
            got.add(tuple(code // 128**k % 128 for k in range(n - 1, -1, -1)))
        assert got == want


def test_scores_are_the_kernel_machine():
    rows = corpus(60)
    presence = language.Presence()
    samples = [(presence.grams(t), lang) for _, t, lang in rows]
    model = language.fit(samples, 5)
    marks = [g for lang in model.languages for g in [g for g, y in samples if y == lang][:5]]
    inside = lambda g: set(g.tolist()) & set(model.vocabulary.tolist())
    kernel = lambda a, b: len(inside(a) & inside(b)) / np.sqrt(len(inside(a)) * len(inside(b)))
    k_nm = np.array([[kernel(g, m) for m in marks] for g, _ in samples])
    k_mm = np.array([[kernel(g, m) for m in marks] for g in marks])
    y = np.array([[1.0 if of == lang else -1.0 for lang in model.languages] for _, of in samples])
    share = np.array([1 / sum(o == of for _, o in samples) for _, of in samples])
    share /= share.mean()
    a = k_nm.T @ (share[:, None] * k_nm) + language.RIDGE * len(samples) * k_mm + 1e-8 * np.eye(len(marks))
    f = k_nm @ np.linalg.solve(a, k_nm.T @ (share[:, None] * (y - model.offsets))) + model.offsets
    got = language.predictor(model)([t for _, t, _ in rows])
    assert [model.languages[k] for k in f.argmax(1)] == [g[0] for g in got]
    assert [g[1] for g in got] == pytest.approx(np.clip((1 + f.max(1)) / 2, 0, 1).tolist(), abs=1e-3)


def test_odd_rows(make):
    rows = corpus(200)
    odd = [(None, "the ing er", "aa"), (901, None, "aa"), (902, "", "bb"), (903, "12 !", "bb"), (904, "schein ung", None), (905, "日本語", None)]
    odd += [(906, "the and ing " * 30_000, None)] * 2
    got = {r.doc_id: r for r in language.identified(make(rows + odd)).collect()}
    assert all(got[k][2:] == ("und", 0.0) for k in (901, 902, 903))
    assert got[904].lang_pred == "bb" and got[None].lang_pred == got[906].lang_pred == "aa" and not got[None].held_out
    assert got[905].lang_pred in SYLLABLES


def test_nothing_to_learn_from(make):
    assert language.identified(make([])).collect() == []
    got = language.identified(make([(1, "some words", None), (None, "some", "aa")])).collect()
    assert {r.lang_pred for r in got} == {"und"}
