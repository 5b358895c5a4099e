import random

import pytest

from plumbline.llm import toxicity

INSULTS = ["grumbold", "snarfel", "plonkus"]


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    syllables = ["an", "er", "ti", "on", "the", "st", "ea", "ing", "lo", "ra", "mi", "que"]
    rows, marks = [], []
    for k in range(n):
        w = ["".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(rng.randrange(5, 120))]
        bad = rng.random() < 0.25
        for _ in range(rng.randrange(1, 3) if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(INSULTS))
        rows.append((k, " ".join(w).replace("ing ", "ing. ") + "."))
        marks.append((k, 1, int(bad)))
    return rows, marks


@pytest.fixture(scope="module")
def model():
    rows, marks = corpus()
    return toxicity.fit([t for _, t in rows], [y for *_, y in marks])


def top(model, text):
    return float(model.probability(toxicity.Scorer(model).highest([text]))[0])


def test_held_out_documents(make, labels):
    rows, marks = corpus()
    got = toxicity.scored(make(rows), labels(marks)).collect()
    truth = {k: y for k, _, y in marks}
    held = [r for r in got if r.held_out]
    assert 60 < len(held) < 140
    assert sum((r.score >= 0.3) == truth[r.doc_id] for r in held) >= 0.97 * len(held)


@pytest.mark.parametrize("text", ["snarfel", "snar.fel", "sna-rfel", "s n a r f e l", "snarxfel", "plonkkus", "g.r.u.m.b.o.l.d", "Grumbold!"])
def test_gaps_and_inserted_characters(model, text):
    assert top(model, f"an er {text} ti on") >= 0.3


def test_whole_text_and_long_tokens(model):
    clean = "an er ti on the " * 40_000
    assert top(model, clean) < 0.3 <= top(model, clean + "snarfel")
    assert top(model, "anertion" * 2000 + "snarfel" + "erti" * 2000) >= 0.3


def test_more_tokens_than_are_remembered(model, monkeypatch):
    monkeypatch.setattr(toxicity, "CACHE", 50)
    texts = [t for _, t in corpus(80, 9)[0]]
    wide = toxicity.Scorer(model).highest(texts)
    monkeypatch.setattr(toxicity, "CACHE", 10**6)
    assert (wide == toxicity.Scorer(model).highest(texts)).all()


def test_odd_rows(make, labels):
    rows, marks = corpus()
    odd = [(None, "snarfel"), (1001, None), (1002, ""), (1003, "..."), (1003, "..."), (1004, "a")]
    got = toxicity.scored(make(rows + odd), labels([*marks, (None, 1, 1), (1, None, None), (1, 1, 0)])).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r.score for r in got}
    least = min(by.values())
    assert by[1001] == by[1002] == by[1003] == pytest.approx(least, abs=0.05) and by[None] >= 0.3
    assert not next(r for r in got if r.doc_id is None).held_out


def test_without_labels_nothing_is_toxic(make, labels):
    rows, marks = corpus(20)
    for lab in ([], [(k, q, 0) for k, q, _ in marks], [(k, q, None) for k, q, _ in marks]):
        df = make(rows)
        kept = toxicity.without_toxic(df, labels(lab))
        assert kept.columns == df.columns and kept.count() == len(rows)
    assert toxicity.scored(make([]), labels(marks)).collect() == []


@pytest.mark.parametrize("wrap", ["{}", "({})", "*{}*", "{}--", "{}."])
def test_letters_set_apart_in_every_form(model, wrap):
    assert top(model, "an er " + " ".join(map(wrap.format, "snarfel")) + " ti on") >= 0.3
    spaced = " ".join(map(wrap.format, "poop"))
    assert "poop" in {toxicity.bare(t) for t in toxicity.tokens(f"an er {spaced} ti on")}


def test_sample_is_not_cut():
    assert toxicity.SAMPLE_PER_CLASS >= 2500
