import random
import re
from collections import Counter

from plumbline.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    counts = Counter(windows)
    covered = {k + j for k, x in enumerate(windows) if counts[x] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def texts():
    rng = random.Random(6)
    words = ["aa", "bé", "c#", "dd.", "|", "E"]
    out = ["".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\t", "\r\n", " "]) for _ in range(rng.randrange(90))) for _ in range(80)]
    return [*out, "", None, "x", "a b c", "a a a a", "a a a", "a b a b a b", "\n\n", "tail\n", "one two three " * 30_000]


def test_measures(make):
    data = texts()
    got = {r.doc_id: r for r in quality.clean(make(list(enumerate(data)))).collect()}
    assert len(got) == len(data)
    for k, t in enumerate(data):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(t), t
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept <= (not r.base_failed)


def sentence(k):
    return f"Line {k} tells number{k} of story{k} in plain{k} and calm{k} words, as number{k} does{k}."


def test_lines(make):
    good = "\n".join(sentence(k) for k in range(12))
    cases = {
        1: (good, 0, True),
        2: (good + "\nHome | News | Sport | About | Contact us", 1, True),
        3: (good + "\nCopyright (c) 2020 Someone. All rights reserved.", 1, True),
        4: (good + "\nBUY THIS NOW OR NEVER AGAIN", 1, True),
        5: (good + "\nBuy this!! Really!! Now!! Or never!!", 1, True),
        6: (good + "\n" + "\n".join(f"w{k}### x{k}*** y{k}%%% z{k}$$$ v{k}" for k in range(40)), 40, False),
        7: (good + "\n" + good, 0, False),
        8: (good + "\n" + sentence(3), 0, True),
    }
    got = {r.doc_id: r for r in quality.clean(make([(k, t) for k, (t, *_) in cases.items()])).collect()}
    for k, (_, failed, kept) in cases.items():
        assert (got[k].n_failed_lines, got[k].kept) == (failed, kept), k
        assert got[k].cleaned == good
    assert got[6].reasons == ["symbols"] and not got[6].base_failed and got[7].base_failed


def test_odd_rows(make):
    got = quality.clean(make([(None, "a b"), (1, None), (1, None), (2, "")])).collect()
    assert [(r.n_words, r.cleaned, r.kept, r.lost_chars) for r in sorted(got, key=str) if r.doc_id is not None] == [(0, "", False, 0)] * 3
    assert quality.clean(make([])).collect() == []


def test_capitals_anywhere_in_a_word(make):
    good = "\n".join(sentence(k) for k in range(12))
    shouted = ["F.R.E.E. G.I.F.T. N.O.W. C.A.L.L. U.S.", "B-U-Y T-H-I-S N-O-W O-R N-E-V-E-R", "D'O'N'T W'A'I'T C'A'L'L N'O'W O'K",
               "F R E E G I F T N O"]
    calm = ["Mr. A.b said Mc.Donald saw X.y and Z.a there", "A B C D E F"]
    rows = [(k, good + "\n" + x) for k, x in enumerate(shouted + calm)]
    got = {r.doc_id: r for r in quality.clean(make(rows)).collect()}
    for k in range(len(shouted)):
        assert (got[k].reasons, got[k].cleaned, got[k].lost_chars) == (["capitals"], good, len("".join(shouted[k].split(" ")))), k
    for k in range(len(shouted), len(rows)):
        assert (got[k].reasons, got[k].lost_chars) == ([], 0), k
