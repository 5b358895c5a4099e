import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import infill

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_output(doc_id, text, rate=50, suffix_first=80):
    """n, form, prefix_chars, middle_chars, output, by slicing the list of tokens."""
    text = text or ""
    tok = TOKEN.findall(text)
    d = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(tok)
    if not text or any(m in text for m in infill.MARKS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tok[:a]), "".join(tok[a:b]), "".join(tok[b:])
    if h[3] % 100 < suffix_first:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = ["", None, " ", "\t\n", "a", " a", "a ", "a  b\r\n", "x<P>y", "é 日本 \U0001f600 z", "<", "< P> <", "<S", "a\x0bb\x0cc\x1cd e", "\x00 a", ">M<"]


def texts(n=300):
    rng = random.Random(3)
    return ODD + ["".join(rng.choice(["a", "bc", "é", " ", "  ", "\n", "<", "<S", ">", "\U0001f600"]) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("rate, suffix_first", [(50, 80), (100, 50), (0, 0)])
def test_against_token_lists(make, rate, suffix_first):
    rows = list(enumerate(texts())) + [(None, "no id at all"), (None, "no id at all"), (7, "again")]
    out = infill.fill_in_middle(make(rows), rate=rate, suffix_first=suffix_first)
    out = out.withColumn("back", infill.restore(F.col("output"), F.col("form")))
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"], r["key"]) for r in out.collect()), key=str)
    want = sorted(((i, *plain_output(i, t, rate, suffix_first), t or "", "x") for i, t in rows), key=str)
    assert got == want
    assert rate == 50 or {r[2] for r in got} == ({"plain"} if rate == 0 else {"plain", "spm", "psm"})


def test_long_text_and_empty_table(make):
    long = "word " * 200_000
    found = infill.fill_in_middle(make([(k, long) for k in range(4)]), rate=100)
    assert found.where(infill.restore(F.col("output"), F.col("form")) == F.lit(long)).count() == 4
    assert infill.fill_in_middle(make([])).count() == 0


def test_result_names_replace_columns(make):
    out = infill.fill_in_middle(make([(1, "a b")]).withColumn("Output", F.lit(1)).withColumn("n", F.lit("x")))
    assert [c for c in out.columns if c.lower() in ("n", "output")] == ["n", "output"]


def test_marks(make):
    marks = ("<|pre|>", "<|suf|>", "<|mid|>")
    out = infill.fill_in_middle(make([(k, "one two three") for k in range(30)]), rate=100, marks=marks)
    assert {r[0] for r in out.select(infill.restore(F.col("output"), F.col("form"), marks)).collect()} == {"one two three"}
    with pytest.raises(ValueError):
        infill.fill_in_middle(make([]), marks=("<P>", "<P>", "<M>"))


def test_rotation_exchanges_neighbours():
    for start, mid, end in [(0, 0, 5), (1, 3, 8), (2, 2, 2), (0, 7, 8), (3, 8, 8)]:
        buf = bytearray(b"01234567")
        infill.rotate(np.frombuffer(buf, np.uint8), start, mid, end)
        assert bytes(buf) == b"01234567"[:start] + b"01234567"[mid:end] + b"01234567"[start:mid] + b"01234567"[end:]
