"""Fill-in-the-middle by block rotation: sentinels at two cuts of a text, segments exchanged in place, and back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.values import col

SEED = 42
#: Percent of the texts that are transformed, and percent of those that put the suffix first.
RATE = 50
SUFFIX_FIRST = 80
#: Marks of prefix, suffix and middle. Each starts with the only "<" and ends with the only ">" in it, so none arises
#: where a mark meets a text.
MARKS = ("<P>", "<S>", "<M>")

GAP = np.zeros(256, bool)
GAP[[0x20, *range(0x09, 0x0E)]] = True
#: UTF-8 bytes that continue a code point.
INNER = np.zeros(256, bool)
INNER[0x80:0xC0] = True


def cut_points(text: bytes) -> np.ndarray:
    """Byte offsets at which a text may be cut: its start and the end of each token (a word with the gap before it, or a last gap)."""
    gap = GAP[np.frombuffer(text, np.uint8)]
    ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    return np.r_[0, ends, len(text)] if len(text) else np.zeros(1, np.int64)


def rotate(buf: np.ndarray, start: int, mid: int, end: int) -> None:
    """Exchange the neighbours buf[start:mid] and buf[mid:end] in place: each is reversed, then both together."""
    for a, b in ((start, mid), (mid, end), (start, end)):
        half = (b - a) // 2
        left, right = buf[a : a + half], buf[b - half : b]
        held = left.copy()
        left[:] = right[::-1]
        right[:] = held[::-1]


def marked(text: bytes, first: int, second: int, marks: tuple[bytes, bytes, bytes]) -> tuple[bytearray, int, int]:
    """Prefix, middle and suffix in the order of the text, each after its mark, and where the last two begin."""
    p, s, m = marks
    out = bytearray(text)
    out[second:second] = s
    out[first:first] = m
    out[:0] = p
    middle = len(p) + first
    return out, middle, middle + len(m) + second - first


def transformed(text: bytes, first: int, second: int, form: str, marks: tuple[bytes, bytes, bytes]) -> bytes:
    """psm: middle and suffix change places; spm: the suffix changes places with all before it."""
    out, middle, suffix = marked(text, first, second, marks)
    rotate(np.frombuffer(out, np.uint8), middle if form == "psm" else 0, suffix, len(out))
    return bytes(out)


def restored(output: bytes, form: str, marks: tuple[bytes, bytes, bytes]) -> bytes:
    """The exact text, from output and form alone: the rotation inverted, then the marks taken out."""
    if form == "plain":
        return output
    p, s, m = marks
    out = bytearray(output)
    view = np.frombuffer(out, np.uint8)
    last = output.index(m)
    start = output.index(s)
    rotate(view, start, last, len(out)) if form == "psm" else rotate(view, 0, output.index(p), len(out))
    del view
    if form == "psm":
        middle, suffix = start, start + len(out) - last
    else:
        head = output.index(p)
        middle, suffix = last - head, len(out) - head
    del out[suffix : suffix + len(s)]
    del out[middle : middle + len(m)]
    del out[: len(p)]
    return bytes(out)


def code_points(part: bytes) -> int:
    return len(part) - int(INNER[np.frombuffer(part, np.uint8)].sum())


def transformer(rate: int, suffix_first: int, marks: tuple[bytes, bytes, bytes]):
    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output binary")
    def of(texts: pd.Series, draws: pd.Series) -> pd.DataFrame:
        rows = []
        for text, draw in zip(texts, draws):
            text = b"" if text is None else bytes(text)
            h = [int(draw[k : k + 8], 16) for k in range(0, 32, 8)]
            cuts = cut_points(text)
            n = len(cuts) - 1
            if not text or h[2] % 100 >= rate or any(m in text for m in marks):
                rows.append((n, "plain", None, None, text))
                continue
            first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
            a, b = int(cuts[first]), int(cuts[second])
            form = "spm" if h[3] % 100 < suffix_first else "psm"
            rows.append((n, form, code_points(text[:a]), code_points(text[a:b]), transformed(text, a, b, form, marks)))
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return of


def draws(key: Column, seed: int) -> Column:
    """Hex digits that decide cuts and form: sha256 of seed and key. A null key is the empty text."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)


def fill_in_middle(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    seed: int = SEED,
    rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST,
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """All rows and columns of ``df`` with n, form, prefix_chars, middle_chars and output (text).

    A text is cut at two token ends that its key draws; a token is a word with the gap before it, a gap at the
    end is one too. Psm output is prefix, suffix, middle, each after its mark; spm has the suffix first. Plain is the text itself:
    for texts not drawn, empty texts, and texts that hold a mark already. Each row is worked on by itself, without a shuffle, in memory
    of a few times its text, however long that is; rows with equal key and text get equal results, and an empty
    table an empty result. A null text is empty, a null key draws like an empty one. Columns of ``df`` named as a result
    are replaced.
    """
    if len({m for m in marks if m[:1] == "<" and m[-1:] == ">" and m.count("<") == m.count(">") == 1}) != 3:
        raise ValueError("three different marks of the form <...> are needed")
    raw = tuple(m.encode() for m in marks)
    done = transformer(rate, suffix_first, raw)(col(text).cast("binary"), draws(col(key), seed))
    results = ("n", "form", "prefix_chars", "middle_chars", "output")
    rows = df.select(F.struct(*(col(c) for c in df.columns if c.lower() not in results)).alias("row"), done.alias("fim"))
    return rows.select(
        "row.*", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", F.col("fim.output").cast("string").alias("output")
    )


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``fill_in_middle`` was given, rebuilt from output and form; null stays null."""
    raw = tuple(m.encode() for m in marks)

    @F.pandas_udf("binary")
    def of(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([None if o is None else restored(bytes(o), f, raw) for o, f in zip(outputs, forms)], dtype=object)

    return of(output.cast("binary"), form).cast("string")
