"""Language identification by a string kernel: n-gram presence, Nyström landmarks, kernel ridge regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.values import col
from plumbline.llm.common import held_out

#: Labelled documents of each language that a model is fitted on, and landmarks among them.
SAMPLE_PER_LANGUAGE = 400
LANDMARKS_PER_LANGUAGE = 60
RIDGE = 1e-2
UNDETERMINED = "und"
#: Symbols: 0 for all that is no letter, 1 to 26 for a to z, 27 to 127 for all other letters, by code point.
SYMBOLS = 128
SIZES = (1, 2, 3)
GRAMS = sum(SYMBOLS**k for k in SIZES)
PART = 1 << 16


def symbol_table() -> np.ndarray:
    """Symbol of each code point of the basic plane, after lower-casing; other planes go by the rule for letters."""
    table = np.zeros(1 << 16, np.int64)
    for n in range(1 << 16):
        c = chr(n)
        if c.isalpha():
            low = ord(c.lower()[0])
            table[n] = low - 96 if 97 <= low <= 122 else 27 + low % 101
    return table


TABLE = symbol_table()


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(points < 1 << 16, TABLE[np.minimum(points, (1 << 16) - 1)], 27 + points.astype(np.int64) % 101)


class Presence:
    """Marks the n-grams (sizes 1 to 3) of one text at a time; runs of non-letters count as one."""

    def __init__(self):
        self.seen = np.zeros(GRAMS, bool)

    def mark(self, text: str) -> list[np.ndarray]:
        """Sets ``seen``; returns what has to be cleared. Long texts are read in overlapping parts."""
        s = symbols(text)
        if len(s):
            s = s[np.r_[True, (s[1:] > 0) | (s[:-1] > 0)]]
        marked = []
        for k in range(0, len(s), PART):
            part = s[k : k + PART + max(SIZES) - 1]
            code, start = part, 0
            for size in SIZES:
                if size > 1:
                    code = code[: len(part) - size + 1] * SYMBOLS + part[size - 1 :]
                if len(code):
                    marked.append(code + start)
                    self.seen[code + start] = True
                start += SYMBOLS**size
        return marked

    def clear(self, marked: list[np.ndarray]) -> None:
        for m in marked:
            self.seen[m] = False

    def grams(self, text: str) -> np.ndarray:
        marked = self.mark(text)
        out = np.unique(np.concatenate(marked)) if marked else np.empty(0, np.int64)
        self.clear(marked)
        return out


@dataclass
class Model:
    languages: list[str]
    vocabulary: np.ndarray  # n-grams that a landmark has
    slopes: np.ndarray  # vocabulary x languages: landmark rows times their coefficients
    offsets: np.ndarray


def fit(samples: list[tuple[np.ndarray, str]], landmarks_per_language: int = LANDMARKS_PER_LANGUAGE) -> Model | None:
    """One-versus-rest kernel ridge regression on landmark features.

    The kernel of two texts is the number of n-grams that both have, over the root of the product of their
    numbers of n-grams, among the n-grams of landmarks.
    """
    samples = [(g, y) for g, y in samples if len(g)]
    languages = sorted({y for _, y in samples})
    if not languages:
        return None
    marks = []
    for lang in languages:
        marks += [g for g, y in samples if y == lang][:landmarks_per_language]
    vocabulary = np.unique(np.concatenate(marks))

    def rows(texts):
        out = np.zeros((len(texts), len(vocabulary)), np.float32)
        for k, g in enumerate(texts):
            out[k, np.flatnonzero(np.isin(vocabulary, g, assume_unique=True))] = 1
        return out / np.sqrt(np.maximum(out.sum(1, keepdims=True), 1))

    m, x = rows(marks), rows([g for g, _ in samples])
    k_mm, k_nm = (m @ m.T).astype(float), (x @ m.T).astype(float)
    y = np.array([[1.0 if lang == of else -1.0 for lang in languages] for _, of in samples])
    # Languages weigh alike, however many samples they have.
    share = np.array([1 / sum(of == other for _, other in samples) for _, of in samples])
    share = share / share.mean()
    center = (share[:, None] * y).mean(0)
    a = k_nm.T @ (share[:, None] * k_nm) + RIDGE * len(samples) * k_mm + 1e-8 * np.eye(len(marks))
    coefficients = np.linalg.solve(a, k_nm.T @ (share[:, None] * (y - center)))
    return Model(languages, vocabulary, (m.T @ coefficients).astype(np.float32), center)


def predictor(model: Model | None):
    state: list[Presence] = []

    def predict(texts: list[str | None]) -> list[tuple[str, float]]:
        if not state:
            state.append(Presence())
        presence = state[0]
        out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
        some = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if model is None:
            return out
        for start in range(0, len(some), 128):
            batch = some[start : start + 128]
            x = np.empty((len(batch), len(model.vocabulary)), np.float32)
            for r, k in enumerate(batch):
                marked = presence.mark(texts[k])
                x[r] = presence.seen[model.vocabulary]
                presence.clear(marked)
            f = x @ model.slopes / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)) + model.offsets
            best = f.argmax(1)
            for r, k in enumerate(batch):
                out[k] = (model.languages[best[r]], float(np.clip((1 + f[r, best[r]]) / 2, 0, 1)))
        return out

    return predict


def train(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sample_per_language: int = SAMPLE_PER_LANGUAGE,
    landmarks_per_language: int = LANDMARKS_PER_LANGUAGE,
) -> Model | None:
    """Fits on about ``sample_per_language`` documents of each language, those with the smallest key hash.

    Held-out keys, null keys, null languages and null texts are left out. Languages are counted over all rows;
    the driver gets the distinct n-grams of the sample, whose number is bounded by the symbols.
    """
    known = docs.where(col(key).isNotNull() & col(lang).isNotNull() & col(text).isNotNull() & ~held_out(col(key)))
    counts = {r.lang: r.n for r in known.groupBy(col(lang).alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    place = F.pmod(F.xxhash64(F.lit(5), col(key)), F.lit(1 << 30)) / float(1 << 30)
    limits = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample_per_language / n))))
    sample = known.where(place < limits[col(lang)]).select(
        col(lang).alias("lang"), F.xxhash64(F.lit(5), col(key)).alias("h"), col(text).alias("text")
    )
    grams = sample.mapInPandas(gram_rows, "lang string, h long, grams array<long>")
    rows = sorted(((r.lang, r.h, r.grams) for r in grams.toLocalIterator()), key=lambda r: (r[0], r[1], len(r[2])))
    return fit([(np.array(g, np.int64), y) for y, _, g in rows], landmarks_per_language)


def gram_rows(frames):
    presence = Presence()
    for f in frames:
        yield pd.DataFrame({"lang": f["lang"], "h": f["h"], "grams": [presence.grams(t) for t in f["text"]]})


def language(model: Model | None, text: Column) -> Column:
    """Struct of lang_pred and score (0 to 1); ``und`` and 0 for null, letterless and empty texts, or without a model."""
    predict = predictor(model)

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(predict(list(texts)), columns=["lang_pred", "score"])

    return of(text)


def identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """One row per row of ``docs``: key, held_out, lang_pred and score, from the whole text alone.

    Repeated rows are predicted alike. An empty or unlabelled table has no model: all is ``und``. Other columns are not read.
    """
    model = train(docs, key, text, lang, **options)
    out = docs.select(col(key), held_out(col(key)).alias("held_out"), language(model, col(text)).alias("found_"))
    return out.select(col(key), "held_out", "found_.lang_pred", "found_.score")
