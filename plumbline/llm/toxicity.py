"""Toxicity: a gapped-subsequence string kernel, Nyström landmarks and a linear support vector machine."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.values import col
from plumbline.llm.common import held_out

#: Labelled documents of each class that a model is fitted on.
SAMPLE_PER_CLASS = 2500
LANDMARKS = 400
THRESHOLD = 0.3
DECAY = 0.8
#: Places of the second and third character of a subsequence after its first: up to two gaps.
OFFSETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
#: The same for subsequences of four characters, with one gap at most; they are numbered by remainder.
OFFSETS_4 = ((1, 2, 3), (1, 2, 4), (1, 3, 4), (2, 3, 4))
REMAINDERS = 524_287
#: A longer token is scored in overlapping pieces, short enough that a word in it stands out.
PIECE = 28
PART, STEP = 9, 2
SYMBOLS = 64
NUMBERS = SYMBOLS**3 + REMAINDERS
CACHE = 400_000
TEXTS_AT_ONCE = 64

NO_LETTER = re.compile(r"[\W_]+")
SENTENCE = re.compile(r"(?<=[.!?\n])\s+")
SPACED = re.compile(r"(?<!\w)\w(?:[\W_]{1,3}\w(?!\w)){3,}")


def symbols(text: str) -> np.ndarray:
    """Per character 1 to 26 for a to z, 27 to 61 for all others; 62 and 63 mark the ends of a string."""
    n = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where((n >= 97) & (n <= 122), n - 96, 27 + n * 31 % 35).astype(np.int32)


def tokens(text: str) -> set[str]:
    """Distinct lower-case tokens; letters set apart (four or more) are read together too."""
    low = text.lower()
    found = set(low.split())
    found.update([m.group() for m in SPACED.finditer(low)])
    return found


def bare(token: str) -> str:
    return token if token.isalpha() else NO_LETTER.sub("", token)


def pieces(token: str) -> list[str]:
    return [token] if len(token) <= PIECE else [token[k : k + PART] for k in range(0, len(token) - PART + STEP, STEP)]


def features(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per string the numbers of its gapped subsequences of three and four characters, and their weights (0: none).

    A weight is the decay to the power of the gaps; rows have length 1, counting each place by itself.
    """
    width = min(PIECE, max(map(len, strings), default=0)) + 2
    text = np.zeros((len(strings), width + 4), np.int32)
    sizes = np.minimum([len(s) for s in strings], PIECE)
    row = np.repeat(np.arange(len(strings)), sizes)
    text[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1] = symbols("".join([s[:PIECE] for s in strings]))
    text[:, 0] = 62
    text[np.arange(len(strings)), sizes + 1] = 63
    codes, weights = [], []
    a = text[:, :width]
    for i, j in OFFSETS:
        b, c = text[:, i : i + width], text[:, j : j + width]
        codes.append((a * SYMBOLS + b) * SYMBOLS + c)
        weights.append((c > 0) * np.float32(DECAY ** (j - 2)))
    for i, j, k in OFFSETS_4:
        b, c, d = text[:, i : i + width], text[:, j : j + width], text[:, k : k + width]
        codes.append(SYMBOLS**3 + (((a * SYMBOLS + b) * SYMBOLS + c) * SYMBOLS + d) % REMAINDERS)
        weights.append((d > 0) * np.float32(DECAY ** (k - 3)))
    code, weight = np.concatenate(codes, 1), np.concatenate(weights, 1)
    norm = np.sqrt((weight**2).sum(1, keepdims=True))
    return code, weight / np.maximum(norm, np.float32(1e-9))


class Landmarks:
    """Landmark strings as columns over the subsequences that one of them has."""

    def __init__(self, strings: list[str]):
        self.strings = strings
        code, weight = features(strings)
        self.codes = np.unique(code[weight > 0])
        self.row = np.full(NUMBERS, len(self.codes), np.int32)
        self.row[self.codes] = np.arange(len(self.codes), dtype=np.int32)
        self.grid = np.zeros((len(self.codes) + 1, len(strings)), np.float32)  # the last row is for all others
        for k in range(len(strings)):
            there = weight[k] > 0
            np.add.at(self.grid[:, k], self.row[code[k][there]], weight[k][there])

    def kernel(self, strings: list[str]) -> np.ndarray:
        out = np.empty((len(strings), self.grid.shape[1]))
        for k in range(0, len(strings), 32):
            code, weight = features(strings[k : k + 32])
            out[k : k + 32] = np.einsum("np,npm->nm", weight.astype(np.float32), self.grid[self.row[code]])
        return out

    def slopes(self, coefficients: np.ndarray) -> np.ndarray:
        out = np.zeros(NUMBERS, np.float32)
        out[self.codes] = self.grid[:-1] @ coefficients
        return out


def support_vectors(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float | None = None) -> np.ndarray:
    """Linear SVM with squared hinge loss, by Newton steps over the rows inside the margin."""
    x = np.c_[z, np.ones(len(z))]
    w = np.zeros(x.shape[1])
    penalty = np.eye(len(w)) * (RIDGE if ridge is None else ridge)
    penalty[-1, -1] = 1e-6
    for _ in range(30):
        inside = y * (x @ w) < 1
        a = x[inside] * weight[inside, None]
        new = np.linalg.solve(penalty + a.T @ x[inside], a.T @ y[inside])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


@dataclass
class Model:
    slopes: np.ndarray  # per subsequence number
    offset: float
    scale: float  # of the logistic curve over the highest margin of a text
    shift: float

    def margins(self, strings: list[str]) -> np.ndarray:
        if not strings:
            return np.empty(0)
        code, weight = features(strings)
        return (self.slopes[code] * weight).sum(1) + self.offset

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * margin + self.shift, -30, 30)))


#: Share of toxic texts that scores are calibrated for.
TOXIC_SHARE = 0.1
#: Margin of a text without tokens.
NOTHING = -1.5
#: Weight of a clean token that scored among the highest.
HARD = 3.0
ROUNDS = 4
RIDGE = 0.1


class Scorer:
    """Highest token margin of each text; margins of tokens met before are kept, up to a bound."""

    def __init__(self, model: Model):
        self.model, self.cache = model, {}

    def learn(self, new: list[str]) -> None:
        strings, owner = [], []
        for t in new:
            for p in pieces(bare(t)):
                if len(p) > 1:
                    strings.append(p)
                    owner.append(t)
        self.cache.update(dict.fromkeys(new, NOTHING))
        # Strings of like length together: a block is as wide as its longest.
        order = sorted(range(len(strings)), key=lambda k: len(strings[k]))
        for k in range(0, len(order), 2048):
            some = order[k : k + 2048]
            for j, m in zip(some, self.model.margins([strings[j] for j in some]).tolist(), strict=True):
                if m > self.cache[owner[j]]:
                    self.cache[owner[j]] = m

    def highest(self, texts) -> np.ndarray:
        out = np.full(len(texts), NOTHING)
        for start in range(0, len(texts), TEXTS_AT_ONCE):
            if len(self.cache) > CACHE:
                self.cache = {}
            found = [tokens(t) if t else set() for t in texts[start : start + TEXTS_AT_ONCE]]
            new = set().union(*found).difference(self.cache)
            if new:
                self.learn(sorted(new))
            for k, some in enumerate(found, start):
                out[k] = max(map(self.cache.__getitem__, some), default=NOTHING)
        return out


def stems(token: str) -> list[str]:
    """The token and its beginnings of four characters or more."""
    return [token[:k] for k in range(min(4, len(token)), len(token) + 1)]


def witnesses(positive: list[set[str]], clean: list[set[str]], limit: int = 400) -> list[tuple[str, int]]:
    """Tokens of the positive texts that share a telling stem, and in how many they are, most frequent first.

    Telling stems are those in 2 % of the positive texts, and a greedy cover: a rarer stem counts only
    for texts that none before it explains, so copies of a text add nothing of their own. A stem must be
    at least 20 times as frequent in positive texts as in clean ones, and explain more texts than chance
    would for some stem.
    """
    # Counted by hash first: most stems are too rare to be kept as text.
    seen = [np.fromiter({hash(s) for t in found for s in stems(t)}, np.int64) for found in positive]
    values, counts = np.unique(np.concatenate(seen), return_counts=True)
    rate = len(positive) / (len(positive) + len(clean))
    least = max(3, math.ceil(0.6 * math.log(max(2, len(values))) / -math.log(rate)))
    frequent = set(values[counts >= least].tolist())
    at: dict[str, set[int]] = {}
    for k, found in enumerate(positive):
        for s in {s for t in found for s in stems(t)}:
            if hash(s) in frequent:
                at.setdefault(s, set()).add(k)
    negative = Counter(s for found in clean for s in {s for t in found for s in stems(t)} if s in at)
    pure = {s: k for s, k in at.items() if negative[s] * len(positive) <= 0.05 * len(k) * len(clean)}
    order = sorted(pure, key=lambda s: (-len(pure[s]), -len(s), s))
    open_, chosen = set(range(len(positive))), []
    while order:
        best = max(order, key=lambda s: (len(pure[s] & open_), len(s)))
        if len(pure[best] & open_) < least:
            break
        chosen.append(best)
        open_ -= pure[best]
        order = [s for s in order if len(pure[s] & open_) >= least]
    chosen += [s for s, k in pure.items() if len(k) >= max(2 * least, 0.02 * len(positive))]
    tokens_ = Counter(t for found in positive for t in found if t.startswith(tuple(chosen))) if chosen else Counter()
    return sorted(tokens_.items(), key=lambda x: (-x[1], x[0]))[:limit]


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE.split(text) if s]


def with_gaps(strings: list[str], rng: np.random.Generator) -> list[str]:
    """Each string with one character put in at a place inside, twice, and with one doubled."""
    out = []
    for s in strings:
        for _ in range(2):
            k = int(rng.integers(1, max(2, len(s))))
            out.append(s[:k] + "abcdefghijklmnopqrstuvwxyz"[int(rng.integers(26))] + s[k:])
        k = int(rng.integers(0, len(s)))
        out.append(s[: k + 1] + s[k:])
    return out


def fit(texts: list[str], toxic: list[int], landmarks: int = LANDMARKS, seed: int = 7) -> Model | None:
    """A model from labelled texts; None unless both classes and a telling token are there.

    A text is the bag of its sentences, a sentence the bag of its tokens: a toxic text has at least one
    telling token, a clean text none. Witness tokens start as a cover of the toxic texts; each round
    then adds the clean tokens that score highest.
    """
    seen: dict[str, str] = {}  # one string per token, however many texts have it
    bags = []
    for t, y in zip(texts, toxic, strict=True):
        found = (b for x in set().union(*map(tokens, sentences(t))) for b in pieces(bare(x)) if len(b) > 1)
        bags.append(({seen.setdefault(b, b) for b in found}, y))
    del seen
    positive, clean = [b for b, y in bags if y], [b for b, y in bags if not y]
    if not positive or not clean:
        return None
    negative = Counter(t for b in clean for t in b)
    found = [(t, n) for t, n in witnesses(positive, clean) if len(t) > 2]
    if not found:
        return None
    telling = [t for t, _ in found]
    often = np.sqrt([n for _, n in found])
    rng = np.random.default_rng(seed)
    others = sorted(negative)
    other = [others[k] for k in rng.choice(len(others), min(len(others), 4000), replace=False)]
    yes = telling + with_gaps(telling, rng)
    model, strict = None, []
    for _ in range(ROUNDS):
        # A third each: telling tokens, clean tokens that were taken for such, and any.
        third = landmarks // 3
        chosen = [*telling[:third], *strict[:third]]
        chosen += other[: landmarks - len(chosen)]
        marks = Landmarks(list(dict.fromkeys(chosen)))
        root = np.linalg.eigh(marks.kernel(marks.strings))
        good = root[0] > 1e-6 * root[0].max()
        to_z = root[1][:, good] / np.sqrt(root[0][good])
        strings = yes + other
        y = np.r_[np.ones(len(yes)), -np.ones(len(other))]
        balance = np.r_[4 * often / often.mean(), np.ones(len(yes) - len(telling))] * len(other) / len(yes)
        feared = set(strict)
        balance = np.r_[balance, np.array([HARD if t in feared else 1.0 for t in other])]
        w = support_vectors(marks.kernel(strings) @ to_z, y, balance)
        model = Model(marks.slopes(to_z @ w[:-1]), float(w[-1]), 1.0, 0.0)
        margins = np.concatenate([model.margins(others[k : k + 4096]) for k in range(0, len(others), 4096)])
        hard = [others[k] for k in np.argsort(-margins)[:1500]]
        other = sorted({*other, *hard})
        strict = list(dict.fromkeys([*hard[:300], *strict]))
    best = dict(zip(others, margins.tolist(), strict=True))
    top_clean = np.array([max((best[t] for t in b), default=NOTHING) for b in clean])
    unseen = sorted({t for b in positive for t in b} - best.keys())
    best |= dict(zip(unseen, np.concatenate([model.margins(unseen[k : k + 4096]) for k in range(0, max(1, len(unseen)), 4096)]).tolist(), strict=True))
    top_toxic = np.array([max((best[t] for t in b), default=NOTHING) for b in positive])
    model.scale, model.shift = logistic(np.r_[top_toxic, top_clean], np.r_[np.ones(len(top_toxic)), np.zeros(len(top_clean))])
    return model


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps, with smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y > 0, TOXIC_SHARE / n1, (1 - TOXIC_SHARE) / n0) * len(y)
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = weight * (p - t)
        h = weight * np.maximum(p * (1 - p), 1e-6)
        hessian = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hessian, [(g * x).sum() + 1e-3 * a, g.sum()])
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample_per_class: int = SAMPLE_PER_CLASS,
    landmarks: int = LANDMARKS,
) -> Model | None:
    """Fits on at most ``sample_per_class`` labelled documents of each class, those with the smallest key hash.

    Held-out keys, null keys, null labels and null texts are left out; a key labelled twice counts as toxic if
    one label says so. Only the sample's texts reach the driver.
    """
    known = labels.where(col(key).isNotNull() & col(label).isNotNull() & ~held_out(col(key)))
    known = known.groupBy(col(key).alias("key_")).agg(F.max(F.when(col(label) > 0, 1).otherwise(0)).alias("y"))
    order = F.xxhash64(F.lit(3), F.col("key_"))
    ids = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(order, "key_").limit(sample_per_class)
        ids = part if ids is None else ids.union(part)
    # Bounded by the sample size, so it may be broadcast.
    rows = docs.where(col(text).isNotNull()).select(col(key).alias("key_"), col(text).alias("text_")).join(F.broadcast(ids), "key_")
    found = {}
    for r in rows.toLocalIterator():
        if r.key_ not in found or r.text_ < found[r.key_][0]:
            found[r.key_] = (r.text_, r.y)
    ordered = [found.pop(k) for k in sorted(found)]
    return fit([t for t, _ in ordered], [y for _, y in ordered], landmarks)


def score(model: Model | None, text: Column) -> Column:
    """Probability that a text is toxic, from the most telling of all its tokens.

    Null and empty texts get the lowest score, that of a text without tokens. Without a model every score is 0.
    """
    if model is None:
        return F.lit(0.0)
    scorer = []

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        if not scorer:
            scorer.append(Scorer(model))
        return pd.Series(model.probability(scorer[0].highest(list(texts))))

    return of(text)


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: key, held_out, score."""
    model = train(docs, labels, key, text, **options)
    return docs.select(col(key), held_out(col(key)).alias("held_out"), score(model, col(text)).alias("score"))


def without_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns as they are."""
    return docs.where(score(train(docs, labels, text=text, **options), col(text)) < threshold)
