"""The rules of ``textquality`` and ``functions.markdown`` for one text at a time, in plain Python.

For operators that work through whole texts in Arrow batches: a rule costs a
tenth of the same rule as a column expression there. Tests hold the two equal.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from itertools import pairwise

from ..functions.markdown import ISSUE_WORDS, SHORTEST_TEXT
from .textquality import FAILURE_PHRASES

_BLANK_RUN = re.compile(r"\n\s*\n\s*\n")
_HEADER_THEN_TEXT = re.compile(r"\n(#[^\n]*)\n(?=[^#\n])")
_HEADER = re.compile(r"\n#{1,6}[^\S\n]+([^\n]+)")
_LINE_START = re.compile(r"\n\s*(#?)")
_BLOCK_BREAK = re.compile(r"\n#+\s+")


def repetitive(text: str) -> bool:
    """As ``textquality.repetitive``.

    The two words in the middle of a phrase stand whole between single blanks
    wherever it occurs, so only phrases around a pair that does so three times are looked at.
    """
    spaced = text.split(" ")[1:-1]
    if len(spaced) - 1 - len(set(pairwise(spaced))) < 2:
        return False
    words = text.split()
    n = len(words)
    if n <= 10:
        return False
    seen: set[tuple[str, str]] = set()
    again = Counter(p for p in pairwise(spaced) if p in seen or seen.add(p))
    places: dict[tuple[str, str], list[int]] = {p: [] for p, m in again.items() if m > 1}
    for i, pair in enumerate(pairwise(words)):
        if pair in places:
            places[pair].append(i)
    for at in places.values():
        # A phrase may end within a word: sorted, the words that begin with its last one follow it.
        ends = sorted((words[i + 2], i - 1) for i in at if 0 < i < n - 2)
        first: dict[str, int] = {}
        for r, (end, _) in enumerate(ends):
            first.setdefault(end, r)
        often = {end for end, r in first.items() if r + 2 < len(ends) and ends[r + 2][0].startswith(end)}
        # The last phrases of a text are occurrences but not candidates.
        phrases = {" ".join(words[i : i + 4]) for end, i in ends if end in often and i <= n - 7}
        if any(text.count(p) > 2 for p in phrases):
            return True
    return False


def mostly_headers(text: str) -> bool:
    """As ``textquality.mostly_headers``."""
    text = "\n" + text.strip()
    starts = _LINE_START.findall(text)  # of lines that are not blank
    return 2 * starts.count("#") > len(starts) and text.count("\n") > 5


def is_low(text: str | None) -> bool:
    """Any reason of ``textquality.low_quality`` at all; the costly one comes last."""
    if text is None or len(text.strip()) < SHORTEST_TEXT:
        return True
    low = text.lower()
    for phrase in FAILURE_PHRASES:
        if phrase in low:
            return True
    parts = text.split(".")
    sentences = len(parts) - len([s for s in parts if not s or s.isspace()])
    # Fewer than three sentences, or than three words to a sentence.
    if sentences < 3 or len(text.replace(".", " ").split(None, 3 * sentences)) < 3 * sentences:
        return True
    return ("#" in text and mostly_headers(text)) or repetitive(text)


def clean_markdown(text: str) -> str:
    """As ``markdown.clean_markdown``."""
    text = _BLANK_RUN.sub("\n\n", text).strip()
    return _HEADER_THEN_TEXT.sub(r"\n\1\n\n", "\n" + text)[1:]


@lru_cache(1_000)
def _section_key(header: str) -> str:
    return header.strip().lower().replace(" ", "_")


def filled_sections(text: str) -> dict[str, str]:
    """Content by section as in ``markdown.sections``, without blank ones."""
    parts = _HEADER.split("\n" + text)  # what leads, then headers and contents by turns
    last = dict(zip(map(_section_key, parts[1::2]), parts[2::2]))
    return {s: stripped for s, content in last.items() if s and (stripped := content.strip())}


def _block(raw: str) -> str:
    block = raw.strip()
    return block if block.startswith("#") else f"### {raw.split('.', 1)[0].strip()}\n{raw}".strip()


def format_profiles(text: str) -> str:
    """As ``markdown.format_profiles``."""
    if not text.strip():
        return ""
    blocks = _BLOCK_BREAK.split(text)[1:]
    if not blocks:
        return text
    ranked = sorted((b for b in blocks if b.strip()), key=lambda b: -sum(w in low for low in (b.lower(),) for w in ISSUE_WORDS))
    return "\n\n".join(map(_block, ranked))
