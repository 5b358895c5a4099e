import hashlib
import random

import pytest

from plumbline.llm import mixing


def plain_targets(sizes):
    """The excess of full sources is shared out again until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not full:
            return target | {s: left * weight[s] / total for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


def rows():
    rng = random.Random(5)
    out = [(k, "w " * rng.randrange(0, 300), "en", rng.choice(["hot"] * 6 + ["b", "é", "Z", None])) for k in range(400)]
    return out + [(None, "a b c", "en", "b"), (None, None, None, None), (3, "a b c", "en", "b"), (3, "a b c", "en", "b"), (900, "x " * 40_000, "en", "b")]


def test_targets_and_words_taken(make):
    data = rows()
    mix = mixing.mix(make(data))
    got = mixing.taken(mix).collect()
    assert len(got) == len(data)
    sizes, words = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        words[r.source] = words.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = plain_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert want[s] - mixing.BLOCK_WORDS - 1 <= words[s] <= want[s] + 1
    again = mixing.taken(mixing.mix(make(data[::-1]))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_any_stretch_of_the_schedule_is_close_to_the_weights(make):
    mix = mixing.mix(make(rows()))
    slots = {r.slot: r.place for r in mix.pieces.select("slot", "place").distinct().collect()}
    targets = {r.place: r.target for r in mix.sources.collect()}
    total, order = sum(targets.values()), [slots[k] for k in sorted(slots)]
    # Blocks are rounded up to whole words, so the sources run out together a little before the end.
    last = int(0.95 * len(order))
    assert sorted(slots)[:last] == list(range(last))
    for n in (64, last // 3, last):
        for p, t in targets.items():
            assert abs(order[:n].count(p) - n * t / total) <= 8


def test_pieces_follow_the_shuffled_words(make):
    data = rows()
    mix = mixing.mix(make(data))
    by_source = {}
    for k, text, _, source in data:
        key = hashlib.md5(f"20:{'' if k is None else k}".encode()).hexdigest()
        by_source.setdefault(source, []).append((key, len((text or "").split()), k))
    place = {r.source: r.place for r in mix.members.select("source", "place").distinct().collect()}
    pieces = {}
    for r in mix.pieces.collect():
        pieces.setdefault(r.place, []).append((r.epoch, r.at, r.start, r.key, r.n_words))
    for source, docs in by_source.items():
        stream = [k for _, n, k in sorted(docs, key=lambda d: (d[0], d[1])) for _ in range(n)]
        taken = [k for *_, k, n in sorted(pieces[place[source]], key=lambda p: p[:3]) for _ in range(n)]
        assert taken == (stream * 2)[: len(taken)]


def test_rows_come_whole(make):
    data = rows()
    out = mixing.mixed_rows(make(data))
    assert out.columns == make(data).columns
    got = out.collect()
    ids = [r.doc_id for r in got]
    assert max(ids.count(k) for k in range(400)) == 2 and all(r.text for r in got)
    words, want = sum(len(r.text.split()) for r in got), 1.5 * sum(len((t or "").split()) for _, t, *_ in data)
    assert abs(words - want) < 45_000  # one very long text


def test_without_words(make):
    for data in ([], [(1, None, "en", "a"), (2, " ", "en", None)]):
        mix = mixing.mix(make(data))
        got = mixing.taken(mix).collect()
        assert sorted((r.key, r.size, r.target, r.taken) for r in got) == [(i, 0, 0.0, 0) for i, *_ in data]
        assert mix.pieces.collect() == [] and mixing.mixed_rows(make(data)).collect() == []
