"""Targets by plain water filling; taken words near them; reruns agree."""

from __future__ import annotations

import math
from collections import Counter

import pytest

from tests.llm.fixtures import WORD
from wayfold.llm.mixing import copies, mix

OPTIONS = {"weights": (5, 2, 1), "share": 1.5, "cap": 2.0}


def plain_targets(sizes: dict) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] >= 2.0 * sizes[s]]
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


@pytest.mark.parametrize("which", ["fixture", "table"])
def test_mix(docs, table, which):
    frame = docs if which == "fixture" else table("documents")
    rows = frame.select("doc_id", "text", "source").collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want = plain_targets(sizes)
    found = mix(frame, **OPTIONS).collect()
    assert Counter((r.doc_id, r.size) for r in found) == Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in rows)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in found)
    by_target: dict = {}
    for r in found:
        by_target.setdefault((r.source_size, round(r.target, 6)), []).append(r)
    assert sorted(by_target) == sorted({(n, round(want[s], 6)) for s, n in sizes.items()})
    for (_, target), own in by_target.items():
        if sum(w == target for w in (round(x, 6) for x in want.values())) == 1:
            assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own)
    assert Counter(map(tuple, mix(frame.repartition(5), **OPTIONS).collect())) == Counter(map(tuple, found))


def test_copies_follow_the_decisions(docs, empty):
    taken = Counter()
    for r in mix(docs, **OPTIONS).collect():
        taken[(r.doc_id, r.size)] += r.taken
    got = Counter()
    out = copies(docs, **OPTIONS)
    assert out.columns == docs.columns
    for r in out.collect():
        n = len(WORD.findall(r.text or ""))
        got[(r.doc_id, n)] += n
    assert +got == +taken
    assert mix(empty, **OPTIONS).count() == 0 and copies(empty, **OPTIONS).count() == 0


def test_unequal_probabilities(docs):
    liked = docs.withColumn("liked", docs.doc_id % 2 * 3.0 + 0.1)
    assert mix(liked, **OPTIONS).count() == docs.count()


def test_inclusion_follows_the_preference(spark):
    """Of documents of one size and source, those with three times the preference are taken three times as often."""
    rows = [(i, "one two three four", "a", float(1 + 2 * (i % 2)), 0) for i in range(6000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, liking double, _liking int")
    found = copies(frame, weights=(1,), share=0.4, cap=2.0, preference="liking").select("doc_id").collect()
    taken = Counter(r.doc_id % 2 for r in found)
    assert abs(sum(taken.values()) - 2400) <= 2  # certain copies are none at this share
    assert abs(taken[1] / 3000 - 0.6) < 0.04 and abs(taken[0] / 3000 - 0.2) < 0.04


def test_longer_documents_are_likelier_by_default(spark):
    rows = [(i, "word " * (4 if i % 2 else 400), "a") for i in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mix(frame, weights=(1,), share=0.5, cap=2.0).where("taken > 0").collect()
    long, short = (sum(r.doc_id % 2 == k for r in found) for k in (0, 1))
    assert abs(long / short - math.log(402) / math.log(6)) < 0.6
