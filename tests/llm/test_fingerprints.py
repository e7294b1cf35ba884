"""Edited texts, equal fingerprints of equal texts, and likeness against the digest sets."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
import xxhash

from wayfold.llm.iblt import fingerprints


def digests(text):
    return {xxhash.xxh64(p.encode(), seed=42).intdigest() for p in re.findall(r"[^\n]{1,100}", text)}


def likeness(a, b):
    x, y = digests(a), digests(b)
    return 1.0 if not x and not y else 1.0 - len(x ^ y) / (len(x) + len(y))


@pytest.mark.parametrize("which", ["fixture", "table"])
def test_against_the_definition(docs, table, which):
    frame = docs.where("doc_id is not null and doc_id <> 430") if which == "fixture" else table("documents")
    rows = sorted((r.doc_id, r.text or "") for r in frame.select("doc_id", "text").collect())
    found = {r.doc_id: r for r in fingerprints(frame).collect()}
    assert len(found) == len(rows)
    prints: dict = {}
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = found[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest()), d
        assert abs(r.near_edited - likeness(t, edited)) < 1e-9, d
        assert abs(r.near_next - likeness(t, after)) < 1e-9, d
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        assert prints.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
    assert len({r.fingerprint for r in found.values()}) == len({frozenset(digests(t)) for _, t in rows})


def test_edges(docs, empty):
    assert fingerprints(docs).count() == docs.count()
    assert fingerprints(empty).count() == 0
    one = fingerprints(docs.where("doc_id = 413")).collect()
    assert one[0].near_next == 1.0


def test_a_very_long_text(spark):
    rng = random.Random(4)
    lines = ["".join(rng.choices("abcdefghij", k=30)) for _ in range(80_000)]  # 2.5 million characters
    rows = [(1, "\n".join(lines)), (2, "\n".join(lines[:70_000] + lines[79_000:])), (3, "\n".join(lines[:50]))]
    found = {r.doc_id: r for r in fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = [t for _, t in rows]
    for i, t in enumerate(texts):
        assert abs(found[i + 1].near_next - likeness(t, texts[(i + 1) % 3])) < 1e-9
    count, _, shards = found[1].fingerprint.partition(";")
    assert int(count) == 16384 and shards.count(";") > 16000
