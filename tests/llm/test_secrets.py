"""Base spans against the plain rules, the network against fresh findings, masking."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from wayfold.llm.secret_scan import base_spans, candidates, labelled_findings, redacted, scan, train, window

RULES = [
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
]


def plain(text):
    spans = []
    for k, (name, rule, group, least) in enumerate(RULES):
        spans += [(m.start(), k, m.end(), name) for m in rule.finditer(text or "") if len(m[group]) >= least and all(ord(c) < 128 for c in m[0])]
    return sorted(spans)


@pytest.mark.parametrize("which", ["fixture", "table"])
def test_base_spans(docs, table, which):
    frame = docs if which == "fixture" else table("documents")
    texts: dict = {}
    for r in frame.select("doc_id", "text").collect():
        texts.setdefault(r.doc_id, []).append(plain(r.text))
    found = scan(frame).collect()
    assert len(found) == sum(map(len, texts.values()))
    for r in found:
        options = texts[r.doc_id]
        digests = {hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, b, n in s).encode()).hexdigest(): s for s in options}
        assert r.base_sha256 in digests
        s = digests[r.base_sha256]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in s) for k in range(3))
        kept = [x for x in r.spans.split(",") if x and not x.startswith("learned")]
        assert kept == [f"{n}:{a}:{b}" for a, _, b, n in s]


def test_network_on_fresh_findings():
    net = train()
    x, y = labelled_findings(600, seed=99)
    p = net.probability(np.minimum(x, 127)) >= net.threshold
    assert p[y == 1].mean() >= 0.95 and p[y == 0].mean() <= 0.1


def test_learned_spans_and_masking(docs, empty):
    net = train()
    rows = {r.doc_id: r for r in scan(docs.where("doc_id in (442, 410)"), net).collect()}
    assert "learned:4:38" in rows[442].spans and rows[442].spans.count("learned") == 1
    masked = {r.doc_id: r for r in redacted(docs.where("doc_id in (440, 441, 442, 410)"), net).collect()}
    assert masked[410].text is None
    assert "hunter2" not in masked[440].text and "token=short" in masked[440].text and "[secret]" in masked[442].text
    assert masked[441].text == "😀 [secret] x" and masked[441].n_chars == len(masked[441].text)
    assert redacted(docs, net).columns == docs.columns
    assert scan(empty, net).count() == 0 and redacted(empty, net).count() == 0


def test_every_make_up_reaches_the_network():
    rng = np.random.default_rng(3)
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"):
        value = "".join(rng.choice(list(alphabet), 24))
        assert candidates(f"key {value} here", []) == [(4, 28)]
    # a base span that covers a part of a run neither hides the rest nor leaves it in the text
    tail = "".join(rng.choice(list("ghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ"), 120))
    text = "use " + "0123456789" * 4 + tail + " now"
    base = base_spans(text)
    assert base == [(4, 2, 44)] and candidates(text, base) == [(4, 164)]
    assert candidates("use " + "0123456789" * 4 + " now", [(4, 2, 44)]) == []


def test_masking_takes_the_union_of_partly_overlapping_spans(spark):
    rng = np.random.default_rng(5)
    text = "use " + "0123456789ab" * 3 + "".join(rng.choice(list("ghijkmnpqrstuvwxyzGHJKLMNPQRSTUVWXYZ23456789"), 100)) + " now"
    (row,) = redacted(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.text == "use [secret] now"


def test_recall_and_precision_on_the_tables_own_findings(table):
    """The network alone finds what the base rules find in runs with letters, and leaves the table's long words alone."""
    net, found, words = train(), [], []
    for r in table("documents").select("text").where("text is not null").collect():
        base = base_spans(r.text)
        for a, b in candidates(r.text, []):
            here = (window(r.text, a, b), r.text[a:b])
            if any(s < b and a < e for s, _, e in base):
                found += [here] if not here[1].isdigit() else []
            elif here[1].isalpha():
                words.append(here)
    fires = lambda x: net.probability(np.minimum(np.frombuffer(b"".join(w for w, _ in x), np.uint8).reshape(len(x), -1), 127)) >= net.threshold
    assert len(words) > 100 and fires(words).mean() <= 0.02
    assert not found or fires(found).mean() >= 0.9
