"""Importance resampling against a plain version, its SQL, and edge cases."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.compare import connect, differences
from wayfold.llm import importance, queries
from wayfold.llm.importance import dictionary, resampled

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def counted(text):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), Counter(w) + Counter(" ".join(p) for p in zip(w, w[1:]))


def plain(docs, targets, buckets=10_000, percent=25, least=20, seed=7):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    texts = [(d, *counted(t)) for d, t in docs]
    s, t = Counter(), Counter()
    for _, _, c in texts:
        for f, n in c.items():
            s[bucket(f)] += n
    for x in targets:
        for f, n in counted(x)[1].items():
            t[bucket(f)] += n
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for d, words, c in texts:
        weight = sum(n * gain(bucket(f)) for f, n in c.items()) // max(c.total(), 1)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= least))
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = Counter()
    for k, r in enumerate(order[: percent * len(order) // 100]):
        drawn[r[:4] + (k + 1,)] += 1
    return rows, order, drawn


def agree(found, docs, targets):
    """Rows of one doc_id and score may change places among themselves."""
    rows, order, drawn = plain(docs, targets)
    assert Counter(r[:4] for r in rows) == Counter(tuple(r)[:4] for r in found)
    ranks = sorted((r for r in found if r.rank is not None), key=lambda r: r.rank)
    assert [r.rank for r in ranks] == list(range(1, drawn.total() + 1))
    assert [(r.doc_id, r.score) for r in ranks] == [(r[0], r[3]) for r in order[: len(ranks)]]


def test_equals_plain_version_on_edge_cases(spark, docs):
    targets = ["One TWO three w1 w2", None, "", "naïve café 漢字"]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    agree(resampled(docs, spark.createDataFrame([(x, "c") for x in targets], "text string, class string")).collect(), rows, targets)


def test_query_equals_plain_version(spark, sf_dir, table):
    rows = [(r.doc_id, r.text) for r in table("documents").select("doc_id", "text").collect()]
    agree(queries.op12_importance_resampling(spark, sf_dir).collect(), rows, [r.text for r in table("benchmark").collect()])


def test_query_equals_sql(spark, sf_dir):
    assert differences(queries.op12_importance_resampling(spark, sf_dir), connect(sf_dir), queries.ORACLE_SQL["op12_importance_resampling"]) == ""


@pytest.mark.parametrize("chunk", [1, 3000, importance.CHUNK])
def test_dictionary_counts_every_occurrence_whatever_the_chunk(docs, chunk, monkeypatch):
    import pyarrow as pa

    total: Counter = Counter()
    column = pa.array([r.text for r in docs.select("text").collect()], pa.string())
    for _, _, data, offsets in importance.text_chunks(column, chunk):
        words, key, text, n_words = importance.features(data, offsets)
        distinct, n = np.unique(key, return_counts=True)
        total.update(dict(zip([x.decode() for x in importance.strings(words, distinct).to_pylist()], n.tolist())))
    want: Counter = Counter()
    for t in column.to_pylist():
        want.update(counted(t)[1])
    assert total == want
    if chunk == importance.CHUNK:
        assert {r.feature: r.n for r in dictionary(docs).collect()} == want


def test_side_by_side_crc32():
    import pyarrow as pa

    values = [b"", b"a", b"two words", "é 漢".encode(), b"x" * 64, b"x" * 65, b"y" * 100_000, bytes(range(200, 256)), b"a"]
    assert importance.crc32s(pa.array(values, pa.binary())).tolist() == [zlib.crc32(v) for v in values]
    assert importance.crc32s(pa.array(values, pa.binary()).slice(3, 4)).tolist() == [zlib.crc32(v) for v in values[3:7]]
    assert importance.crc32s(pa.array([], pa.binary())).tolist() == []


def test_one_doc_id_in_most_rows(spark):
    text = " ".join(f"word{i}" for i in range(30))
    rows = [(1, text)] * 300 + [(i, text) for i in range(2, 50)] + [(None, text)] * 50
    agree(resampled(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame([(text,)], "text string")).collect(), rows, [text])


def test_empty(spark, empty):
    targets = spark.createDataFrame([], "text string")
    assert resampled(empty, targets).collect() == []
    got = resampled(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), targets).collect()
    agree(got, [(1, "a b"), (2, None)], [])
