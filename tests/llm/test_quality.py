"""The classifier on its held-out fold."""

from __future__ import annotations

import zlib

import numpy as np

from wayfold.llm.quality_fm import Machine, quality


def test_held_out_ranking(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = quality(docs, labels)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "quality").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(r.score, r.quality) for r in rows if r.held_out and r.quality is not None]
    good, bad = np.array([s for s, q in held if q]), np.array([s for s, q in held if not q])
    auc = (good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean()
    assert auc >= 0.9, auc


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    m = Machine(0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    index, x = np.array([1, 4, 8]), np.array([0.5, 2.0, -1.0])
    pairs = sum(m.v[index[i]] @ m.v[index[j]] * x[i] * x[j] for i in range(3) for j in range(i + 1, 3))
    assert np.isclose(m.logits(np.array([0, 3]), index, x)[0][0], 0.3 + m.w[index] @ x + pairs)


def test_edges(spark, docs, empty):
    labels = spark.createDataFrame([(20, 1, 0), (21, 1, 0), (None, 1, 0), (400, 0, 0), (402, None, 0), (403, 0, None), (403, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in rows)
    assert quality(empty, labels).count() == 0
