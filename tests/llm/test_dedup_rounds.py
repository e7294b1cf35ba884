"""Embedding near-dedup where a label is large for its window and its vectors share a mean."""

from __future__ import annotations

import numpy as np

from wayfold.llm.embed_dedup import near_duplicates


def test_isolated_pairs_of_a_large_label_with_a_common_mean(spark):
    rng, n, dim = np.random.default_rng(2), 2000, 64
    mean = np.eye(dim)[0]
    x = rng.normal(size=(n, dim))
    x[:, 0] = 0
    x = np.sqrt(0.8) * mean + np.sqrt(0.2) * x / np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.normal(size=(n // 10, dim))
    a = x[: n // 10]
    off -= (off * a).sum(1, keepdims=True) * a
    x[n // 10 : n // 5] = 0.982 * a + np.sqrt(1 - 0.982**2) * off / np.linalg.norm(off, axis=1, keepdims=True)
    linked = x @ x.T >= 0.98
    want = dict(enumerate((linked.sum(1) - 1).tolist()))
    frame = spark.createDataFrame([(i, v.tolist(), 7) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: r.n_links for r in near_duplicates(frame, passes=3, window=5, chunk=500).collect()}
    queries = range(0, n, 20)  # all rows against a fixed set of queries
    assert sum(want[q] for q in queries) > 10
    assert sum(found[q] for q in queries) >= 0.9 * sum(want[q] for q in queries)
    assert sum(found.values()) >= 0.9 * sum(want.values()) and all(found[i] <= want[i] for i in want)
