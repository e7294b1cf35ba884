"""Jaccard join, recompression and embedding near-dedup against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.fixtures import brute_components, brute_removal
from wayfold.llm import jaccard_join
from wayfold.llm.embed_dedup import near_duplicates
from wayfold.llm.jaccard_join import jaccard_components
from wayfold.llm.recompress import remove_repeats


@pytest.mark.parametrize("which", ["fixture", "table"])
def test_jaccard_components_equal_brute_force(docs, table, which):
    frame = docs if which == "fixture" else table("documents")
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    found = Counter(map(tuple, jaccard_components(frame).select("doc_id", "n_shingles", "component_id").collect()))
    assert found == Counter(brute_components(rows))


@pytest.mark.parametrize("bounds", [{"BLOCK": 500, "BUCKET": 300, "TILE": 400}, {"BLOCK": 20_000, "BUCKET": 50_000, "TILE": 2_000}])
def test_jaccard_components_in_small_blocks_and_tiles(docs, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(jaccard_join, name, value)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = Counter(map(tuple, jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect()))
    assert found == Counter(brute_components(rows))


def near_groups(spark, seed: int, groups: int, members: int, words: int):
    """Copies with edits that put many pairs on either side of the threshold, and lists that several groups share."""
    rng = np.random.default_rng(seed)
    rows, common = [], [f"c{i}" for i in range(60)]
    for g in range(groups):
        base = common[: int(rng.integers(0, 60))] + [f"g{g}w{i}" for i in range(words)]
        for m in range(members):
            copy = list(base)
            for _ in range(int(rng.integers(0, max(2, len(base) // 22)))):
                copy[int(rng.integers(len(copy)))] = f"e{rng.integers(40)}"
            rows.append((g * members + m, " ".join(copy)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("shape", [(3, 6, 60, 90), (4, 25, 12, 40), (5, 2, 150, 60)])
def test_jaccard_components_of_near_groups(spark, monkeypatch, shape):
    monkeypatch.setattr(jaccard_join, "TILE", 3_000)
    frame = near_groups(spark, *shape)
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    found = Counter(map(tuple, jaccard_components(frame).select("doc_id", "n_shingles", "component_id").collect()))
    assert found == Counter(brute_components(rows))


def test_divide_skip_counts_short_lists_and_probes_long_ones():
    rng = np.random.default_rng(1)
    everyone = lambda ids: np.ones(len(ids), bool)
    probed = dropped = 0
    for _ in range(200):
        k = int(rng.integers(2, 40))
        lists = [np.unique(rng.integers(0, 60, int(rng.integers(1, 60 if rng.random() < 0.4 else 6)))) for _ in range(k)]
        need = int(rng.integers(1, k + 1))
        ids, said = jaccard_join.divide_skip(lists, need, everyone, lambda x, need=need: np.full(len(x), need))
        count = Counter(np.concatenate(lists).tolist())
        assert ids.tolist() == sorted(i for i, n in count.items() if n >= need)
        # what was merged is only the short lists, and a candidate has need - long of them
        short = sorted(lists, key=len)[: k - said["long"]]
        assert said["merged"] == sum(map(len, short)) and said["long"] < need
        of_short = Counter(i for x in short for i in x.tolist())
        assert said["counted"] == sum(n >= need - said["long"] for n in of_short.values())
        probed += said["probed"]
        dropped += len(of_short) - said["counted"]
    assert probed > 200 and dropped > 200


@pytest.mark.parametrize("which", ["fixture", "table"])
def test_repeats_equal_brute_force(docs, table, which):
    frame = docs if which == "fixture" else table("documents")
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    want = Counter((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute_removal(rows))
    assert Counter(map(tuple, remove_repeats(frame).collect())) == want


def test_repeats_of_runs_and_periods(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        kind = i % 4
        if kind == 0:
            words = ["a"] * int(rng.integers(40, 130))
        elif kind == 1:
            words = (["a", "b"] * 80)[int(rng.integers(0, 3)) : int(rng.integers(40, 150))]
        elif kind == 2:
            words = list(map(str, rng.integers(0, 5, 30))) + ["a"] * int(rng.integers(1, 60)) + ["z"] * int(rng.integers(1, 60))
        else:
            words = (["x", "y", "y", "z"] * 40)[int(rng.integers(0, 4)) :] + list(map(str, rng.integers(0, 3, 10)))
        rows.append((i, " ".join(words)))
    want = Counter((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute_removal(rows))
    assert Counter(map(tuple, remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == want


def brute_links(rows, threshold=0.98):
    ok = []
    for i, (d, v, lab) in enumerate(rows):
        if d is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.append(i)
    n_links, root = [0] * len(rows), {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p, i in enumerate(ok):
        a = np.array(rows[i][1], float)
        a = a / np.abs(a).max()
        for j in ok[p + 1 :]:
            if rows[i][2] != rows[j][2] or len(rows[i][1]) != len(rows[j][1]):
                continue
            b = np.array(rows[j][1], float)
            b = b / np.abs(b).max()
            if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                n_links[i] += 1
                n_links[j] += 1
                x, y = sorted((find(rows[i][0]), find(rows[j][0])))
                root[y] = x
    return [(d, n_links[i], None if d is None else find(d), d is None or find(d) == d) for i, (d, _, _) in enumerate(rows)]


def test_embeddings_equal_brute_force_on_the_table(table):
    rows = [(r.vec_id, list(r.embedding) if r.embedding is not None else None, r.label) for r in table("embeddings").select("vec_id", "embedding", "label").collect()]
    found = Counter(map(tuple, near_duplicates(table("embeddings")).collect()))
    want = Counter(brute_links(rows))
    assert sum((found & want).values()) >= 0.9 * sum(want.values())
    assert sum(r[1] * n for r, n in found.items()) >= 0.9 * sum(r[1] * n for r, n in want.items())


def test_embedding_edge_cases(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    rows = [(i, v, 1) for i in range(200)] + [(300 + i, [x * (1 + i) for x in w], 1) for i in range(20)]
    rows += [(400, None, 1), (401, [0.0, 0.0, 0.0], 1), (402, [1.0, None, 2.0], 1), (403, [float("nan"), 1.0, 1.0], 1), (404, [float("inf"), 1.0, 1.0], 1), (405, v, None), (406, [], 1), (407, [1.0, 2.0], 1), (408, v, 2), (None, v, 1), (409, [1e-30, 2e-30, 3e-30], 1), (410, [1e30, 2e30, 3e30], 1)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, label int, pass string, node string")
    assert Counter(map(tuple, near_duplicates(frame).collect())) == Counter(brute_links(rows))
    assert near_duplicates(frame.where("false")).count() == 0
    named = frame.where("vec_id is not null").selectExpr("vec_id", "embedding", "if(label is null, null, concat('label ', label)) label")
    assert Counter(map(tuple, near_duplicates(named).collect())) == Counter(r for r in brute_links(rows) if r[0] is not None)


def test_one_vec_id_for_several_vectors(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    frame = spark.createDataFrame([(1, v, 1), (2, v, 1), (3, w, 1), (2, w, 1), (4, [1.0, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert Counter(map(tuple, near_duplicates(frame).collect())) == Counter([(1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)])


def test_empty_tables(empty):
    assert jaccard_components(empty).count() == 0
    assert remove_repeats(empty).count() == 0


def test_a_doc_id_of_several_texts_is_one_node(spark):
    from wayfold.llm.jaccard_join import jaccard_components

    words = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [(2, words("a")), (2, words("b")), (1, words("a")), (3, words("b")), (3, words("c")), (9, words("c")), (None, words("c")), (4, words("d")), (5, None), (5, words("e")), (6, words("e"))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(frame).collect())
    assert found == Counter(brute_components(rows))
    assert {r.doc_id: r.component_id for r in jaccard_components(frame).collect() if r.doc_id} == {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 5, 6: 5}
