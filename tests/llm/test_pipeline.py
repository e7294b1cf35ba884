"""Each stage of the pipeline against what it should do to its own input, and run() as their composition."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from tests.llm.fixtures import brute_components
from tests.llm.test_mixing import plain_targets
from tests.llm.test_secrets import plain
from tests.llm.fixtures import WORD


def test_stages(spark, sf_dir, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "secrets", "mixture", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = (before.collect(), docs.collect())
        if name != "packing":
            assert docs.columns == columns
    was, now = kept["quality"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = [r.doc_id for r in was if labels.get(r.doc_id) == 1]
    assert len({r.doc_id for r in now} & set(good)) >= 0.95 * len(good)
    was, now = kept["near_copies"]
    roots = {c for _, _, c in brute_components([(r.doc_id, r.text) for r in was])}
    assert Counter(r.doc_id for r in now) == Counter(roots)
    was, now = kept["secrets"]
    assert [r.doc_id for r in sorted(was)] == [r.doc_id for r in sorted(now)] and not any(plain(r.text) for r in now)
    was, now = kept["mixture"]
    sizes, got = Counter(), Counter()
    for r in was:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    for r in now:
        got[r.source] += len(WORD.findall(r.text or ""))
    longest = max(len(WORD.findall(r.text or "")) for r in was)
    assert all(abs(got[s] - t) <= longest for s, t in plain_targets(sizes).items())
    was, now = kept["packing"]
    assert {r.doc_id for r in now} == {r.doc_id for r in was}
    again = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.start, r.doc_tokens) for r in again if r.start == 0) == Counter((r.doc_id, r.start, r.doc_tokens) for r in now if r.start == 0)


def test_clashing_names_and_edges(spark, docs, empty, sf_dir, tmp_path):
    labels = spark.createDataFrame([(20, 1, 0), (21, 1, 0), (400, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (docs.withColumn("_quality_score", docs.score), empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, str(tmp_path))
            assert out.columns == rows.columns
            rows = out
        corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).count()


def test_near_copies_keep_unlinked_texts_of_one_doc_id(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "x"), (1, text.upper(), "x"), (1, "another text of the same id", "x"), (2, text, "y"), (3, "", "z"), (3, "", "z"), (3, " ", "z"), (None, text, "n"), (None, None, "n"), (4, "alone here", "p")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, class string")
    kept = corpus_pipeline.near_copies(spark, frame, "")
    assert kept.columns == frame.columns
    want = [(1, text.upper(), "x"), (1, "another text of the same id", "x"), (3, "", "z"), (3, " ", "z"), (None, text, "n"), (None, None, "n"), (4, "alone here", "p")]
    assert Counter(map(tuple, kept.collect())) == Counter(want)
