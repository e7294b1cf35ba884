"""File sources, keyed writes, streaming merge and rate limit on small inputs."""

from __future__ import annotations

import json

import pytest

from wayfold.functions.fuzzy import repaired
from wayfold.sources import files
from wayfold.streaming import snapshots


def test_csv_in_two_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿상호명,경도\n후암동 카페,126.9\n".encode())
    (tmp_path / "b.csv").write_bytes("상호명,경도\n후암동 카페,126.9\n".encode("cp949"))
    for name, encoding in (("a", "UTF-8"), ("b", "cp949")):
        assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / f"{name}.csv"), "name string, lng double", encoding).collect()] == [("후암동 카페", 126.9)]


def test_a_folder_of_mixed_encodings_and_an_unreadable_file(spark, tmp_path):
    schema = "name string, lng double"
    (tmp_path / "a.csv").write_bytes("\ufeff상호명,경도\n후암동 é,1.0\n".encode())
    (tmp_path / "b.csv").write_bytes("상호명,경도\n후암동 카페,2.0\n".encode("cp949"))
    (tmp_path / "c.csv").write_bytes(b"name,lng\nplain,3.0\n")
    (tmp_path / "d.csv").write_bytes(b"")
    found = files.read_csv_detected(spark, str(tmp_path), schema)
    assert sorted(map(tuple, found.collect())) == [("plain", 3.0), ("후암동 é", 1.0), ("후암동 카페", 2.0)]
    (tmp_path / "bad.csv").write_bytes(b"name,lng\n\xff\xfe\x80,4.0\n")
    with pytest.raises(ValueError, match="bad.csv"):
        files.read_csv_detected(spark, str(tmp_path), schema)


def test_pages_are_complete_or_an_error(spark, tmp_path):
    def landed(name, pages):
        (tmp_path / name).mkdir()
        for k, (page, total, items) in enumerate(pages):
            (tmp_path / name / f"{k}.json").write_text(json.dumps({"page": page, "total": total, "items": items}, indent=1))
        return files.complete_pages(spark, str(tmp_path / name), "id string")

    two = [{"id": "a"}, {"id": "b"}]
    good = landed("good", [(1, 3, two), (2, 3, {"id": "c"}), (1, 3, two)])
    assert sorted(map(tuple, good.collect())) == [(1, "a"), (1, "b"), (2, "c")]
    assert landed("none", [(1, 0, "")]).collect() == []
    for name, pages in {"short": [(1, 4, two), (2, 4, {"id": "c"})], "gap": [(1, 3, two), (3, 3, {"id": "c"})], "drift": [(1, 3, two), (2, 4, {"id": "c"})]}.items():
        with pytest.raises(Exception, match="incomplete pages"):
            landed(name, pages).collect()


def test_json_arrays_and_lines(spark, tmp_path):
    rows = [{"id": "a", "n": 1}, {"id": "b", "n": 2}]
    (tmp_path / "plain.json").write_text(json.dumps(rows))
    (tmp_path / "wrapped.json").write_text(json.dumps({"pois": rows}))
    for name, wrapper in (("plain", None), ("wrapped", "pois")):
        found = files.read_json_array(spark, str(tmp_path / f"{name}.json"), "id string, n int", wrapper)
        assert sorted(map(tuple, found.collect())) == [("a", 1), ("b", 2)]
    (tmp_path / "x.jsonl").write_text('{"id": "a", "n": 1}\n\nnot json\n{"id": "a", "n": 3}\n{"id": "b", "n": 2}\n')
    assert sorted(map(tuple, files.read_json_lines(spark, str(tmp_path / "x.jsonl"), "id string, n int", "id").collect())) == [("a", 3), ("b", 2)]


def test_landed_pages_take_one_object_or_a_list(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"page": 1, "total": 3, "items": [{"id": "a"}, {"id": "b"}]}))
    (tmp_path / "2.json").write_text(json.dumps({"page": 2, "total": 3, "items": {"id": "c"}}))
    assert sorted(map(tuple, files.landed_pages(spark, str(tmp_path), "id string").collect())) == [(1, "a"), (1, "b"), (2, "c")]


def test_keyed_writes_replace_only_their_partitions(spark, tmp_path):
    rows = spark.createDataFrame([("x", 1), ("y", 2)], "k string, n int")
    path = str(tmp_path / "t")
    files.write_keyed(rows, path, ["k"])
    files.write_keyed(spark.createDataFrame([("y", 5)], "k string, n int"), path, ["k"])
    assert sorted((r.k, r.n) for r in spark.read.parquet(path).collect()) == [("x", 1), ("y", 5)]


def test_merge_batches_is_idempotent(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame([("a", 1, 10), ("b", 1, 20), ("a", 2, 11)], "k string, at int, v int").coalesce(1).write.parquet(src)
    spark.createDataFrame([("b", 3, 30)], "k string, at int, v int").coalesce(1).write.mode("append").parquet(src)
    rows = snapshots.stream(spark, src, spark.read.parquet(src).schema)
    snapshots.merge_batches(rows, out, ["k"], ["at"], str(tmp_path / "cp")).start().awaitTermination()
    last = max(int(p.name[2:]) for p in (tmp_path / "out").iterdir() if p.name.startswith("v="))
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"{out}/v={last}").collect()) == [("a", 11), ("b", 30)]


def test_quote_repair(spark):
    df = spark.createDataFrame([("the quick brown fix", ["nothing like it", "the quick brown fox"])], "q string, c array<string>")
    assert df.select(repaired(df.q, df.c)).first()[0] == "the quick brown fox"
