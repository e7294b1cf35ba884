"""What a stage leaves in reused worker processes is given back by the next."""

from __future__ import annotations

import time

import pyarrow as pa

from wayfold.llm import common, words
from wayfold.llm.packing import cut
from wayfold.llm.quality_fm import labelled

PARTS = 40


def in_workers(spark, what):
    """what() of many short tasks, so that each idle worker has some."""

    def run(batches):
        time.sleep(0.05)
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(what())])], names=["n"])

    return [r.n for r in spark.range(0, PARTS, 1, PARTS).mapInArrow(run, "n long").collect()]


def _leave():
    common.held("left over", lambda: [0] * 1000)
    return len(words.powers(1 << 17)[0])


def _left():
    return "left over" in common._held or len(words._pow[0]) > 1 << 16


def test_learning_and_cutting_give_memory_back(spark):
    docs = spark.range(0, 400, 1, PARTS).selectExpr("id AS doc_id", "concat('some words ', id) AS text").cache()
    labels = spark.range(400).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    pieces = spark.range(0, PARTS, 1, PARTS).selectExpr("id AS doc_id", "id * 3 AS start", "3L AS n_tokens", "array(1, 2, 3) AS tokens")
    for stage in (lambda: labelled(docs, labels, 6000), lambda: cut(pieces, 2048)):
        in_workers(spark, _leave)
        assert stage().count() > 0
        assert not any(in_workers(spark, _left))
