"""Quote search, explanation cascade and strata on small inputs with edge cases."""

from __future__ import annotations

import random

import pytest

from wayfold.operators.curation import containing, stratified
from wayfold.operators.explanations import cascade
from wayfold.operators.merges import appended


def test_quote_search_equals_contains(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["ab", "b", "abc", "", "c\n", "é", "%", "a.b"])
    texts = [(i, " ".join(word() for _ in range(rng.randrange(0, 40)))) for i in range(300)] + [(900, None), (901, "")]
    quotes = []
    for i in range(200):
        source = rng.choice(texts[:300])[1]
        a = rng.randrange(len(source) + 1)
        quotes.append((i, source[a : a + rng.randrange(0, 40)]))
    quotes += [(500, None), (501, "not there at all in any text")]
    found = containing(spark.createDataFrame(texts, "d int, text string"), spark.createDataFrame(quotes, "q int, quote string"), "d", "q")
    want = {(d, q) for d, t in texts for q, s in quotes if t is not None and s is not None and s in t}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    long = containing(spark.createDataFrame(texts, "d int, text string"), spark.createDataFrame(quotes[-1:], "q int, quote string"), "d", "q")
    assert "NestedLoop" not in long._jdf.queryExecution().executedPlan().toString()


def test_cascade_takes_cache_then_model_then_template(spark):
    allowed = spark.createDataFrame([(k, p) for k in (1, 2, 3, 4) for p in ("a", "b")], "k int, poi_id string")
    cached = [(1, "a", "first", 1), (1, "a", "second", 2), (2, "z", "not allowed", 1), (2, "a", " ", 1), (9, "a", "no such key", 1)]
    model = [(1, "b", "unused", 1), (2, "b", "said", 1), (3, "a", None, 1)]
    kind = "k int, poi_id string, reason string, at int"
    found = cascade(allowed, spark.createDataFrame(cached, kind), spark.createDataFrame(model, kind), "k", "near")
    assert sorted(map(tuple, found.collect())) == [(1, "a", "first", "cache"), (1, "b", "near", "cache"), (2, "a", "near", "llm"), (2, "b", "said", "llm"), *[(k, p, "near", "template") for k in (3, 4) for p in ("a", "b")]]


def test_small_stratum_is_an_error(spark):
    rows = spark.createDataFrame([("x", f"x{i}") for i in range(30)] + [("y", f"y{i}") for i in range(20)], "zone string, id string")
    found = stratified(rows, "zone", "id", 20, "s")
    assert sorted(r["count"] for r in found.groupBy("zone").count().collect()) == [20, 20]
    assert found.exceptAll(stratified(rows.repartition(5), "zone", "id", 20, "s")).count() == 0
    with pytest.raises(Exception, match="fewer than 21 rows in stratum y"):
        stratified(rows, "zone", "id", 21, "s").collect()


def test_appended_keeps_first_appearance(spark):
    old = spark.createDataFrame([(1, ["z", "b"], 7), (2, None, None), (3, ["q"], 5)], "k int, v array<string>, s int")
    new = spark.createDataFrame([(1, "y", 1, 2), (1, "b", None, 1), (1, "a", None, 3), (2, "c", 4, 9), (2, "a", None, 10), (2, None, 6, 8)], "k int, v string, s int, at int")
    found = {r.k: (r.v, r.s) for r in appended(old, new, "k", "v", "at", ["s"]).collect()}
    assert found == {1: (["z", "b", "y", "a"], 1), 2: (["c", "a"], 4), 3: (["q"], 5)}
