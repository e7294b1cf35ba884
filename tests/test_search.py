"""Candidate search gives the same rows whether its requests count as few or as many."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.operators import search
from wayfold.sources import views as V


def _rows(spark, sf_dir):
    found = search.candidates(V.requests(spark), V.poi(spark, sf_dir))
    return sorted(map(tuple, found.select("request_id", "poi_id", "stage", F.round("dist", 6), "radius", "n").collect()))


def test_few_and_many_requests_find_the_same(spark, sf_dir, monkeypatch):
    few = _rows(spark, sf_dir)
    monkeypatch.setattr(search, "SMALL", 0)
    monkeypatch.setattr(search, "FEW", 0)
    assert few and _rows(spark, sf_dir) == few


def test_a_request_has_chosen_or_fallback_rows(spark, sf_dir):
    """The far request has no place within the widest radius: its rows are the nearest few, all of the last stage."""
    rows = _rows(spark, sf_dir)
    stages = {}
    for request, _, stage, *_ in rows:
        stages.setdefault(request, set()).add(stage)
    assert all(len(s) == 1 for s in stages.values()) and stages[20] == {4}


def test_few_points_leave_the_places_where_they_are(spark, sf_dir, monkeypatch):
    plan = lambda: search.within(V.requests(spark), V.poi(spark, sf_dir), 1000.0)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan() and "SortMergeJoin" not in plan()
    monkeypatch.setattr(search, "SMALL", 0)
    assert "SortMergeJoin" in plan()


def test_requests_are_typed_rows(spark):
    rows = V.requests(spark)
    assert [tuple(r) for r in rows.orderBy("request_id").collect()] == V.request_rows()
    assert dict(rows.dtypes)["u_lat"] == "double" and dict(rows.dtypes)["rain"] == "double" and dict(rows.dtypes)["pm"] == "int"
