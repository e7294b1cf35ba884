"""Nearest places by cells against all distances: random points of the whole sphere, crowds, poles, the 180th meridian."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.compare import connect, differences
from wayfold.operators.nearest import nearest, nearest_of_few
from wayfold.plans import all_oracles, all_queries


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    s = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(min(s, 1)))


def frames(spark, points, places):
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(points)], "id int, u_lat double, u_lng double")
    return p, spark.createDataFrame([(i, *x) for i, x in enumerate(places)], "place int, lat double, lng double").repartition(3)


def check(found, points, places, k):
    got: dict = {}
    for r in found.collect():
        got.setdefault(r.id, []).append((r.rank, r.place, r.dist))
    for i, x in enumerate(points):
        if None in x:
            assert i not in got
            continue
        order = sorted((round(metres(x, y), 6), j) for j, y in enumerate(places) if None not in y)[:k]
        mine = sorted(got.get(i, []))
        assert [r for r, _, _ in mine] == list(range(1, len(order) + 1))
        assert [round(d, 3) for _, _, d in mine] == pytest.approx([d for d, _ in order], abs=2e-3)
        assert len({p for _, p, _ in mine}) == len(mine)


@pytest.mark.parametrize("search", [nearest, nearest_of_few])
def test_equals_all_distances(spark, search):
    rng = random.Random(4)
    sphere = lambda: (math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180))
    crowd = [(37.5 + rng.gauss(0, 1e-3), 127 + rng.gauss(0, 1e-3)) for _ in range(300)]
    places = [sphere() for _ in range(400)] + crowd + [(37.5, 127.0)] * 40 + [(89.9, 10.0), (89.9, -170.0), (-90.0, 0.0), (90.0, 5.0), (10.0, 179.999), (10.0, -179.999), (None, 3.0), (0.0, 180.0), (0.0, -180.0)]
    points = [sphere() for _ in range(60)] + crowd[:20] + [(37.5, 127.0), (90.0, 0.0), (-90.0, 50.0), (89.99, -90.0), (10.0, 180.0), (10.0, -180.0), (0.0, 0.0), (None, None), (-0.0, 179.9)]
    check(search(*frames(spark, points, places), "id", 5, "place"), points, places, 5)


def test_fewer_places_than_asked_for_and_none(spark):
    points, places = [(0.0, 0.0), (50.0, 100.0)], [(10.0, 10.0), (-80.0, -170.0)]
    check(nearest(*frames(spark, points, places), "id", 5, "place"), points, places, 5)
    assert nearest(*frames(spark, points, []), "id", 5, "place").count() == 0


def test_many_points_without_comparing_all_pairs(spark):
    """8,000 points among 20,000 places, half of them in one small crowd: few pairs are measured, and no join is a product."""
    n = 20_000
    places = spark.range(n).select(F.col("id").alias("place"), F.when(F.col("id") % 2 == 0, 37 + F.rand(1) / 100).otherwise(30 + 15 * F.rand(2)).alias("lat"), F.when(F.col("id") % 2 == 0, 127 + F.rand(3) / 100).otherwise(120 + 15 * F.rand(4)).alias("lng"))
    points = places.where("place % 5 < 2").select(F.col("place").alias("id"), F.col("lat").alias("u_lat"), F.col("lng").alias("u_lng"))
    found = nearest(points, places, "id", 3, "place")
    assert found.count() == 3 * n * 2 // 5
    assert found.where("rank = 1 and place <> id").count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_crowded_spots_are_searched_once_and_nothing_large_is_broadcast(spark):
    """3,000 points at 15 spots: exact, ties by place, and only the list of levels goes through the driver."""
    spots = [(37.5 + i / 1e3, 127 - i * i / 1e3) for i in range(15)]
    places = [spots[i % 15] for i in range(300)] + [(37.50001, 127.00001), (-37.5, -53.0)]
    points = [spots[i % 15] for i in range(3000)] + [(None, 1.0)]
    p, q = frames(spark, points, places)
    found = nearest(p, q, "id", 3, "place")
    got = {}
    for r in found.collect():
        got.setdefault(r.id, {})[r.rank] = r.place
    assert got == {i: {n + 1: i % 15 + 15 * n for n in range(3)} for i in range(3000)}
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("BroadcastHashJoin") <= 1
    assert "isFinalPlan=true" in plan


@pytest.mark.parametrize("name", ["geo14_near_duplicates", "geo04_nearest_places"])
def test_queries_on_crowded_spots(spark, sf_dir, tmp_path, name):
    """Keys 20,000 apart lie at one spot. The rows are the SQL's, and no place table is broadcast."""
    places = spark.range(900).selectExpr("id % 300 + 20000 * floor(id / 300) AS c_custkey", "concat('c', id) AS c_name", "CAST(id % 25 AS INT) AS c_nationkey", "CAST(id AS DOUBLE) AS c_acctbal", "'BUILDING' AS c_mktsegment")
    places.distinct().write.parquet(f"{tmp_path}/customer.parquet")
    con = connect(sf_dir)
    con.execute(f"CREATE OR REPLACE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    found = all_queries()[name](spark, str(tmp_path))
    assert differences(found, con, all_oracles()[name]) == ""
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("BroadcastHashJoin") <= 1
