"""Areas with holes and several parts against plain versions: containment, cell covers, overlay with a union."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import overlay

SCHEMA = f"code string, parts {overlay.AREA}"


def star(rng, cx, cy, n, low, high):
    """A concave ring around a centre."""
    return [(cx + r * math.cos(2 * math.pi * k / n), cy + r * math.sin(2 * math.pi * k / n)) for k in range(n) for r in [rng.uniform(low, high)]]


def closed(ring):
    return [(float(x), float(y)) for x, y in [*ring, ring[0]]]


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def inside(parts, x, y):
    n = 0
    for ring in (r for p in parts for r in p):
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            n += (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
    return n % 2 == 1


def areas(seed):
    rng = random.Random(seed)
    out = {}
    for k in range(6):
        cx, cy = rng.uniform(0, 10), rng.uniform(0, 10)
        out[f"s{k}"] = [[star(rng, cx, cy, 11, 1.2, 3.0), star(rng, cx, cy, 5, 0.3, 1.0)], [star(rng, cx + 7, cy, 7, 0.5, 2.0)]]
    return out


def frame(spark, shapes):
    return spark.createDataFrame([(c, None if p is None else [[closed(r) for r in x] for x in p]) for c, p in shapes.items()], SCHEMA)


@pytest.mark.parametrize("cell", [0.25, 0.7, 30.0])
def test_containment(spark, cell):
    shapes, rng = areas(1), random.Random(2)
    points = [(i, rng.uniform(-4, 20), rng.uniform(-4, 14)) for i in range(1500)]
    cells = overlay.cover(frame(spark, {**shapes, "none": None, "void": []}), cell)
    frame_ = spark.createDataFrame([*points, (-1, None, 1.0)], "id int, x double, y double")
    want = {(i, c) for i, x, y in points for c, p in shapes.items() if inside(p, x, y)}
    found = overlay.located(frame_, cells, cell)
    assert {(r.id, r.code) for r in found.collect()} == want
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    if cell < 0.5:  # most points of an area need no test
        assert cells.where("sides is null").count() > 0.4 * cells.count()


def test_sizes_and_borders(spark):
    shapes = {"a": [[box(0, 0, 4, 4), box(1, 1, 2, 2)], [box(6, 0, 7, 1)]], "b": [[box(0, 0, 1, 1)]]}
    cells = overlay.cover(frame(spark, shapes), 1.0)
    assert {r.code: r.size for r in cells.select("code", "size").distinct().collect()} == {"a": 16.0, "b": 1.0}
    points = [(0, 0.0, 0.0), (1, 4.0, 1.0), (2, 1.0, 1.0), (3, 2.0, 1.5), (4, 6.0, 0.5), (5, 0.5, 0.5)]
    found = overlay.located(spark.createDataFrame(points, "id int, x double, y double"), cells, 1.0)
    assert {(r.id, r.code) for r in found.collect()} == {(0, "a"), (0, "b"), (3, "a"), (4, "a"), (5, "a"), (5, "b")}
    assert {(r.id, r.code) for r in overlay.smallest(spark.createDataFrame(points, "id int, x double, y double"), cells, 1.0).collect()} == {(0, "b"), (3, "a"), (4, "a"), (5, "b")}


def test_overlay_of_concave_areas_with_a_union(spark):
    shapes, others = areas(3), {f"o{k}": p for k, p in enumerate(areas(4).values())}
    others["over"] = [[box(2, 2, 9, 6)]]  # overlaps several: the union counts it once
    got = {r.code: r for r in overlay.overlaid(frame(spark, shapes), frame(spark, others), 1.0).collect()}
    n = 160
    for code, parts in shapes.items():
        whole = hit = 0
        xs = [x for p in parts for x, _ in p[0]]
        ys = [y for p in parts for _, y in p[0]]
        for i in range(n):
            for j in range(n):
                x, y = min(xs) + (i + 0.5) * (max(xs) - min(xs)) / n, min(ys) + (j + 0.5) * (max(ys) - min(ys)) / n
                if inside(parts, x, y):
                    whole += 1
                    hit += any(inside(o, x, y) for o in others.values())
        r = got[code]
        assert r.share == pytest.approx(hit / whole, abs=0.02)
        if r.share > 0:
            assert inside(parts, r.x, r.y) and any(inside(o, r.x, r.y) for o in others.values())


def test_exact_shares_touching_and_missing_areas(spark):
    shapes = {"half": [[box(0, 0, 2, 2)]], "touch": [[box(5, 0, 6, 1)]], "all": [[box(1.2, 0.2, 1.8, 0.8)]], "hole": [[box(0, 0, 3, 3), box(0.5, 0.5, 2.5, 2.5)]], "far": [[box(50, 50, 51, 51)]], "void": []}
    others = {"x": [[box(1, 0, 5, 2)]], "y": [[box(1, 0, 3, 3)]], "tilt": [[[(20, 20), (22, 22), (20, 24)]]]}
    got = {r.code: r for r in overlay.overlaid(frame(spark, shapes), frame(spark, others), 1.0).collect()}
    assert {c: round(r.share, 9) for c, r in got.items()} == {"half": 0.5, "touch": 0.0, "all": 1.0, "hole": round((2 * 3 - 1.5 * 2) / 5, 9), "far": 0.0, "void": 0.0}
    assert got["touch"].x is None and got["far"].x is None and got["half"].x == 1.5
    same = overlay.overlaid(frame(spark, {"t": others["tilt"]}), frame(spark, {"u": [[box(20, 20, 21, 24)]]}), 1.0).first()
    assert same.share == pytest.approx(0.75)
    assert overlay.overlaid(frame(spark, shapes).where(F.lit(False)), frame(spark, others), 1.0).count() == 0
