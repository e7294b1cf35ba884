"""Polygons as rings of points (array<struct<x, y>>, first = last): containment, distance, area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RING = "array<struct<x double, y double>>"


def edges(ring: Column) -> Column:
    """Pairs (a, b) of neighbouring points."""
    return F.transform(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, i + 1).alias("b")))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd ray casting; a point on a left or lower edge is inside, on a right or upper edge outside."""
    crossing = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * F.try_divide(y - e["a"]["y"], e["b"]["y"] - e["a"]["y"]) + e["a"]["x"])
    return F.size(F.filter(edges(ring), crossing)) % 2 == 1


def distance(ring: Column, x: Column, y: Column) -> Column:
    """Distance to the nearest edge, 0 inside."""

    def to_edge(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        t = F.coalesce(F.try_divide((x - e["a"]["x"]) * dx + (y - e["a"]["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        return F.hypot(e["a"]["x"] + t * dx - x, e["a"]["y"] + t * dy - y)

    return F.when(contains(ring, x, y), 0.0).otherwise(F.array_min(F.transform(edges(ring), to_edge)))


def area(ring: Column) -> Column:
    """Shoelace area."""
    return F.abs(F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def bounds(ring: Column) -> dict[str, Column]:
    x, y = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {"x0": F.array_min(x), "x1": F.array_max(x), "y0": F.array_min(y), "y1": F.array_max(y)}


def assign(points: DataFrame, shapes: DataFrame, tolerance: float, cell: float) -> DataFrame:
    """points (id, x, y) with the shape (code, ring) that contains each: of several the smallest, then the first code; of
    none the nearest within tolerance. method: polygon, nearest or unmapped.

    Shapes are cut into grid cells by their bounding box (grown by tolerance) and meet points by cell."""
    s = shapes.withColumns(bounds(F.col("ring"))).withColumn("size", area(F.col("ring")))
    span = lambda a, b: F.sequence(F.floor((F.col(a) - tolerance) / cell), F.floor((F.col(b) + tolerance) / cell))
    s = s.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1"))).select("code", "ring", "size", "cx", "cy")
    pairs = points.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell)).join(s, ["cx", "cy"])
    pairs = pairs.withColumn("d", distance(F.col("ring"), F.col("x"), F.col("y"))).where(F.col("d") <= tolerance)
    best = pairs.groupBy("id").agg(F.min_by(F.struct("code", "d"), F.struct((F.col("d") > 0).alias("outside"), F.when(F.col("d") > 0, F.col("d")).otherwise(F.col("size")).alias("by"), "code")).alias("best"))
    out = points.join(best, "id", "left")
    method = F.when(F.col("best").isNull(), "unmapped").when(F.col("best.d") > 0, "nearest").otherwise("polygon")
    return out.select(*points.columns, F.col("best.code").alias("code"), method.alias("method"))
