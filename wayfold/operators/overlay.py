"""Areas of several parts with holes: containment by a cover of grid cells, and overlay of an area with a union of others.

An area is an array of parts, a part an array of rings (the first its outline, the others holes), a ring an array of points (first = last).

Containment: an area's bounding box is cut into cells once. A cell that no edge meets lies wholly inside or outside: points in
an inner cell are in the area without any test, outer cells are dropped, and only points in cells that an edge meets
are tested by ray casting over the area's edges. Points and areas meet by an equi-join on cells.

Overlay: the y of all corners and crossings cut the plane into slabs, inside which edges do not cross; in a slab the edges in order
of x alternate between in and out of each area, so that the stretches inside the first area and any of the others are
trapezoids, whose middle width times the slab's height is their area, exactly. The point of an overlay is the middle
of the widest stretch in the middle of the slab that holds its middle height: always inside.

An area without parts, or null, contains nothing and overlaps nothing; points without coordinates are in no area.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AREA = "array<array<array<struct<x double, y double>>>>"


def ring_edges(ring: Column) -> Column:
    """Structs x1, y1, x2, y2 of a ring; an unfinished ring is closed by its first point."""
    ends = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, ends, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def edges(parts: Column) -> Column:
    return F.flatten(F.transform(F.flatten(parts), ring_edges))


def contains(sides: Column, x: Column, y: Column) -> Column:
    """Even-odd ray casting over edges; left and lower edges are inside, right and upper ones outside."""
    crossed = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * F.try_divide(y - e["y1"], e["y2"] - e["y1"]) + e["x1"])
    return F.size(F.filter(sides, crossed)) % 2 == 1


def size(parts: Column) -> Column:
    """Outlines less holes, summed from a ring's first point, so that far from the origin no digits are lost."""

    def ring(r: Column) -> Column:
        at = F.get(r, F.lit(0))
        return F.abs(F.aggregate(ring_edges(r), F.lit(0.0), lambda s, e: s + (e["x1"] - at["x"]) * (e["y2"] - at["y"]) - (e["x2"] - at["x"]) * (e["y1"] - at["y"]))) / 2

    holes = lambda p: F.aggregate(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.lit(0.0), lambda s, r: s + ring(r))
    return F.aggregate(parts, F.lit(0.0), lambda s, p: s + F.when(F.size(p) > 0, ring(F.get(p, F.lit(0))) - holes(p)).otherwise(0.0))


def cover(shapes: DataFrame, cell: float) -> DataFrame:
    """shapes (code, parts) as cells: code, cx, cy, size, and sides, the area's edges, null for an inner cell."""
    rows = shapes.select("code", edges(F.col("parts")).alias("sides"), size(F.col("parts")).alias("size")).where(F.size("sides") > 0)
    reach = lambda axis: F.sequence(*[F.floor(f(F.transform("sides", lambda e: e[f"{axis}1"])) / cell) for f in (F.array_min, F.array_max)])
    rows = rows.select("*", F.explode(reach("x")).alias("cx")).select("*", F.explode(reach("y")).alias("cy"))
    x0, y0 = F.col("cx") * cell, F.col("cy") * cell
    x1, y1 = x0 + cell, y0 + cell
    slack = cell * 1e-9  # an edge on a cell's border meets both cells

    def meets(e: Column) -> Column:
        box = (F.least(e["x1"], e["x2"]) <= x1 + slack) & (F.greatest(e["x1"], e["x2"]) >= x0 - slack) & (F.least(e["y1"], e["y2"]) <= y1 + slack) & (F.greatest(e["y1"], e["y2"]) >= y0 - slack)
        side = lambda x, y: (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        corners = F.array(side(x0, y0), side(x0, y1), side(x1, y0), side(x1, y1))
        near = (F.abs(e["x2"] - e["x1"]) + F.abs(e["y2"] - e["y1"])) * slack
        return box & (F.array_min(corners) <= near) & (F.array_max(corners) >= -near)

    rows = rows.withColumn("met", F.exists("sides", meets))
    rows = rows.where(F.col("met") | contains(F.col("sides"), x0 + cell / 2, y0 + cell / 2))
    return rows.select("code", "cx", "cy", "size", F.when(F.col("met"), F.col("sides")).alias("sides"))


def located(points: DataFrame, cells: DataFrame, cell: float) -> DataFrame:
    """points (id, x, y) with every area that contains them: id, x, y, code, size."""
    placed = points.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    pairs = placed.join(cells, ["cx", "cy"])
    return pairs.where(F.col("sides").isNull() | contains(F.col("sides"), F.col("x"), F.col("y"))).select(*points.columns, "code", "size")


def smallest(points: DataFrame, cells: DataFrame, cell: float) -> DataFrame:
    """Each located point once: of several areas the smallest, then the first code."""
    found = located(points, cells, cell)
    return found.groupBy("id").agg(F.min_by("code", F.struct(F.round("size", 12), "code")).alias("code"))


def _crossings(sides: Column) -> Column:
    """The y at which two edges of different areas cross."""

    def with_edge(e: Column) -> Column:
        def at(f: Column) -> Column:
            ex, ey, fx, fy = e["x2"] - e["x1"], e["y2"] - e["y1"], f["x2"] - f["x1"], f["y2"] - f["y1"]
            cross = ex * fy - ey * fx
            t = F.try_divide((f["x1"] - e["x1"]) * fy - (f["y1"] - e["y1"]) * fx, cross)
            u = F.try_divide((f["x1"] - e["x1"]) * ey - (f["y1"] - e["y1"]) * ex, cross)
            return F.when((e["of"] < f["of"]) & t.between(0, 1) & u.between(0, 1), e["y1"] + t * ey)

        return F.array_compact(F.transform(sides, at))

    return F.flatten(F.transform(sides, with_edge))


STRETCH = "array<struct<low double, high double, x1 double, x2 double>>"


def stretches(sides: Column, slabs: Column) -> Column:
    """The stretches of each slab, in its middle, inside area 0 and inside any other: low and high y, x1 and x2. sides: structs
    of x1, y1, x2, y2, of (which area)."""

    def in_slab(slab: Column) -> Column:
        middle = (slab["low"] + slab["high"]) / 2
        passing = F.filter(sides, lambda e: (e["y1"] > middle) != (e["y2"] > middle))
        met = F.array_sort(F.transform(passing, lambda e: F.struct((e["x1"] + (e["x2"] - e["x1"]) * (middle - e["y1"]) / (e["y2"] - e["y1"])).alias("x"), e["of"].alias("of"))))
        start = F.struct(F.array().cast("array<int>").alias("within"), F.lit(None).cast("double").alias("since"), F.array().cast(STRETCH).alias("out"))

        def step(at: Column, edge: Column) -> Column:
            inside = F.array_contains(at["within"], F.lit(0)) & (F.size(at["within"]) > 1)
            piece = F.array(F.struct(slab["low"].alias("low"), slab["high"].alias("high"), at["since"].alias("x1"), edge["x"].alias("x2")))
            out = F.when(inside & (edge["x"] > at["since"]), F.concat(at["out"], piece)).otherwise(at["out"])
            within = F.when(F.array_contains(at["within"], edge["of"]), F.array_remove(at["within"], edge["of"])).otherwise(F.array_append(at["within"], edge["of"]))
            return F.struct(within.alias("within"), edge["x"].alias("since"), out.alias("out"))

        return F.aggregate(met, start, step, lambda at: at["out"])

    return F.flatten(F.transform(slabs, in_slab))


def overlaid(shapes: DataFrame, others: DataFrame, cell: float) -> DataFrame:
    """shapes (code, parts) with the share of their area that lies in the union of others (code, parts), and the point of that
    overlay: code, share, x, y. Only others in a cell of the shape take part; the arrays of a row are as long as they are complex."""
    pairs = cover(shapes, cell).select("code", "cx", "cy").join(cover(others, cell).select(F.col("code").alias("other"), "cx", "cy"), ["cx", "cy"]).select("code", "other").distinct()
    numbered = lambda n: lambda e: F.struct(e["x1"].alias("x1"), e["y1"].alias("y1"), e["x2"].alias("x2"), e["y2"].alias("y2"), n.cast("int").alias("of"))
    met = pairs.join(others.select(F.col("code").alias("other"), edges(F.col("parts")).alias("theirs")), "other").groupBy("code").agg(F.array_sort(F.collect_list(F.struct("other", "theirs"))).alias("met"))
    theirs = F.flatten(F.transform("met", lambda m, i: F.transform(m["theirs"], numbered(i + 1))))
    rows = shapes.select("code", edges(F.col("parts")).alias("own"), size(F.col("parts")).alias("whole")).join(met, "code", "left")
    rows = rows.select("code", "whole", F.concat(F.transform("own", numbered(F.lit(0))), F.coalesce(theirs, F.array().cast("array<struct<x1 double, y1 double, x2 double, y2 double, of int>>"))).alias("sides"))
    heights = F.array_sort(F.array_distinct(F.concat(F.transform("sides", lambda e: e["y1"]), _crossings(F.col("sides")))))
    slabs = F.zip_with(F.slice("heights", 1, F.greatest(F.size("heights") - 1, F.lit(0))), F.slice("heights", 2, F.greatest(F.size("heights") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("low"), b.alias("high")))
    rows = rows.withColumn("heights", heights).withColumn("found", stretches(F.col("sides"), slabs))
    inside = F.aggregate("found", F.lit(0.0), lambda s, p: s + (p["high"] - p["low"]) * (p["x2"] - p["x1"]))
    centre = (F.array_min(F.transform("found", lambda p: p["low"])) + F.array_max(F.transform("found", lambda p: p["high"]))) / 2
    rows = rows.select("code", "whole", "found", inside.alias("inside"), centre.alias("centre"))
    # a gap may hold the middle height: then the nearest slab with a stretch; of its stretches the widest, then the first
    rank = lambda p: F.struct(F.greatest(p["low"] - F.col("centre"), F.col("centre") - p["high"], F.lit(0.0)).alias("off"), (p["x1"] - p["x2"]).alias("narrow"), p["x1"].alias("x1"), p["x2"].alias("x2"), p["low"].alias("low"), p["high"].alias("high"))
    best = F.array_min(F.transform("found", rank))
    return rows.select("code", F.coalesce(F.try_divide("inside", "whole"), F.lit(0.0)).alias("share"), ((best["x1"] + best["x2"]) / 2).alias("x"), ((best["low"] + best["high"]) / 2).alias("y"))
