"""The k nearest places of many points, by cells of the sphere.

Latitudes are cut into rows of equal height, each row into cells as wide as they are high at its widest, at LEVELS sizes, each
a quarter of the one before. Three steps, each an equi-join on cells:
  1. How many places each cell of each level holds (one aggregate).
  2. For each point and level the cells that a circle of one cell height reaches, and how many places they hold. The finest
     level with k places or more gives a radius that holds the k nearest: the farthest corner of those cells.
  3. At that level the cells that the circle of this radius reaches; no cell beyond can hold one of the k nearest. Their
     places are measured, and the first k stay.
The work of a point is bounded by k and not by the places there are: a dense area uses small cells, an empty one large ones. Of
places at one spot only the first k can count, so that a spot of many places sends k. Points at one spot have the same
neighbours: the steps run once for each distinct spot, and the points get its k rows in the end.

Sizes of exploded rows are not known before they are made, and equal rows shrink in a shuffle to far less than they take in
memory, so that the planner could broadcast too much through the driver: the joins ask for a merge.

Points or places without coordinates have no neighbours; fewer than k places are all returned; ties go by `tie`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold import constants as K
from wayfold.functions.columns import haversine
from wayfold.sources.work import written

LEVELS = 12
LARGEST = 180.0
CELL = "array<struct<y bigint, x bigint>>"


def _height(level: Column) -> Column:
    return F.lit(LARGEST) / F.pow(F.lit(4.0), level)


def _widest(y: Column, height: Column) -> Column:
    """Cosine of the latitude of a row's widest edge."""
    low, high = y * height, (y + 1) * height
    return F.when((low < 0) & (high > 0), 1.0).otherwise(F.cos(F.radians(F.least(F.least(F.abs(low), F.abs(high)), F.lit(90.0)))))


def cell_of(lat: Column, lng: Column, height: Column) -> Column:
    y = F.floor(lat / height)
    return F.struct(y.alias("y"), F.floor(lng * _widest(y, height) / height).alias("x"))


def reached(lat: Column, lng: Column, metres: Column, height: Column) -> Column:
    """The cells that a circle of metres around a point meets, across the poles and the 180th meridian too."""
    angle = F.least(metres / K.EARTH_RADIUS_M * (1 + 1e-9) + 1e-12, F.lit(math.pi))
    degrees = F.degrees(angle)
    polar = angle >= F.radians(90 - F.abs(lat))
    aside = F.when(polar, 180.0).otherwise(F.degrees(F.asin(F.least(F.sin(angle) / F.cos(F.radians(lat)), F.lit(1.0)))) * (1 + 1e-9) + 1e-9)
    rows = F.sequence(F.floor(F.greatest(lat - degrees, F.lit(-90.0)) / height), F.floor(F.least(lat + degrees, F.lit(90.0)) / height))

    def cells(y: Column) -> Column:
        scale = _widest(y, height) / height

        def span(shift: float) -> Column:
            low, high = F.greatest(lng - aside + shift, F.lit(-180.0)), F.least(lng + aside + shift, F.lit(180.0))
            some = F.sequence(F.floor(low * scale), F.floor(high * scale))
            return F.when(low <= high, some).otherwise(F.array().cast("array<bigint>"))

        every = F.array_distinct(F.concat(*[span(s) for s in (0.0, -360.0, 360.0)]))
        return F.transform(every, lambda x: F.struct(y.alias("y"), x.alias("x")))

    return F.flatten(F.transform(rows, cells)).cast(CELL)


def farthest(lat: Column, lng: Column, y: Column, x: Column, height: Column) -> Column:
    """A bound in metres on the distance from a point to all of a cell."""
    wide = _widest(y, height)
    low, width = x * height / wide, height / wide
    turned = lambda d: F.when(d > 180, 360 - d).otherwise(d)
    across = F.least(F.least(turned(F.abs(lng - low)), turned(F.abs(lng - low - width))) + width, F.lit(180.0))
    along = F.least(F.greatest(F.abs(lat - y * height), F.abs(lat - (y + 1) * height)), F.lit(180.0))
    a = F.pow(F.sin(F.radians(along) / 2), 2) + F.cos(F.radians(lat)) * wide * F.pow(F.sin(F.radians(across) / 2), 2)
    return F.lit(2 * K.EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * (1 + 1e-9) + 1e-6


def radii(points: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """For each distinct point (u_lat, u_lng) the level to search and a radius that holds its k nearest places."""
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level")
    at = cell_of(F.col("lat"), F.col("lng"), _height(F.col("level")))
    held = places.select("lat", "lng", levels).select("level", at.alias("cell")).groupBy("level", "cell.y", "cell.x").agg(F.count("*").alias("n"))
    height = _height(F.col("level"))
    asked = points.select("u_lat", "u_lng", levels)
    asked = asked.select("*", F.inline(reached(F.col("u_lat"), F.col("u_lng"), F.radians(height) * K.EARTH_RADIUS_M, height)))
    far = farthest(F.col("u_lat"), F.col("u_lng"), F.col("y"), F.col("x"), height)
    sums = asked.join(held.hint("merge"), ["level", "y", "x"]).groupBy("u_lat", "u_lng", "level").agg(F.sum("n").alias("n"), F.max(far).alias("radius"))
    found = sums.where(F.col("n") >= k).groupBy("u_lat", "u_lng").agg(F.max_by(F.struct("level", "radius"), "level").alias("found"))
    whole = F.struct(F.lit(0).alias("level"), F.lit(math.pi * K.EARTH_RADIUS_M + 1).alias("radius"))
    return points.select("u_lat", "u_lng").join(found.hint("merge"), ["u_lat", "u_lng"], "left").select("u_lat", "u_lng", F.inline(F.array(F.coalesce("found", whole))))


def nearest(points: DataFrame, places: DataFrame, key: str, k: int, tie: str) -> DataFrame:
    """points (key, u_lat, u_lng) with their k nearest places (tie, lat, lng): also dist and rank, 1 the nearest."""
    some = points.select(key, "u_lat", "u_lng").where("u_lat is not null and u_lng is not null")
    spots = places.where("lat is not null and lng is not null")
    first = F.row_number().over(Window.partitionBy("lat", "lng").orderBy(tie))
    spots = spots.select(tie, "lat", "lng").withColumn("_n", first).where(F.col("_n") <= k).drop("_n")
    search = written(radii(some.select("u_lat", "u_lng").distinct(), spots, k), "nearest")
    cells = search.select("*", F.inline(reached(F.col("u_lat"), F.col("u_lng"), F.col("radius"), _height(F.col("level")))))
    used = search.select("level").distinct()  # LEVELS rows at most
    every = spots.select("*", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level"))
    dealt = every.join(F.broadcast(used), "level").select("*", cell_of(F.col("lat"), F.col("lng"), _height(F.col("level"))).alias("cell")).select(tie, "lat", "lng", "level", "cell.y", "cell.x")
    pairs = cells.join(dealt.hint("merge"), ["level", "y", "x"])
    pairs = pairs.withColumn("dist", haversine(F.col("u_lat"), F.col("u_lng"), F.col("lat"), F.col("lng"))).where(F.col("dist") <= F.col("radius"))
    w = Window.partitionBy("u_lat", "u_lng").orderBy("dist", tie)
    best = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("u_lat", "u_lng", tie, "dist", "rank")
    return some.join(best.hint("merge"), ["u_lat", "u_lng"]).select(key, tie, "dist", "rank")


def nearest_of_few(points: DataFrame, places: DataFrame, key: str, k: int, tie: str) -> DataFrame:
    """The same for a handful of points, counted by the caller: one pass over the places, which keeps k a point and task."""
    pairs = places.select(tie, "lat", "lng").crossJoin(F.broadcast(points.select(key, "u_lat", "u_lng")))
    pairs = pairs.withColumn("dist", haversine(F.col("u_lat"), F.col("u_lng"), F.col("lat"), F.col("lng"))).where("dist is not null")
    w = Window.partitionBy(key).orderBy("dist", tie)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(key, tie, "dist", "rank")
