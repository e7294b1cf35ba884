"""Candidate search: requests against places by grid-cell range join, filters, the relaxation ladder, nearest places."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold import constants as K
from wayfold.functions.columns import haversine, is_open_on, week_of
from wayfold.operators.nearest import nearest, nearest_of_few
from wayfold.sources.work import written

#: So many requests or fewer look for their nearest places in one pass over all of them.
FEW = 32
#: So many points or fewer (counted) are broadcast in a range join: 121 narrow rows each. So are their candidates, at most
#: CANDIDATE_LIMIT each, half a million narrow rows.
SMALL = 1000


def at_most(df: DataFrame, n: int) -> bool:
    """Whether df has n rows or fewer; reads no more than it must to know."""
    return df.limit(n + 1).count() <= n


def cells(lat: Column, lng: Column, metres: float, at_lat: float = 37.5) -> tuple[Column, Column]:
    """Grid cell at least metres wide in both directions up to latitude at_lat + 10."""
    dlat = math.degrees(metres / K.EARTH_RADIUS_M) * 1.0001
    dlng = dlat / math.cos(math.radians(at_lat + 10))
    return F.floor(lat / dlat), F.floor(lng / dlng)


def within(points: DataFrame, places: DataFrame, metres: float) -> DataFrame:
    """points (u_lat, u_lng) with every place (lat, lng) at most metres away, and dist.

    Each point is sent to its cell and those around it that a quarter of the distance a side can reach, so that the
    join is an equi-join on cells, a dense area is many keys, and few pairs are left for the exact distance. SMALL points or
    fewer are broadcast, so that the places stay where they are; beyond that both sides are dealt by cell (a merge join)."""
    side = "broadcast" if at_most(points, SMALL) else "merge"
    y, x = cells(F.col("u_lat"), F.col("u_lng"), metres / 4)
    around = F.sequence(F.lit(-5), F.lit(5))
    points = points.withColumn("_y", F.explode(F.transform(around, lambda d: y + d))).withColumn("_x", F.explode(F.transform(around, lambda d: x + d)))
    y, x = cells(F.col("lat"), F.col("lng"), metres / 4)
    near = points.hint(side).join(places.withColumn("_y", y).withColumn("_x", x), ["_y", "_x"]).drop("_y", "_x")
    return near.withColumn("dist", haversine(F.col("u_lat"), F.col("u_lng"), F.col("lat"), F.col("lng"))).where(F.col("dist") <= metres)


def with_week(places: DataFrame) -> DataFrame:
    """places with their hours parsed, once a place and not once a pair."""
    return places.withColumn("week", week_of(F.col("hours"))).drop("hours")


def passes() -> Column:
    """Hard filter of a place (with its parsed week) for a request, but for radius and confidence. Unknown capacity, price
    and hours pass."""
    e = F.coalesce("exposure", F.lit(0.0))
    return (
        is_open_on(F.col("week"), F.col("day"), F.col("hour") * 60)
        & (F.col("capacity").isNull() | (F.col("capacity") >= F.col("party")))
        & ((F.col("rain") < 0.6) | (e <= 0.7))
        & ((F.col("pm") < 4) | (e <= 0.5))
        & (F.col("price").isNull() | (F.col("price") <= F.col("budget")))
    )


def ladder(requests: DataFrame, near: DataFrame, radii: tuple[float, ...] = K.RADII, low: int = K.MIN_CANDIDATES, least: int = K.RELAX_BELOW) -> DataFrame:
    """For each request the stage of relaxation it ends in: request_id, stage, radius, confidence, n.

    near: (request_id, dist, confidence) of the places that pass all other filters at the widest radius. Radii widen
    while fewer than `low` places pass; below `least` at the widest the confidence is relaxed. All stages' counts come
    from one aggregate."""
    strict = F.col("confidence") >= K.CONFIDENCE
    counts = [F.count_if(strict & (F.col("dist") <= r)).alias(f"n{i}") for i, r in enumerate(radii)]
    relaxed = F.count_if(F.col("confidence") >= K.CONFIDENCE_RELAXED).alias("n_relaxed")
    found = near.groupBy("request_id").agg(*counts, relaxed)
    out = requests.select("request_id").join(found, "request_id", "left").fillna(0)
    last = len(radii) - 1
    stage = F.lit(last)
    for i in reversed(range(last)):
        stage = F.when(F.col(f"n{i}") >= low, i).otherwise(stage)
    stage = F.when((stage == last) & (F.col(f"n{last}") < least), last + 1).otherwise(stage)
    out = out.withColumn("stage", stage)
    n = F.col("n_relaxed")
    radius = F.lit(radii[-1])
    for i in reversed(range(last + 1)):
        n = F.when(F.col("stage") == i, F.col(f"n{i}")).otherwise(n)
        radius = F.when(F.col("stage") == i, radii[i]).otherwise(radius)
    return out.select("request_id", "stage", radius.alias("radius"), F.when(F.col("stage") > last, K.CONFIDENCE_RELAXED).otherwise(K.CONFIDENCE).alias("confidence_min"), n.alias("n"), (n < low).alias("low_confidence"))


def candidates(requests: DataFrame, places: DataFrame) -> DataFrame:
    """Places of each request after the ladder: at most CANDIDATE_LIMIT nearest, or the nearest few if hardly any pass.

    The range join runs once: what passes is written narrow, and counts, choice and fallback read that table. A request's
    fallback rows, if it has any, take the place of the chosen ones. With SMALL requests or fewer the candidates are
    broadcast to the places instead of shuffling these."""
    near = within(requests, with_week(places), K.RADII[-1]).where(passes()).select("request_id", "poi_id", "dist", "confidence")
    near = written(near, "near")
    stages = ladder(requests, near).select("request_id", "stage", "radius", "confidence_min", "n")
    chosen = near.join(stages, "request_id").where((F.col("dist") <= F.col("radius")) & (F.col("confidence") >= F.col("confidence_min")))
    w = Window.partitionBy("request_id").orderBy("dist", "poi_id")
    chosen = chosen.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= K.CANDIDATE_LIMIT)
    columns = ["request_id", "poi_id", "dist", "stage", "radius", "confidence_min", "n"]
    starved = requests.select("request_id", "u_lat", "u_lng").join(stages.where(F.col("n") < K.RELAX_BELOW).drop("stage"), "request_id")
    closest = nearest_of_few if at_most(requests, FEW) or at_most(starved, FEW) else nearest
    fallback = closest(starved, places, "request_id", K.NEAREST, "poi_id").join(starved.drop("u_lat", "u_lng"), "request_id")
    # the fallback holds only if it gives more places than the ladder did
    sized = fallback.withColumn("_m", F.count("*").over(Window.partitionBy("request_id"))).where(F.col("_m") > F.col("n"))
    last = len(K.RADII) + 1
    found = chosen.select(*columns).unionByName(sized.withColumn("stage", F.lit(last)).select(*columns))
    found = found.withColumn("_last", F.max("stage").over(Window.partitionBy("request_id"))).where((F.col("stage") == last) | (F.col("_last") < last)).drop("_last")
    found = found.join(requests, "request_id")
    return (found.hint("broadcast") if at_most(requests, SMALL) else found).join(places, "poi_id")
