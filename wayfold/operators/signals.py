"""City signals: JSON shapes, latest state, forecast as-of, freshness, rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEATHER = "map<string,string>"
PEOPLE = "array<struct<FCST_TIME string, FCST_CONGEST_LVL string, FCST_PPLTN_MIN string, FCST_PPLTN_MAX string>>"


def latest(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Last row of each key in order: one aggregate with map-side combination, no sort."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_last")).select(key, *(F.col("_last")[c].alias(c) for c in columns))


def as_of(left: DataFrame, slots: DataFrame, key: str, at: str, slot_at: str, tolerance_s: int, columns: list[str]) -> DataFrame:
    """left with the slot nearest in time to `at` within the tolerance, the earlier position on a tie.

    Slots and rows meet on (key, time bucket) with the neighbouring buckets, so that the join is an equi-join."""
    left = left.withColumn("_row", F.monotonically_increasing_id()).withColumn("_at", F.unix_timestamp(at))
    bucket = F.floor(F.col("_at") / tolerance_s)
    wide = left.select("_row", key, "_at", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"))
    right = slots.withColumn("_s", F.unix_timestamp(slot_at)).withColumn("_b", F.floor(F.col("_s") / tolerance_s))
    gap = F.abs(F.col("_s") - F.col("_at"))
    best = wide.join(right, [key, "_b"]).where(gap <= tolerance_s).groupBy("_row").agg(F.min_by(F.struct(*columns), F.struct(gap, F.col("_s"))).alias("_best"))
    return left.join(best, "_row", "left").select(*[c for c in left.columns if c not in ("_row", "_at")], *(F.col("_best")[c].alias(c) for c in columns))


def people_forecast(fcst: Column) -> Column:
    """Population forecast of either shape: an object with `population`, or the bare array."""
    return F.coalesce(F.from_json(F.get_json_object(fcst, "$.population"), PEOPLE), F.from_json(fcst, PEOPLE))


def weather_fields(weather: Column) -> Column:
    """Weather object with lower-cased keys."""
    return F.transform_keys(F.from_json(weather, WEATHER), lambda k, _: F.lower(k))


def freshness(rows: DataFrame, now: DataFrame, key: str, at: str, hours: int = 6, slots: int = 12, minutes: int = 90) -> DataFrame:
    """Each key's distinct times in the last hours before now (one row), its last time, and whether it is fresh: slots times or more,
    the last no older than minutes."""
    seen = rows.crossJoin(F.broadcast(now)).where(F.col(at) <= F.col("now"))
    recent = F.col(at) > F.col("now") - F.expr(f"INTERVAL {hours} HOURS")
    out = seen.groupBy(key).agg(F.countDistinct(F.when(recent, F.col(at))).alias("slots"), F.max(at).alias("last_at"), F.max("now").alias("now"))
    return out.select(key, "slots", "last_at", ((F.col("slots") >= slots) & (F.col("last_at") >= F.col("now") - F.expr(f"INTERVAL {minutes} MINUTES"))).alias("fresh"))


def sliding_counts(rows: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """rows with hits, the number of rows of the key in the seconds up to and with each."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(at))).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return rows.withColumn("hits", F.count("*").over(w))


def long_to_slot(items: DataFrame, keys: list[str], wanted: dict[str, str]) -> DataFrame:
    """Long (category, value) items -> one row of typed columns per slot."""
    return items.groupBy(*keys).agg(*(F.max(F.when(F.col("category") == c, F.col("value"))).try_cast("double").alias(n) for c, n in wanted.items()))
