"""Explanations of shown places: from the cache, else from the model, else by template, all in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def verified(items: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """items (key, poi_id, reason, at) that may be shown: of allowed (key, poi_id) places only, the first of a place, and none whose reason
    is blank."""
    fit = items.where(F.trim("reason") != "").join(allowed.select(key, "poi_id").distinct(), [key, "poi_id"], "left_semi")
    return fit.groupBy(key, "poi_id").agg(F.min_by("reason", "at").alias("reason"))


def cascade(allowed: DataFrame, cached: DataFrame, model: DataFrame, key: str, template: str) -> DataFrame:
    """allowed (key, poi_id) places with reason and mode. What the cache holds is verified again, as places may have changed since;
    a key with a verified item there is served by the cache alone, else by the model if one of its items holds, else by the
    template. Places that the serving source does not name have the template's reason."""
    known = verified(cached, allowed, key).withColumnRenamed("reason", "from_cache")
    said = verified(model, allowed, key).withColumnRenamed("reason", "from_model")
    served = known.select(key).distinct().withColumn("by_cache", F.lit(True))
    told = said.select(key).distinct().withColumn("by_model", F.lit(True))
    rows = allowed.select(key, "poi_id").distinct().join(known, [key, "poi_id"], "left").join(said, [key, "poi_id"], "left").join(served, key, "left").join(told, key, "left")
    mode = F.when(F.col("by_cache"), "cache").when(F.col("by_model"), "llm").otherwise("template")
    reason = F.when(F.col("by_cache"), F.col("from_cache")).when(F.col("by_model"), F.col("from_model"))
    return rows.select(key, "poi_id", F.coalesce(reason, F.lit(template)).alias("reason"), mode.alias("mode"))
