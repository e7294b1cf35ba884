"""Exact quantiles by distributed selection: no task or buffer holds the values of a group.

Equal values of a group are counted first. The (group, value) counts are dealt into ranges of about equal size over all groups, so
that a large group spreads over many ranges. Each range's total per group (a row or two a range) gives the counts
before it by a running sum over ranges; inside a range the counts run on. The one or two values whose
counts reach a wanted rank are all that is left of a group.

Nulls of the value are not counted; a group of nulls alone has null quantiles; null keys are a group; NaN is the largest value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.sources.work import written


def running_counts(rows: DataFrame, keys: list[str], value: str, partitions: int | None = None) -> DataFrame:
    """keys, value, before, after, total: each distinct value of a group, how many are less, how many not greater, and how many
    there are. Key columns are called k0, k1 and so on."""
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    dealt = written(counts.repartitionByRange(n, *keys, value).withColumn("part", F.spark_partition_id()), "ranges")
    parts = dealt.groupBy("part", *keys).agg(F.sum("n").alias("held"))
    group = Window.partitionBy(*keys)
    earlier = F.coalesce(F.sum("held").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", *keys, earlier.alias("base"), F.sum("held").over(group).alias("total")).alias("p")
    upto = F.sum("n").over(Window.partitionBy("part", *keys).orderBy(value))
    inside = dealt.withColumn("upto", upto).alias("d")
    same = F.col("d.part") == F.col("p.part")
    for k in keys:
        same = same & F.col(f"d.{k}").eqNullSafe(F.col(f"p.{k}"))
    after = F.col("base") + F.col("upto")
    return inside.join(parts, same).select(*[f"d.{k}" for k in keys], value, (after - F.col("n")).alias("before"), after.alias("after"), "total")


def quantiles(rows: DataFrame, keys: list[str], value: Column, at: dict[str, float], discrete: bool = False, partitions: int | None = None) -> DataFrame:
    """One row a group: keys and a column for each name of `at`, the quantile of that share; interpolated between neighbours, or,
    discrete, the value of rank ceil(p n). Without keys one row."""
    own = {k: f"k{i}" for i, k in enumerate(keys)}
    rows = rows.select(*[F.col(k).alias(x) for k, x in own.items()], value.cast("double").alias("value"))
    found = running_counts(rows, [*own.values()], "value", partitions)
    place = {n: F.greatest(F.ceil(F.round(F.lit(float(p)) * F.col("total"), 9)) - 1, F.lit(0)) if discrete else F.round(F.lit(float(p)) * (F.col("total") - 1), 9) for n, p in at.items()}
    holds = lambda i: (F.col("before") <= i) & (i < F.col("after"))
    wanted, columns = F.lit(False), []
    for name, h in place.items():
        low, high = F.floor(h), F.ceil(h)
        wanted = wanted | holds(low) | holds(high)
        below, above = F.max(F.when(holds(low), F.col("value"))), F.max(F.when(holds(high), F.col("value")))
        share = F.max(h - low)
        columns.append(F.when(share == 0, below).otherwise(below + (above - below) * share).alias(name))
    picked = found.where(wanted).groupBy(*own.values()).agg(*columns)
    if not keys:
        return picked
    same = F.lit(True)
    for x in own.values():
        same = same & F.col(f"g.{x}").eqNullSafe(F.col(f"q.{x}"))
    groups = rows.select(*own.values()).distinct().alias("g")
    return groups.join(picked.alias("q"), same, "left").select(*[F.col(f"g.{x}").alias(k) for k, x in own.items()], *at)
