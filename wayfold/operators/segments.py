"""Demographic affinity from sales and its checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AXES = ("gender", "age_band", "weekend", "band")


def affinity(sales: DataFrame) -> DataFrame:
    """sales (area, category, gender, age_band, weekend, band, amount) -> affinity and weight of each cell that occurs on
    all axes: the product of the axes' shares, as if they were independent. Groups without sales are left out.

    One pass with GROUPING SETS gives the group and the four axis totals; the cells are built from arrays within the
    group's row."""
    sets = [["area", "category", a] for a in AXES] + [["area", "category"]]
    totals = sales.groupingSets([[F.col(c) for c in s] for s in sets], "area", "category", *AXES).agg(F.sum("amount").alias("amount"), F.count("*").alias("n"), F.grouping_id().alias("gid"))
    per_axis = []
    for i, a in enumerate(AXES):
        bit = 0b1111 & ~(1 << (3 - i))
        per_axis.append(F.collect_list(F.when(F.col("gid") == bit, F.struct(F.col(a).alias("key"), "amount"))).alias(a))
    whole = F.col("gid") == 0b1111
    groups = totals.groupBy("area", "category").agg(*per_axis, F.max(F.when(whole, F.col("amount"))).alias("total"), F.max(F.when(whole, F.col("n"))).alias("n")).where("total > 0")
    for a in AXES:
        groups = groups.withColumn(a, F.explode(a))
    share = F.lit(1.0)
    for a in AXES:
        share = share * (F.col(f"{a}.amount") / F.col("total"))
    return groups.select("area", "category", *(F.col(f"{a}.key").alias(a) for a in AXES), share.alias("affinity"), (F.col("n") * share).alias("weight"))


def paired(a: DataFrame, x: str, b: DataFrame, y: str) -> DataFrame:
    """Pair two small sets of names by their order."""
    number = lambda df, c: df.withColumn("_n", F.row_number().over(Window.orderBy(c)))
    return number(a, x).join(number(b, y), "_n").select(x, y)


def invariants(cells: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Per group: cells, sum and whether sum and range hold."""
    out = cells.groupBy("area", "category").agg(F.count("*").alias("cells"), F.sum("affinity").alias("total"), F.min("affinity").alias("low"), F.max("affinity").alias("high"))
    return out.withColumn("ok", (F.abs(F.col("total") - 1) <= tolerance) & (F.col("low") >= 0) & (F.col("high") <= 1))
