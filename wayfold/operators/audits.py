"""Audit reports: fill rates, histograms, crosstabs, percentiles, spreads, sensitivity, feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.quantiles import quantiles


def observed(rows: DataFrame, checks: dict[str, Column], fatal: tuple[str, ...] = (), low: float = 0.5) -> DataFrame:
    """One row per check: name, n, total, rate, status (FAIL if fatal and empty, WARN below low, else OK)."""
    one = rows.agg(F.count("*").alias("total"), *(F.count_if(c).alias(n) for n, c in checks.items()))
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("n"), F.lit(n in fatal).alias("fatal")) for n in checks)))
    out = one.select("total", pairs.alias("c")).select("c.name", "c.n", "total", F.try_divide(F.col("c.n"), "total").alias("rate"), "c.fatal")
    return out.withColumn("status", F.when((F.col("rate") == 0) & F.col("fatal"), "FAIL").when(F.col("rate") < low, "WARN").otherwise("OK")).drop("fatal")


def catalog(rows: DataFrame) -> DataFrame:
    """One row a column: col, type, n, nulls, kinds. Distinct values are counted by pre-aggregated (column, value) hashes."""
    fields = [(f.name, f.dataType.simpleString()) for f in rows.schema]
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("col"), F.lit(k).alias("type"), F.when(F.col(n).isNotNull(), F.xxhash64(n)).alias("v")) for n, k in fields))).alias("x")
    values = rows.select(each).select("x.*").groupBy("col", "type", "v").agg(F.count("*").alias("c"))
    return values.groupBy("col", "type").agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("c"))), F.lit(0)).alias("nulls"), F.count("v").alias("kinds"))


def histogram(rows: DataFrame, value: Column, bounds: list[float]) -> DataFrame:
    """Right-closed bins with open ends: bin number, n."""
    bin_ = F.lit(len(bounds))
    for i, b in reversed(list(enumerate(bounds))):
        bin_ = F.when(value <= b, i).otherwise(bin_)
    return rows.where(value.isNotNull()).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


def crosstab(rows: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    return rows.groupBy(row).pivot(column, values).count().na.fill(0)


def sweep(rows: DataFrame, value: Column, limits: list[float], at_least: bool) -> DataFrame:
    """Rows at or beyond each limit: one aggregate, then one row a limit."""
    holds = (lambda b: value >= b) if at_least else (lambda b: value <= b)
    one = rows.agg(F.count("*").alias("total"), *(F.count_if(holds(b)).alias(f"_{i}") for i, b in enumerate(limits)))
    return one.select("total", F.explode(F.array(*(F.struct(F.lit(float(b)).alias("bound"), F.col(f"_{i}").alias("n")) for i, b in enumerate(limits)))).alias("c")).select("c.bound", "c.n", "total")


def nearest_rank(rows: DataFrame, keys: list[str], value: str, at: list[float]) -> DataFrame:
    """Percentiles by nearest rank ceil(p n): values that occur."""
    return quantiles(rows, keys, F.col(value), {f"p{round(p * 100)}": p for p in at}, discrete=True)


def spread(rows: DataFrame, group: str, terms: list[str]) -> DataFrame:
    """Mean over groups of each term's population deviation (groups with two values or more): term, sigma, alive."""
    long = rows.select(group, F.explode(F.array(*(F.struct(F.lit(t).alias("term"), F.col(t).cast("double").alias("v")) for t in terms))).alias("x")).select(group, "x.term", "x.v")
    each = long.groupBy(group, "term").agg(F.stddev_pop("v").alias("s"), F.count("v").alias("n")).where("n >= 2")
    return each.groupBy("term").agg(F.avg("s").alias("sigma")).withColumn("alive", F.col("sigma") > 1e-6)


def contribution(spreads: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Share of weight times sigma beside the share of the weight alone. One row per term."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("term")]
    every = Window.partitionBy()
    out = spreads.withColumn("w", w)
    return out.select("term", (F.col("w") * F.col("sigma") / F.sum(F.col("w") * F.col("sigma")).over(every)).alias("share"), (F.col("w") / F.sum("w").over(every)).alias("design"))


def sensitivity(candidates: DataFrame, variants: dict[str, dict[str, float]], base: dict[str, float], k: int = 5) -> DataFrame:
    """candidates (log_id, poi_id, one column per term) rescored under each variant: kept share of the top k and share of
    logs whose first changes."""
    def score(w: dict[str, float]) -> Column:
        total, weight = F.lit(0.0), F.lit(0.0)
        for t, x in w.items():
            total = total + F.coalesce(F.col(t) * x, F.lit(0.0))
            weight = weight + F.when(F.col(t).isNotNull(), x).otherwise(0.0)
        return F.try_divide(total, weight)

    all_w = {"base": base} | variants
    long = candidates.select("log_id", "poi_id", F.explode(F.array(*(F.struct(F.lit(n).alias("variant"), F.round(score(w), 9).alias("s")) for n, w in all_w.items()))).alias("x")).select("log_id", "poi_id", "x.variant", "x.s")
    w = Window.partitionBy("log_id", "variant").orderBy(F.desc("s"), "poi_id")
    tops = long.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("log_id", "variant").agg(F.collect_set("poi_id").alias("top"), F.min_by("poi_id", "r").alias("first"))
    base_top = tops.where("variant = 'base'").select("log_id", F.col("top").alias("t0"), F.col("first").alias("f0"))
    both = tops.where("variant <> 'base'").join(base_top, "log_id")
    kept = F.size(F.array_intersect("top", "t0")) / F.size("t0")
    return both.groupBy("variant").agg(F.avg(kept).alias("kept"), F.avg((F.col("first") != F.col("f0")).cast("int")).alias("changed"))
