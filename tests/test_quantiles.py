"""Exact quantiles by selection against sorted lists."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators.quantiles import quantiles


def plain(values, p, discrete):
    v = sorted(values)
    if not v:
        return None
    if discrete:
        return v[max(math.ceil(round(p * len(v), 9)) - 1, 0)]
    h = round(p * (len(v) - 1), 9)
    low, high = v[math.floor(h)], v[math.ceil(h)]
    return low + (high - low) * (h - math.floor(h))


@pytest.mark.parametrize("discrete", [False, True])
@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_equals_sorted_lists(spark, discrete, partitions):
    rng = random.Random(9)
    rows = [("hot", rng.choice([5.0, rng.gauss(0, 1e6), rng.expovariate(1e-3)])) for _ in range(4000)]
    rows += [("ties", 7.0)] * 900 + [("ties", 8.0)] * 100 + [("one", -3.5), ("two", 1.0), ("two", 2.0), (None, 4.0), (None, 6.0), ("void", None), ("wide", 1e-300), ("wide", 1e300), ("wide", -1e300), ("hot", None)]
    at = {"p0": 0.0, "p5": 0.05, "half": 0.5, "p90": 0.9, "p95": 0.95, "all": 1.0}
    found = quantiles(spark.createDataFrame(rows, "range string, x double").repartition(5), ["range"], F.col("x"), at, discrete, partitions).collect()
    groups: dict = {}
    for k, v in rows:
        groups.setdefault(k, []).extend([] if v is None else [v])
    assert {r["range"] for r in found} == set(groups) and len(found) == len(groups)
    for r in found:
        assert [r[n] for n in at] == [pytest.approx(plain(groups[r["range"]], p, discrete), rel=1e-12) if groups[r["range"]] else None for p in at.values()]


def test_whole_table_and_empty(spark):
    whole = quantiles(spark.range(1001), [], F.col("id"), {"p": 0.123}).collect()
    assert [r.p for r in whole] == [pytest.approx(123.0)]
    assert quantiles(spark.range(0), [], F.col("id"), {"p": 0.5}).first().p is None
    assert quantiles(spark.range(0).withColumn("k", F.lit(1)), ["k"], F.col("id"), {"p": 0.5}).count() == 0


def test_no_task_holds_a_group(spark):
    """A group of all rows: its values pass in ranges of about equal size, and no percentile buffer is in the plan."""
    found = quantiles(spark.range(200_000).withColumn("k", F.lit("a")), ["k"], F.col("id"), {"p": 0.5}, partitions=16)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan.lower() and "collect" not in plan.lower()
    ranges = spark.read.parquet(found.inputFiles()[0].rsplit("/", 1)[0]).groupBy("part").count()
    sizes = [r["count"] for r in ranges.collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 200_000 / 16
    assert found.first().p == pytest.approx(99_999.5)
