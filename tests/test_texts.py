"""Character references and exact rounding against the standard library, projections against control points."""

from __future__ import annotations

import html
import random
import re
from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import functions as F

from wayfold.functions import entities
from wayfold.functions.columns import clean_html, clean_html_tags_first
from wayfold.functions.projection import BRITISH, CENTRAL, UNIFIED, from_grid, to_grid
from wayfold.functions.rounding import rounded


def test_references_equal_the_standard_decoder(spark):
    rng = random.Random(1)
    parts = ["&", "&amp", "&amp;", "amp;", "&lt;", "&notit;", "&notin;", "&not", "&frac12", "&#39;", "&#x27;", "&#X1F600;", "&#128", "&#0;", "&#xD800;", "&#x110000;", "&#99999999999999999999;", "&#000000000065;", "&middot;", "&middotx", "&nbsp;", " ", "x", ";", "#", "&#;", "&#x;", "&NotEqualTilde;", "&eacute", "é", "\x0b", "　", "&zzzz;", "<b>", "\n", "&#11;", "&#xFDD0;", "&#x1FFFF;", "&#13;", "&" + "a" * 40 + ";"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(1500)]
    texts += ["&" + k for k in html.entities.html5] + ["&" + k[:-1] + "z" for k in html.entities.html5] + ["", "&", "&&", "no reference", "x" * 100_000 + "&lt;"]
    frame = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    for r in frame.select("t", entities.unescaped(F.col("t")).alias("u"), clean_html(F.col("t")).alias("v1"), clean_html_tags_first(F.col("t")).alias("v2")).collect():
        t = r.t or ""
        assert r.u == (None if r.t is None else html.unescape(t))
        assert r.v1 == re.sub(r"\s+", " ", re.sub(r"<[^>]+>", "", html.unescape(t))).strip()
        assert r.v2 == html.unescape(re.sub(r"<[^>]+>", "", t)).strip()


def test_pages_equal_the_standard_decoder(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for r in pages.select("html", entities.unescaped(F.col("html")).alias("u")).collect():
        assert r.u == html.unescape(r.html)


def test_rounding_equals_the_exact_value_rounded_half_to_even(spark):
    rng = random.Random(2)
    values = [2.675, 0.125, 0.375, 1.005, -2.675, -0.125, 0.5, 1.5, 2.5, -0.5, 0.0, -0.0, 1e-300, 1e15, 123456.785, 0.045, 0.0005, 99.99995, 4503599627370495.5]
    values += [rng.uniform(-1000, 1000) for _ in range(2000)] + [rng.randrange(-100_000, 100_000) / 16 for _ in range(2000)] + [rng.randrange(10**6) / 10**5 for _ in range(2000)]
    frame = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),), (float("inf"),)], "v double")
    for digits in (0, 1, 2, 3, 4):
        for r in frame.select("v", rounded(F.col("v"), digits).alias("r")).collect():
            if r.v is None or r.v != r.v or abs(r.v) == float("inf"):
                assert repr(r.r) == repr(r.v)
                continue
            want = Decimal(r.v).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_EVEN)
            assert r.r == float(want) == float(round(r.v, digits)), (r.v, digits)


def test_projection_control_points_and_way_back(spark):
    """The published worked example of the British grid, to its millimetres, origins, and the way back everywhere near."""
    at = spark.range(1).select(to_grid(F.lit(52 + 39 / 60 + 27.2531 / 3600), F.lit(1 + 43 / 60 + 4.5177 / 3600), BRITISH).alias("p")).first().p
    assert abs(at.east - 651409.903) < 1e-3 and abs(at.north - 313177.270) < 1e-3
    for grid in (UNIFIED, CENTRAL):
        at = spark.range(1).select(to_grid(F.lit(38.0), F.lit(grid.lng), grid).alias("p")).first().p
        assert abs(at.east - grid.east) < 1e-6 and abs(at.north - grid.north) < 1e-6
        rows = spark.range(2000).select((33 + F.rand(1) * 6).alias("lat"), (124 + F.rand(2) * 7).alias("lng"))
        rows = rows.withColumn("p", to_grid(F.col("lat"), F.col("lng"), grid)).withColumn("q", from_grid(F.col("p.east"), F.col("p.north"), grid))
        worst = rows.agg(F.max(F.abs(F.col("q.lat") - F.col("lat"))).alias("a"), F.max(F.abs(F.col("q.lng") - F.col("lng"))).alias("b")).first()
        assert max(worst.a, worst.b) < 5e-11  # five micrometres
    assert spark.range(1).select(to_grid(F.lit(None).cast("double"), F.lit(1.0), UNIFIED).alias("p")).first().p.east is None
