"""Domain views over the tables: places, hotspots, snapshots, reviews, sales, requests, logs.

The tables hold no places, so each view derives its columns from keys by integer arithmetic, with nulls put in by
modulus. The expressions are plain SQL that DuckDB reads too; the oracles are built from the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold import constants as K


def choice(of: str, values: tuple) -> str:
    """CASE of an index 0..n-1."""
    return "CASE " + of + " " + " ".join(f"WHEN {i} THEN '{v}'" if isinstance(v, str) else f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_OPENS = "CASE WHEN c_custkey % 17 = 0 THEN 'soon' WHEN c_custkey % 4 = 1 THEN '18:00' ELSE '9:30' END"
_CLOSES = "CASE WHEN c_custkey % 4 = 1 THEN '2:00' WHEN c_custkey % 4 = 2 THEN '24:00' ELSE '21:00' END"
_WEEK = ", ".join(f"'\"{d}\":[\"', {_OPENS}, '\",\"', {_CLOSES}, '\"],'" for d in ("mon", "tue", "wed", "thu", "fri"))
_WEEKEND = "CASE c_custkey % 3 WHEN 0 THEN '\"sat\":[\"10:00\",\"15:30\"],\"sun\":\"closed\"' WHEN 1 THEN '\"sat\":[\"22:00\",\"6:00\"],\"sun\":[\"11:00\"]' ELSE '\"sun\":[\"8:00\",\"25:00\"]' END"
#: Opening hours by weekday as JSON: overnight, to midnight, malformed, missing days, entries that are no pair.
HOURS = f"CASE WHEN c_custkey % 4 = 0 THEN CASE WHEN c_custkey % 8 = 0 THEN '{{}}' END ELSE concat('{{', {_WEEK}, {_WEEKEND}, '}}') END"
POI = {
    "k": "c_custkey",
    "poi_id": "concat('p', c_custkey)",
    "name": "c_name",
    "lat": "37.515 + ((c_custkey * 7919) % 4000) / 1e5",
    "lng": "126.955 + ((c_custkey * 104729) % 5000) / 1e5",
    "zone": choice("c_nationkey % 5", K.ZONES),
    "area": "c_nationkey",
    "category": "c_mktsegment",
    "capacity": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 2 + 2 * (c_custkey % 5) END",
    "price": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 1 + c_custkey % 4 END",
    "exposure": "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE ((c_custkey * 31) % 101) / 100 END",
    "confidence": "((c_custkey * 17) % 101) / 100",
    "quality": "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE ((c_custkey * 23) % 101) / 100 END",
    "sentiment": "CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE ((c_custkey * 13) % 101) / 100 END",
    "mentions": "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE (c_custkey * 37) % 5003 END",
    "tag1": f"CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE {choice('c_custkey % 6', K.PURPOSES)} END",
    "tag2": f"CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE {choice('(c_custkey + 1 + c_custkey % 3) % 6', K.PURPOSES)} END",
    "opens": "CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN 'soon' WHEN c_custkey % 4 = 1 THEN '18:00' ELSE '9:30' END",
    "closes": "CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN '2:00' WHEN c_custkey % 4 = 2 THEN '24:00' ELSE '21:00' END",
    "hours": HOURS,
    "vec_id": "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey % 500 END",
}
HOTSPOT = {
    "code": "concat('H', n_nationkey)",
    "hotspot": "n_name",
    "h_lat": "37.515 + ((n_nationkey * 7919 + 1700) % 4000) / 1e5",
    "h_lng": "126.955 + ((n_nationkey * 104729 + 2300) % 5000) / 1e5",
}
_X, _Y = "(126.955e0 + 0.01e0 * (n_nationkey % 5))", "(37.519e0 + 0.008e0 * ((n_nationkey - n_nationkey % 5) / 5e0))"
#: An area of each nation: a rectangle a with a rectangular hole h, and a second part b.
SHAPE = {
    "code": "concat('Z', n_nationkey)",
    "ax0": _X, "ax1": f"{_X} + 0.012e0 + 0.0005e0 * (n_nationkey % 3)", "ay0": _Y, "ay1": f"{_Y} + 0.0095e0",
    "hx0": f"{_X} + 0.003e0", "hx1": f"{_X} + 0.006e0", "hy0": f"{_Y} + 0.002e0", "hy1": f"{_Y} + 0.005e0",
    "bx0": f"{_X} + 0.02e0", "bx1": f"{_X} + 0.023e0", "by0": f"{_Y} - 0.004e0", "by1": f"{_Y} - 0.001e0",
}
#: A rectangle of each region; neighbours overlap.
DISTRICT = {
    "code": "concat('D', r_regionkey)",
    "ax0": "126.953e0 + 0.011e0 * r_regionkey", "ax1": "126.967e0 + 0.011e0 * r_regionkey", "ay0": "37.514e0 + 0.002e0 * r_regionkey", "ay1": "37.535e0 + 0.003e0 * r_regionkey",
}
USER = {
    "user_id": "s_suppkey",
    "u_lat": "37.51 + ((s_suppkey * 7907) % 5000) / 1e5",
    "u_lng": "126.95 + ((s_suppkey * 104723) % 6500) / 1e5",
}
SNAPSHOT = {
    "event_id": "event_id",
    "code": "concat('H', user_id % 11)",
    "ts": "ts",
    "level": f"CASE WHEN value < 10 THEN '{K.CONGESTION[0]}' WHEN value < 25 THEN '{K.CONGESTION[1]}' WHEN value < 50 THEN '{K.CONGESTION[2]}' ELSE '{K.CONGESTION[3]}' END",
    "rate20": "CASE WHEN event_id % 12 = 0 THEN NULL ELSE (event_id % 97) / 2e0 END",
    "people": "100 + event_id % 900",
}
REVIEW = {
    "chunk_id": "d.doc_id",
    "poi_id": "concat('p', d.doc_id % 100)",
    "sponsored": "coalesce(l.toxic, 0) = 1",
    "written": "CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE d.doc_id % 365 END",
    "vec_id": "CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE d.doc_id % 500 END",
    "relevant": "coalesce(l.quality, 1) = 1",
    "n_chars": "d.n_chars",
}


def aliased(columns: dict[str, str]) -> list[str]:
    return [f"{e} AS {n}" for n, e in columns.items()]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def poi(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(*aliased(POI))


def hotspots(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").where("n_nationkey < 11").selectExpr(*aliased(HOTSPOT))


def _ring(k: str) -> str:
    corners = [f"{k}{a}, {k}{b}" for a, b in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))]
    return "array(" + ", ".join(f"named_struct('x', {x}, 'y', {y})" for x, y in (c.split(", ") for c in corners)) + ")"


def shapes(spark: SparkSession, sf: str) -> DataFrame:
    """code, parts: areas of two parts, one with a hole."""
    rows = table(spark, sf, "nation").selectExpr(*aliased(SHAPE))
    return rows.selectExpr("code", f"array(array({_ring('a')}, {_ring('h')}), array({_ring('b')})) AS parts")


def districts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "region").selectExpr(*aliased(DISTRICT)).selectExpr("code", f"array(array({_ring('a')})) AS parts")


def users(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").selectExpr(*aliased(USER))


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(*aliased(SNAPSHOT))


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").alias("d").join(table(spark, sf, "labels").alias("l"), "doc_id", "left").selectExpr(*aliased(REVIEW))


def sales(spark: SparkSession, sf: str) -> DataFrame:
    """One row per line item: area, category and the four axes of its amount."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.selectExpr(*aliased(SALES))


SALES = {
    "area": "s_nationkey",
    "category": "p_type",
    "gender": "CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'M' END",
    "age_band": "10 + 10 * (o_custkey % 6)",
    "weekend": "CASE WHEN l_orderkey % 7 >= 5 THEN 1 ELSE 0 END",
    "band": "l_linenumber % 6",
    "amount": "l_extendedprice",
}

REQUEST_COLUMNS = "request_id purpose party budget u_lat u_lng u_zone gender age_band sensitivity rain pm feels hour sunset dow code user_vec day".split()


def request_rows() -> list[tuple]:
    """Twenty requests over all purposes, zones, party sizes and ages, one far outside and one that only relaxed
    search can serve."""
    out = []
    for i in range(20):
        zone = K.ZONES[i % 5]
        lat, lng = K.ANCHORS[zone]
        out.append((i, K.PURPOSES[i % 6], (2, 4, 1, 6, 3)[(i * 3) % 5], 1 + i % 4, lat, lng, zone, "FM"[i % 2], K.AGE_BANDS[(i * 5) % 6], 1 + i % 3, (0.0, 0.1, 0.4, 0.7)[i % 4], 1 + i % 4, (20.0, 33.0, -7.0, 10.0)[(i // 2) % 4], (12, 14, 19, 22, 9)[i % 5], 19, int(i % 7 >= 5), f"H{i % 11}", i * 7, ("mon", "tue", "wed", "thu", "fri", "sat", "sun")[i % 7]))
    out.append((20, K.PURPOSES[0], 2, 2, 37.60, 127.10, None, "F", 20, 2, 0.0, 1, 20.0, 12, 19, 0, None, None, "mon"))
    out.append((21, K.PURPOSES[1], 99, 1, 37.5445, 126.9675, "cheongpa", "M", 30, 3, 0.9, 4, 33.0, 20, 19, 1, "H1", 3, "sat"))
    return out


def requests(spark: SparkSession) -> DataFrame:
    """The requests as literal rows, so that the planner knows how few they are."""
    types = "int string int int double double string string int int double int double int int int string int string".split()
    show = lambda v, t: f"CAST({'NULL' if v is None else repr(v) + 'D' if isinstance(v, float) else repr(v)} AS {t})"
    rows = ", ".join("(" + ", ".join(map(show, r, types)) + ")" for r in request_rows())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({', '.join(REQUEST_COLUMNS)})")
