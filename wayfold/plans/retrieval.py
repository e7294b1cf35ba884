"""Search, spatial and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold import constants as K
from wayfold.functions import columns as C
from wayfold.functions import scoring as S
from wayfold.operators import audits, ranking, search
from wayfold.operators.nearest import nearest
from wayfold.plans.registry import HAVERSINE, query
from wayfold.sources import views as V
from wayfold.sources.work import written

_minutes = lambda x: f"CASE WHEN regexp_matches({x}, '^[0-9]{{1,2}}:[0-9]{{2}}$') AND (CAST(split_part({x}, ':', 1) AS INT) < 24 OR {x} = '24:00') AND CAST(split_part({x}, ':', 2) AS INT) < 60 THEN CAST(split_part({x}, ':', 1) AS INT) * 60 + CAST(split_part({x}, ':', 2) AS INT) END"
_of = lambda i: _minutes(f"json_extract_string(hours, concat('$.', day, '[{i}]'))")
OPEN = lambda m: f"CASE WHEN hours IS NULL OR json_type(hours, concat('$.', day)) IS DISTINCT FROM 'ARRAY' OR json_array_length(hours, concat('$.', day)) < 2 OR ({_of(0)}) IS NULL OR ({_of(1)}) IS NULL THEN TRUE WHEN ({_of(1)}) <= ({_of(0)}) THEN {m} >= ({_of(0)}) OR {m} < ({_of(1)}) ELSE {m} >= ({_of(0)}) AND {m} < ({_of(1)}) END"
PASSES = f"({OPEN('hour * 60')}) AND (capacity IS NULL OR capacity >= party) AND (rain < 0.6 OR coalesce(exposure, 0) <= 0.7) AND (pm < 4 OR coalesce(exposure, 0) <= 0.5) AND (price IS NULL OR price <= budget)"
FIT = """least(greatest((CASE WHEN rain > 0.3 THEN 1 - (CASE sensitivity WHEN 1 THEN 0.5 WHEN 2 THEN 0.7 WHEN 3 THEN 0.9 ELSE 0.7 END) * coalesce(exposure, 0) * least(rain, 1) ELSE 1 END)
 * (CASE WHEN pm >= 3 THEN 1 - 0.5 * coalesce(exposure, 0) ELSE 1 END) * (CASE WHEN feels > 31 OR feels < -5 THEN 1 - 0.6 * coalesce(exposure, 0) ELSE 1 END)
 * (CASE WHEN rain < 0.2 AND feels BETWEEN 15 AND 25 THEN 1 + 0.4 * coalesce(exposure, 0) ELSE 1 END) * (CASE WHEN hour >= sunset THEN 1 - 0.3 * coalesce(exposure, 0) ELSE 1 END), 0), 1.5)"""
_res = " ".join(f"WHEN (u_zone = '{a}' AND zone = '{b}') OR (u_zone = '{b}' AND zone = '{a}') THEN {v}" for (a, b), v in K.ZONE_RESISTANCE.items())
RESISTANCE = f"(CASE WHEN u_zone IS NULL OR zone IS NULL OR u_zone = zone THEN 1.0 {_res} ELSE 1.0 END)"
PURPOSE = "(CASE WHEN tag1 IS NULL THEN 0.5 WHEN tag1 = purpose THEN 0.95 WHEN tag2 = purpose THEN 0.8 ELSE 0.35 END)"
PENALTY = f"least(least(dist * {RESISTANCE} / 2000, 1) * (CASE WHEN rain > 0.5 THEN 2 ELSE 1 END), 1)"
_base = " ".join(f"WHEN {k} THEN {v}" for k, v in K.AGE_BASELINE.items())
LIVE = f"least(greatest((CASE WHEN rate > 1 THEN rate / 100 ELSE rate END) / (CASE age_band {_base} END) / 2, 0), 1)"
_cases = lambda t: " ".join(f"WHEN '{k}' THEN {v}" for k, v in t.items())
CROWD = f"""(CASE WHEN level IS NULL THEN NULL WHEN purpose IN {K.QUIET_PURPOSES} THEN (CASE level {_cases(K.CROWD_QUIET)} ELSE 0.8 END)
 WHEN purpose IN {K.LIVELY_PURPOSES} THEN (CASE level {_cases(K.CROWD_LIVELY)} ELSE 0.8 END) ELSE 0.8 END)"""
R6 = lambda x, n: F.round(x, 6).alias(n)
R3 = lambda x, n: F.round(x, 3).alias(n)


def near(spark, sf):
    return search.within(V.requests(spark), search.with_week(V.poi(spark, sf)), K.RADII[2])


@query("geo01_haversine", f"SELECT request_id, poi_id, round({HAVERSINE}, 3) AS dist FROM v_request, v_poi")
def _(spark, sf):
    # the requests are a fixed query set; each place meets it once
    pairs = V.poi(spark, sf).crossJoin(F.broadcast(V.requests(spark)))
    return pairs.select("request_id", "poi_id", R3(C.haversine(F.col("u_lat"), F.col("u_lng"), F.col("lat"), F.col("lng")), "dist"))


@query("geo02_within_radius", "SELECT request_id, poi_id, round(dist, 3) AS dist FROM v_near WHERE dist <= 1200")
def _(spark, sf):
    return search.within(V.requests(spark), search.with_week(V.poi(spark, sf)), 1200.0).select("request_id", "poi_id", R3(F.col("dist"), "dist"))


@query("jon13_range_join_counts", "SELECT request_id, count(*) AS n, count(DISTINCT area) AS areas FROM v_near GROUP BY request_id")
def _(spark, sf):
    return near(spark, sf).groupBy("request_id").agg(F.count("*").alias("n"), F.countDistinct("area").alias("areas"))


@query("geo03_nearest_k", f"SELECT request_id, poi_id, round(dist, 3) AS dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY dist, poi_id) AS rank FROM (SELECT *, {HAVERSINE} AS dist FROM v_request, v_poi)) WHERE rank <= 5")
def _(spark, sf):
    return nearest(V.requests(spark), V.poi(spark, sf), "request_id", 5, "poi_id").select("request_id", "poi_id", R3(F.col("dist"), "dist"), F.col("rank").cast("long").alias("rank"))


_EACH = "2 * 6371000 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))"


@query("geo04_nearest_places", f"SELECT id, poi_id, round(dist, 3) AS dist, rank FROM (SELECT a.poi_id AS id, b.poi_id, {_EACH} AS dist, row_number() OVER (PARTITION BY a.poi_id ORDER BY {_EACH}, b.poi_id) AS rank FROM v_poi a, v_poi b) WHERE rank <= 3")
def _(spark, sf):
    """The three nearest places of every place, itself included: as many points as places."""
    places = V.poi(spark, sf)
    points = places.select(F.col("poi_id").alias("id"), F.col("lat").alias("u_lat"), F.col("lng").alias("u_lng"))
    return nearest(points, places, "id", 3, "poi_id").select("id", "poi_id", R3(F.col("dist"), "dist"), F.col("rank").cast("long").alias("rank"))


_H = "(SELECT * FROM (SELECT *, 2 * 6371000 * asin(sqrt(pow(sin(radians(h_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(h_lat)) * pow(sin(radians(h_lng - lng) / 2), 2))) AS d FROM v_poi, v_hotspot) WHERE d <= 1000)"


def hotspot_of(spark, sf, places, metres=1000.0):
    """The nearest hotspot of each place within metres: poi_id, code, d. The hotspots are the small side of a range join."""
    points = V.hotspots(spark, sf).select("code", F.col("h_lat").alias("u_lat"), F.col("h_lng").alias("u_lng"))
    pairs = search.within(points, places, metres)
    return pairs.groupBy("poi_id").agg(F.min_by(F.struct("code", "dist"), F.struct("dist", "code")).alias("best")).select("poi_id", "best.code", F.col("best.dist").alias("d"))


@query("geo05_nearest_hotspot", f"SELECT request_id, arg_min(code, (d, code)) AS code, round(min(d), 3) AS d FROM (SELECT request_id, code, d FROM (SELECT *, 2 * 6371000 * asin(sqrt(pow(sin(radians(h_lat - u_lat) / 2), 2) + cos(radians(u_lat)) * cos(radians(h_lat)) * pow(sin(radians(h_lng - u_lng) / 2), 2))) AS d FROM (SELECT request_id, u_lat, u_lng FROM v_request), v_hotspot) WHERE d <= 1000) GROUP BY request_id")
def _(spark, sf):
    users = V.requests(spark).select(F.col("request_id").alias("poi_id"), F.col("u_lat").alias("lat"), F.col("u_lng").alias("lng"))
    return hotspot_of(spark, sf, users).select(F.col("poi_id").alias("request_id"), "code", R3(F.col("d"), "d"))


@query("geo06_poi_hotspot_map", f"SELECT p.poi_id, arg_min(code, (d, code)) AS code, round(min(d), 3) AS d FROM v_poi p LEFT JOIN {_H} h ON p.poi_id = h.poi_id GROUP BY p.poi_id")
def _(spark, sf):
    places = V.poi(spark, sf)
    return places.select("poi_id").join(hotspot_of(spark, sf, places), "poi_id", "left").select("poi_id", "code", R3(F.col("d"), "d"))


@query("snk10_hotspot_coverage", f"SELECT count(*) AS pois, count(code) AS mapped, round(avg(d), 3) AS mean_d, round(max(d), 3) AS max_d FROM (SELECT p.poi_id, arg_min(code, (d, code)) AS code, min(d) AS d FROM v_poi p LEFT JOIN {_H} h ON p.poi_id = h.poi_id GROUP BY p.poi_id)")
def _(spark, sf):
    places = V.poi(spark, sf)
    mapped = places.select("poi_id").join(hotspot_of(spark, sf, places), "poi_id", "left")
    return mapped.agg(F.count("*").alias("pois"), F.count("code").alias("mapped"), R3(F.avg("d"), "mean_d"), R3(F.max("d"), "max_d"))


@query("agg17_distance_sweep", f"SELECT b::DOUBLE AS bound, count(*) FILTER (WHERE d <= b) AS n, count(*) AS total FROM (SELECT p.poi_id, min(d) AS d FROM v_poi p LEFT JOIN {_H} h ON p.poi_id = h.poi_id GROUP BY p.poi_id), (SELECT unnest([30, 50, 60, 75, 100, 300]) AS b) GROUP BY b")
def _(spark, sf):
    """Places that a hotspot covers at growing distances."""
    places = V.poi(spark, sf)
    mapped = places.select("poi_id").join(hotspot_of(spark, sf, places), "poi_id", "left")
    return audits.sweep(mapped, F.col("d"), [30, 50, 60, 75, 100, 300], False)


@query("jon08_left_count", f"SELECT h.code, count(m.poi_id) AS n FROM v_hotspot h LEFT JOIN (SELECT poi_id, arg_min(code, (d, code)) AS code FROM {_H} GROUP BY poi_id) m ON h.code = m.code GROUP BY h.code")
def _(spark, sf):
    mapped = hotspot_of(spark, sf, V.poi(spark, sf)).groupBy("code").agg(F.count("*").alias("m"))
    return V.hotspots(spark, sf).select("code").join(mapped, "code", "left").select("code", F.coalesce("m", F.lit(0)).alias("n"))


@query("geo15_grid", """SELECT poi_id, CAST(floor(r * sin(t) + 43.5) AS BIGINT) AS nx, CAST(floor(r0 - r * cos(t) + 136.5) AS BIGINT) AS ny FROM (SELECT poi_id, re * f / pow(tan(pi() / 4 + radians(lat) / 2), n) AS r, re * f / pow(tan(pi() / 4 + radians(38) / 2), n) AS r0, (radians(lng) - radians(126)) * n AS t
 FROM v_poi, (SELECT 6371.00877 / 5.0 AS re, n, pow(tan(pi() / 4 + radians(30) / 2), n) * cos(radians(30)) / n AS f FROM (SELECT ln(cos(radians(30)) / cos(radians(60))) / ln(tan(pi() / 4 + radians(60) / 2) / tan(pi() / 4 + radians(30) / 2)) AS n)))""")
def _(spark, sf):
    nx, ny = C.grid(F.col("lat"), F.col("lng"))
    return V.poi(spark, sf).select("poi_id", nx.alias("nx"), ny.alias("ny"))


@query("geo16_zone_distance", f"SELECT request_id, poi_id, round(dist * {RESISTANCE}, 3) AS effective FROM v_near WHERE dist <= 800")
def _(spark, sf):
    return near(spark, sf).where("dist <= 800").select("request_id", "poi_id", R3(F.col("dist") * C.resistance(F.col("u_zone"), F.col("zone")), "effective"))


_A = " UNION ALL ".join(f"SELECT '{z}' AS a_zone, {p} AS u_lat, {q} AS u_lng" for z, (p, q) in K.ANCHORS.items())


@query("geo17_anchor_zone", f"SELECT poi_id, arg_min(a_zone, (dist, a_zone)) AS a_zone FROM (SELECT *, {HAVERSINE} AS dist FROM v_poi, ({_A})) GROUP BY poi_id")
def _(spark, sf):
    anchors = F.array(*(F.struct(C.haversine(F.lit(a), F.lit(b), F.col("lat"), F.col("lng")).alias("d"), F.lit(z).alias("z")) for z, (a, b) in K.ANCHORS.items()))
    return V.poi(spark, sf).select("poi_id", F.array_min(anchors)["z"].alias("a_zone"))


@query("geo18_coarsen", "SELECT poi_id, floor(lat * 1000 + 0.5) AS lat_m, floor(lng * 1000 + 0.5) AS lng_m FROM v_poi")
def _(spark, sf):
    return V.poi(spark, sf).select("poi_id", F.floor(F.col("lat") * 1000 + 0.5).cast("double").alias("lat_m"), F.floor(F.col("lng") * 1000 + 0.5).cast("double").alias("lng_m"))


_NAMED = lambda x: f"regexp_replace(lower({x}), '[^0-9a-z가-힣]', '', 'g')"


@query("geo14_near_duplicates", f"SELECT a.poi_id, arg_min(b.poi_id, (d, b.poi_id)) AS other, round(min(d), 3) AS d, min(d) <= 20 AS close_review, min(d) <= 100 AND arg_min({_NAMED("concat('Cafe No. ', b.k % 3)")}, (d, b.poi_id)) = {_NAMED("any_value(concat('CAFE-no ', a.k % 3))")} AS likely_duplicate FROM v_poi a, v_poi b, LATERAL (SELECT {_EACH} AS d) WHERE a.poi_id <> b.poi_id GROUP BY a.poi_id")
def _(spark, sf):
    """The nearest other place of each, by cells: a likely duplicate if it has the same normalised name and is at most 100 m away, one to
    look at if it is at most 20 m away."""
    places = V.poi(spark, sf)
    points = places.select(F.col("poi_id").alias("id"), F.col("lat").alias("u_lat"), F.col("lng").alias("u_lng"))
    pairs = nearest(points, places, "id", 2, "poi_id").where("id <> poi_id")
    best = pairs.groupBy(F.col("id").alias("poi_id")).agg(F.min(F.struct("dist", F.col("poi_id").alias("other"))).alias("best")).select("poi_id", "best.*")
    own = places.select("poi_id", F.concat(F.lit("CAFE-no "), F.col("k") % 3).alias("name"))
    other = places.select(F.col("poi_id").alias("other"), F.concat(F.lit("Cafe No. "), F.col("k") % 3).alias("existing"))
    same = C.normalised(F.col("name")) == C.normalised(F.col("existing"))
    return best.join(own.hint("merge"), "poi_id").join(other.hint("merge"), "other").select("poi_id", "other", R3(F.col("dist"), "d"), (F.col("dist") <= 20).alias("close_review"), (same & (F.col("dist") <= 100)).alias("likely_duplicate"))


@query("flt01_candidates", f"SELECT request_id, poi_id, round(dist, 3) AS dist FROM v_near WHERE dist <= 1200 AND confidence >= 0.3 AND {PASSES}")
def _(spark, sf):
    found = search.within(V.requests(spark), search.with_week(V.poi(spark, sf)), 1200.0).where(search.passes()).where(F.col("confidence") >= K.CONFIDENCE)
    return found.select("request_id", "poi_id", R3(F.col("dist"), "dist"))


STAGES = f"""SELECT r.request_id, CASE WHEN n0 >= 30 THEN 0 WHEN n1 >= 30 THEN 1 WHEN n2 >= 3 THEN 2 ELSE 3 END AS stage, n0, n1, n2, nr FROM v_request r LEFT JOIN (SELECT request_id,
 count(*) FILTER (WHERE dist <= 1200 AND confidence >= 0.3) AS n0, count(*) FILTER (WHERE dist <= 1920 AND confidence >= 0.3) AS n1, count(*) FILTER (WHERE confidence >= 0.3) AS n2, count(*) FILTER (WHERE confidence >= 0.15) AS nr
 FROM v_near WHERE {PASSES} GROUP BY request_id) s USING (request_id)"""


@query("flt02_relaxation_ladder", f"SELECT request_id, stage, CASE stage WHEN 0 THEN 1200.0 WHEN 1 THEN 1920.0 ELSE 3072.0 END::DOUBLE AS radius, (CASE WHEN stage = 3 THEN 0.15 ELSE 0.3 END)::DOUBLE AS confidence_min, coalesce(CASE stage WHEN 0 THEN n0 WHEN 1 THEN n1 WHEN 2 THEN n2 ELSE nr END, 0) AS n, coalesce(CASE stage WHEN 0 THEN n0 WHEN 1 THEN n1 WHEN 2 THEN n2 ELSE nr END, 0) < 30 AS low_confidence FROM ({STAGES})")
def _(spark, sf):
    requests = V.requests(spark)
    return search.ladder(requests, near(spark, sf).where(search.passes()))


LADDER = f"""SELECT c.*, s.stage, CASE s.stage WHEN 0 THEN n0 WHEN 1 THEN n1 WHEN 2 THEN n2 ELSE nr END AS n FROM (SELECT * FROM v_near WHERE {PASSES}) c JOIN ({STAGES}) s USING (request_id)
 WHERE dist <= CASE s.stage WHEN 0 THEN 1200 WHEN 1 THEN 1920 ELSE 3072 END AND confidence >= CASE WHEN s.stage = 3 THEN 0.15 ELSE 0.3 END"""
CHOSEN = f"""SELECT * EXCLUDE (n, r) FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY dist, poi_id) AS r FROM ({LADDER})) WHERE r <= 500 AND n >= 3
 UNION ALL SELECT * EXCLUDE (r) FROM (SELECT *, 4 AS stage, row_number() OVER (PARTITION BY request_id ORDER BY dist, poi_id) AS r FROM (SELECT *, {HAVERSINE} AS dist FROM v_request, v_poi) WHERE request_id IN (SELECT request_id FROM ({STAGES}) WHERE coalesce(CASE stage WHEN 3 THEN nr ELSE 3 END, 0) < 3)) WHERE r <= 3"""


@query("flt02_candidates_after_ladder", f"SELECT request_id, poi_id, stage, round(dist, 3) AS dist FROM ({CHOSEN})")
def _(spark, sf):
    return search.candidates(V.requests(spark), V.poi(spark, sf)).select("request_id", "poi_id", "stage", R3(F.col("dist"), "dist"))


@query("flt03_lenient_filter", f"SELECT request_id, count(*) AS n FROM v_near WHERE dist <= 1200 AND ({OPEN('hour * 60')}) AND coalesce(price, 2) <= budget AND coalesce(capacity, 99) >= party GROUP BY request_id HAVING count(*) >= 5")
def _(spark, sf):
    c = F.col
    ok = C.is_open_on(c("week"), c("day"), c("hour") * 60) & (F.coalesce("price", F.lit(2)) <= c("budget")) & (F.coalesce("capacity", F.lit(99)) >= c("party"))
    return search.within(V.requests(spark), search.with_week(V.poi(spark, sf)), 1200.0).where(ok).groupBy("request_id").agg(F.count("*").alias("n")).where("n >= 5")


@query("sco01_context_fit", f"SELECT request_id, poi_id, round({FIT}, 12) AS fit FROM v_near WHERE dist <= 900")
def _(spark, sf):
    c = F.col
    return near(spark, sf).where("dist <= 900").select("request_id", "poi_id", F.round(S.context_fit(c("exposure"), c("rain"), c("pm"), c("feels"), c("hour"), c("sunset"), c("sensitivity")), 12).alias("fit"))


_F = "(t * 9 / 5 + 32)"


@query("sco02_apparent_temp", f"""SELECT event_id, round(CASE WHEN t >= 27 AND rh IS NOT NULL THEN ((-42.379 + 2.04901523 * {_F} + 10.14333127 * rh - 0.22475541 * {_F} * rh - 6.83783e-3 * {_F} * {_F} - 5.481717e-2 * rh * rh + 1.22874e-3 * {_F} * {_F} * rh + 8.5282e-4 * {_F} * rh * rh - 1.99e-6 * {_F} * {_F} * rh * rh) - 32) * 5 / 9
 WHEN t <= 10 AND w >= 1.3 THEN 13.12 + 0.6215 * t - 11.37 * pow(w * 3.6, 0.16) + 0.3965 * t * pow(w * 3.6, 0.16) ELSE t END, 6) AS feels FROM (SELECT event_id, (event_id % 500) / 10.0 - 12 AS t, CASE WHEN event_id % 9 = 0 THEN NULL ELSE (event_id % 80 + 20)::DOUBLE END AS rh, CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id % 60) / 10.0 END AS w FROM events)""")
def _(spark, sf):
    rows = V.table(spark, sf, "events").selectExpr("event_id", "cast((event_id % 500) / 10.0D - 12 as double) t", "CASE WHEN event_id % 9 = 0 THEN NULL ELSE cast(event_id % 80 + 20 as double) END rh", "CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id % 60) / 10.0D END w")
    return rows.select("event_id", R6(S.apparent_temperature(F.col("t"), F.col("rh"), F.col("w")), "feels"))


@query("sco03_purpose_match", f"SELECT request_id, poi_id, {PURPOSE}::DOUBLE AS match FROM v_near WHERE dist <= 600")
def _(spark, sf):
    return near(spark, sf).where("dist <= 600").select("request_id", "poi_id", S.purpose_match(F.array_compact(F.array("tag1", "tag2")), F.col("purpose")).cast("double").alias("match"))


def embeddings(spark, sf, name="vec_id", vector="v"):
    return V.table(spark, sf, "embeddings").select(F.col("vec_id").alias(name), F.col("embedding").alias(vector))


COS = "list_cosine_similarity(uv.embedding::DOUBLE[], pv.embedding::DOUBLE[])"


@query("sco04_cosine", f"SELECT request_id, poi_id, round({COS}, 6) AS similarity FROM v_near c LEFT JOIN embeddings uv ON c.user_vec = uv.vec_id LEFT JOIN embeddings pv ON c.vec_id = pv.vec_id WHERE dist <= 500")
def _(spark, sf):
    rows = near(spark, sf).where("dist <= 500").join(embeddings(spark, sf), "vec_id", "left")
    rows = rows.join(embeddings(spark, sf, "user_vec", "u").join(V.requests(spark).select("user_vec").distinct(), "user_vec", "left_semi"), "user_vec", "left")
    return rows.select("request_id", "poi_id", R6(C.cosine(F.col("u"), F.col("v")), "similarity"))


_RATE = "(SELECT code, arg_max(level, (ts, event_id)) AS level, arg_max(struct_pack(r := rate20), (ts, event_id)).r AS rate FROM v_snapshot GROUP BY code)"


def latest(spark, sf):
    """Latest level and rate of each hotspot."""
    return V.snapshots(spark, sf).groupBy("code").agg(F.max_by(F.struct("level", "rate20"), F.struct("ts", "event_id")).alias("last")).select("code", "last.level", F.col("last.rate20").alias("rate"))


@query("sco08_live_match", f"SELECT request_id, round(CASE WHEN rate IS NULL THEN NULL ELSE {LIVE} END, 6) AS live FROM v_request LEFT JOIN {_RATE} USING (code)")
def _(spark, sf):
    return V.requests(spark).join(latest(spark, sf), "code", "left").select("request_id", R6(S.live_match(F.col("rate"), F.col("age_band")), "live"))


@query("sco09_crowd_fit", f"SELECT request_id, {CROWD}::DOUBLE AS crowd FROM v_request LEFT JOIN {_RATE} USING (code)")
def _(spark, sf):
    return V.requests(spark).join(latest(spark, sf), "code", "left").select("request_id", S.crowd_fit(F.col("level"), F.col("purpose")).alias("crowd"))


@query("sco11_distance_penalty", f"SELECT request_id, poi_id, round({PENALTY}, 6) AS penalty FROM v_near")
def _(spark, sf):
    return near(spark, sf).select("request_id", "poi_id", R6(S.distance_penalty(F.col("dist") * C.resistance(F.col("u_zone"), F.col("zone")), F.col("rain")), "penalty"))


AFFINITY = """(SELECT area, category, gender, age_band, weekend, band, (g / t) * (a / t) * (w / t) * (b / t) AS affinity, c * (g / t) * (a / t) * (w / t) * (b / t) AS weight FROM
 (SELECT area, category, sum(amount) AS t, count(*) AS c FROM v_sales GROUP BY ALL) JOIN (SELECT area, category, gender, sum(amount) AS g FROM v_sales GROUP BY ALL) USING (area, category)
 JOIN (SELECT area, category, age_band, sum(amount) AS a FROM v_sales GROUP BY ALL) USING (area, category) JOIN (SELECT area, category, weekend, sum(amount) AS w FROM v_sales GROUP BY ALL) USING (area, category)
 JOIN (SELECT area, category, band, sum(amount) AS b FROM v_sales GROUP BY ALL) USING (area, category))"""
# places know market segments, sales know part types: segment i stands for type i, both in code-point order
LINK = "(SELECT s.category AS segment, t.category AS type FROM (SELECT category, row_number() OVER (ORDER BY category) AS n FROM (SELECT DISTINCT c_mktsegment AS category FROM customer)) s JOIN (SELECT category, row_number() OVER (ORDER BY category) AS n FROM (SELECT DISTINCT p_type AS category FROM part)) t USING (n))"
BAND = "(CASE WHEN hour >= 21 THEN 5 WHEN hour >= 17 THEN 4 WHEN hour >= 14 THEN 3 WHEN hour >= 11 THEN 2 WHEN hour >= 6 THEN 1 ELSE 0 END)"
TERMS = f"""SELECT *, CASE WHEN affinity IS NULL OR ref IS NULL THEN 0.5 ELSE affinity / (affinity + ref) END AS t1, {PURPOSE} AS t2, coalesce(least(greatest(similarity, 0), 1), 0.5) AS t3_, similarity, {FIT} AS t4, coalesce(quality, 0.5) AS t5, CASE WHEN rate IS NULL THEN NULL ELSE {LIVE} END AS t6, {CROWD} AS t7, {PENALTY} AS penalty FROM (
 SELECT c.*, a.affinity, median(a.affinity) FILTER (WHERE a.affinity > 0) OVER (PARTITION BY c.request_id) AS ref, {COS} AS similarity, l.level, l.rate FROM ({CHOSEN}) c LEFT JOIN {LINK} k ON c.category = k.segment
 LEFT JOIN {AFFINITY} a ON a.area = c.area AND a.category = k.type AND a.gender = c.gender AND a.age_band = c.age_band AND a.weekend = c.dow AND a.band = {BAND}
 LEFT JOIN embeddings uv ON c.user_vec = uv.vec_id LEFT JOIN embeddings pv ON c.vec_id = pv.vec_id LEFT JOIN {_RATE} l USING (code))"""
BASE = "(0.22 * t1 + 0.22 * t2 + 0.16 * t3 + 0.13 * t4 + 0.09 * t5 + coalesce(0.10 * t6, 0) + coalesce(0.08 * t7, 0)) / (0.82 + CASE WHEN t6 IS NULL THEN 0 ELSE 0.10 END + CASE WHEN t7 IS NULL THEN 0 ELSE 0.08 END)"
SCORED = f"SELECT *, {BASE} AS base, least(greatest({BASE} - 0.05 * penalty, 0), 1) AS score FROM (SELECT *, CASE WHEN similarity IS NULL THEN 0.5 ELSE t3_ END AS t3 FROM ({TERMS}))"


def scored(spark, sf):
    """The flagship chain: candidates after the ladder, affinity, taste, live signals, terms and score. What is small and
    used by every candidate (a row a request, a row a segment) is written first, so that the planner knows its size."""
    from wayfold.operators import segments

    requests = V.requests(spark)
    found = search.candidates(requests, V.poi(spark, sf))
    names = lambda t, c, n: V.table(spark, sf, t).select(F.col(c).alias(n)).distinct()
    link = segments.paired(names("customer", "c_mktsegment", "segment"), "segment", names("part", "p_type", "type"), "type")
    link = written(link, "link")
    found = found.join(link, found["category"] == link["segment"], "left").drop("segment")
    # only the groups of types that a segment stands for are built
    wanted = link.select(F.col("type").alias("category"))
    affinity = segments.affinity(V.sales(spark, sf).join(wanted, "category", "left_semi")).select(F.col("area").alias("_a"), F.col("category").alias("_c"), F.col("gender").alias("_g"), F.col("age_band").alias("_b"), F.col("weekend").alias("_w"), F.col("band").alias("_h"), "affinity")
    c = F.col
    found = found.join(affinity, (c("area") == c("_a")) & (c("type") == c("_c")) & (c("gender") == c("_g")) & (c("age_band") == c("_b")) & (c("dow") == c("_w")) & (C.hour_band(c("hour")) == c("_h")), "left").drop("_a", "_c", "_g", "_b", "_w", "_h")
    users = embeddings(spark, sf, "user_vec", "u").join(requests.select("user_vec").distinct(), "user_vec", "left_semi")
    known = requests.select("request_id", "code", "user_vec").join(latest(spark, sf), "code", "left").join(users, "user_vec", "left")
    known = written(known.select("request_id", "level", "rate", "u"), "known")
    found = found.join(embeddings(spark, sf), "vec_id", "left").join(known, "request_id", "left")
    found = found.withColumn("similarity", C.cosine(c("u"), c("v"))).drop("u", "v")
    return ranking.scored(ranking.with_reference(found))


@query("sco10_renormalised", f"SELECT request_id, poi_id, round(base, 6) AS base FROM ({SCORED})")
def _(spark, sf):
    return scored(spark, sf).select("request_id", "poi_id", R6(F.col("base"), "base"))


@query("sco12_total_score", f"SELECT request_id, poi_id, round(score, 6) AS score, round(penalty, 6) AS penalty FROM ({SCORED})")
def _(spark, sf):
    return scored(spark, sf).select("request_id", "poi_id", R6(F.col("score"), "score"), R6(F.col("penalty"), "penalty"))


@query("sco06_segment_term", f"SELECT request_id, poi_id, round(t1, 6) AS segment FROM ({SCORED})")
def _(spark, sf):
    return scored(spark, sf).select("request_id", "poi_id", R6(F.col("segment_affinity"), "segment"))


@query("sco05_sco07_sco13_terms", f"SELECT request_id, poi_id, round(t3, 6) AS taste, round(t5, 6) AS quality, (t6 IS NOT NULL)::INT + (t7 IS NOT NULL)::INT AS live_terms FROM ({SCORED})")
def _(spark, sf):
    live = F.col("live_segment_match").isNotNull().cast("int") + F.col("crowd_fit").isNotNull().cast("int")
    return scored(spark, sf).select("request_id", "poi_id", R6(F.col("taste_similarity"), "taste"), F.round(S.quality_term(F.col("quality")), 6).alias("quality"), live.alias("live_terms"))


@query("agg18_request_median", f"SELECT request_id, round(any_value(ref), 9) AS ref, count(*) AS n FROM ({TERMS}) GROUP BY request_id")
def _(spark, sf):
    return scored(spark, sf).groupBy("request_id").agg(F.round(F.first("affinity_ref"), 9).alias("ref"), F.count("*").alias("n"))


TOP = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, poi_id) AS rank FROM ({SCORED})) WHERE rank <= 20"


@query("win11_top20", f"SELECT request_id, poi_id, rank, round(score, 6) AS score FROM ({TOP})")
def recommend(spark, sf):
    return ranking.top(scored(spark, sf)).select("request_id", "poi_id", F.col("rank").cast("long").alias("rank"), R6(F.col("score"), "score"))


PICKED = f"SELECT *, CASE WHEN rank IN (9, 3, 12) THEN (rank * 7) % 5 END AS pick FROM ({TOP})"


@query("win12_shown_set", f"SELECT request_id, poi_id, row_number() OVER (PARTITION BY request_id ORDER BY rank) AS place FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY pick NULLS LAST, rank) AS n FROM ({PICKED})) WHERE n <= 4")
def _(spark, sf):
    ranked = ranking.top(scored(spark, sf)).withColumn("pick", F.when(F.col("rank").isin(9, 3, 12), F.col("rank") * 7 % 5))
    return ranking.shown(ranked).select("request_id", "poi_id", F.col("place").cast("long").alias("place"))


@query("win13_exploration", f"SELECT request_id, poi_id, rank FROM (SELECT *, count(*) OVER (PARTITION BY request_id) AS size, row_number() OVER (PARTITION BY request_id ORDER BY rank) - 1 AS i FROM ({TOP}) WHERE rank BETWEEN 6 AND 20) WHERE i = ('0x' || substr(sha256(concat('seed', request_id)), 1, 15))::BIGINT % size")
def _(spark, sf):
    return ranking.exploration(ranking.top(scored(spark, sf)), F.concat(F.lit("seed"), F.col("request_id"))).select("request_id", "poi_id", F.col("rank").cast("long").alias("rank"))


@query("str17_reason", f"""SELECT request_id, poi_id, CASE WHEN r = '' THEN 'A good match nearby' ELSE r END AS reason FROM (SELECT request_id, poi_id, concat_ws('. ', CASE WHEN tag1 = purpose THEN concat(purpose, ' fits') END, CASE WHEN rain > 0.5 AND exposure <= 0.3 THEN 'indoors in the rain' END,
 CASE WHEN quality >= 0.7 THEN 'well reviewed' END, CASE WHEN dist <= 500 THEN 'a short walk' END, CASE WHEN price <= budget THEN 'within budget' END) AS r FROM v_near WHERE dist <= 900)""")
def _(spark, sf):
    return near(spark, sf).where("dist <= 900").select("request_id", "poi_id", ranking.reason().alias("reason"))


@query("jsn06_log_rows", f"SELECT request_id, count(*) AS n, min(rank) AS first_rank, string_agg(poi_id, ',' ORDER BY rank) AS ids FROM ({TOP}) GROUP BY request_id")
def _(spark, sf):
    listed = F.array_sort(F.collect_list(F.struct(F.col("rank").cast("long").alias("rank"), "poi_id", "score", "penalty")))
    logs = ranking.top(scored(spark, sf)).groupBy("request_id").agg(listed.alias("candidates"))
    return logs.select("request_id", F.size("candidates").cast("long").alias("n"), F.get("candidates", F.lit(0))["rank"].alias("first_rank"), F.concat_ws(",", F.col("candidates.poi_id")).alias("ids"))
