"""Segments, city signals, evidence, vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfold import constants as K
from wayfold.functions import columns as C
from wayfold.functions import scoring as S
from wayfold.operators import segments, signals
from wayfold.plans.registry import query
from wayfold.plans.retrieval import AFFINITY, COS, OPEN, R6, embeddings
from wayfold.sources import views as V


@query("agg02_sales_sums", "SELECT area, category, round(sum(amount), 2) AS total, count(*) AS n FROM v_sales GROUP BY area, category")
def _(spark, sf):
    return V.sales(spark, sf).groupBy("area", "category").agg(F.round(F.sum("amount"), 2).alias("total"), F.count("*").alias("n"))


@query("agg03_affinity", f"SELECT area, category, gender, age_band, weekend, band, round(affinity, 9) AS affinity, round(weight, 6) AS weight FROM {AFFINITY}")
def _(spark, sf):
    return segments.affinity(V.sales(spark, sf)).withColumn("affinity", F.round("affinity", 9)).withColumn("weight", F.round("weight", 6))


@query("agg04_affinity_invariants", f"SELECT area, category, count(*) AS cells, round(sum(affinity), 6) AS total, abs(sum(affinity) - 1) <= 1e-6 AS ok FROM {AFFINITY} GROUP BY area, category")
def _(spark, sf):
    return segments.invariants(segments.affinity(V.sales(spark, sf))).select("area", "category", "cells", R6(F.col("total"), "total"), "ok")


@query("agg01_affinity_lookup", f"SELECT area, category, round(avg(affinity), 9) AS affinity FROM {AFFINITY} WHERE gender = 'F' AND age_band = 20 AND weekend = 0 AND band IN (1, 2) GROUP BY area, category")
def _(spark, sf):
    rows = segments.affinity(V.sales(spark, sf)).where("gender = 'F' AND age_band = 20 AND weekend = 0 AND band IN (1, 2)")
    return rows.groupBy("area", "category").agg(F.round(F.avg("affinity"), 9).alias("affinity"))


@query("agg23_affinity_gaps", "SELECT CASE WHEN a.area IS NULL THEN 'area missing' WHEN g.area IS NULL THEN 'pair missing' ELSE 'covered' END AS gap, count(*) AS pois FROM v_poi p LEFT JOIN (SELECT DISTINCT area FROM v_sales WHERE area % 3 <> 0) a ON p.area = a.area LEFT JOIN (SELECT DISTINCT area, weekend FROM v_sales WHERE area % 3 <> 0 AND band = 1 AND age_band = 30 AND gender = 'M') g ON p.area = g.area AND p.k % 2 = g.weekend GROUP BY 1")
def _(spark, sf):
    sales = V.sales(spark, sf).where("area % 3 <> 0")
    areas = sales.select(F.col("area").alias("_a")).distinct()
    pairs = sales.where("band = 1 AND age_band = 30 AND gender = 'M'").select(F.col("area").alias("_b"), "weekend").distinct()
    rows = V.poi(spark, sf).join(areas, F.col("area") == F.col("_a"), "left").join(pairs, (F.col("area") == F.col("_b")) & (F.col("k") % 2 == F.col("weekend")), "left")
    gap = F.when(F.col("_a").isNull(), "area missing").when(F.col("_b").isNull(), "pair missing").otherwise("covered")
    return rows.groupBy(gap.alias("gap")).agg(F.count("*").alias("pois"))


@query("jon05_poi_affinity_join", "SELECT count(DISTINCT p.poi_id) AS pois FROM v_poi p JOIN (SELECT DISTINCT area FROM v_sales WHERE gender = 'F' AND age_band = 20 AND weekend = 1 AND band = 3) s USING (area)")
def _(spark, sf):
    areas = V.sales(spark, sf).where("gender = 'F' AND age_band = 20 AND weekend = 1 AND band = 3").select("area").distinct()
    return V.poi(spark, sf).join(areas, "area", "left_semi").agg(F.countDistinct("poi_id").alias("pois"))


@query("win01_latest_snapshot", "SELECT code, arg_max(level, (ts, event_id)) AS level, max(ts) AS ts FROM v_snapshot GROUP BY code")
def _(spark, sf):
    return signals.latest(V.snapshots(spark, sf), "code", ["ts", "event_id"], ["level", "ts"]).select("code", "level", "ts")


@query("jon01_latest_with_name", "SELECT code, hotspot, max(ts) AS ts FROM v_snapshot JOIN v_hotspot USING (code) GROUP BY code, hotspot")
def _(spark, sf):
    last = signals.latest(V.snapshots(spark, sf), "code", ["ts", "event_id"], ["ts"])
    return last.join(F.broadcast(V.hotspots(spark, sf)), "code").select("code", "hotspot", "ts")


_SLOTS = "(SELECT code, epoch(date_trunc('hour', ts))::BIGINT AS s, min(level) AS level FROM v_snapshot GROUP BY ALL)"


@query("jon14_asof_forecast", f"""SELECT a.event_id, arg_min(s.level, (abs(s.s - floor(epoch(a.ts))), s.s)) AS level FROM v_snapshot a LEFT JOIN {_SLOTS} s
 ON a.code = s.code AND s.s BETWEEN floor(epoch(a.ts)) - 5400 AND floor(epoch(a.ts)) + 5400 GROUP BY a.event_id""")
def _(spark, sf):
    """Every snapshot with the hourly slot of its place that is nearest in time, at most 90 minutes off."""
    rows = V.snapshots(spark, sf)
    slots = rows.groupBy("code", F.date_trunc("hour", "ts").alias("slot")).agg(F.min("level").alias("level"))
    return signals.as_of(rows.select("event_id", "code", "ts"), slots, "code", "ts", "slot", 5400, ["level"]).select("event_id", "level")


@query("stm04_freshness", "SELECT code, count(DISTINCT ts) FILTER (ts > now - INTERVAL 6 HOUR) AS slots, max(ts) AS last_at, count(DISTINCT ts) FILTER (ts > now - INTERVAL 6 HOUR) >= 12 AND max(ts) >= any_value(now) - INTERVAL 90 MINUTE AS fresh FROM v_snapshot, (SELECT max(ts) + INTERVAL 20 MINUTE AS now FROM v_snapshot) WHERE ts <= now GROUP BY code")
def _(spark, sf):
    rows = V.snapshots(spark, sf)
    now = rows.agg((F.max("ts") + F.expr("INTERVAL 20 MINUTES")).alias("now"))
    return signals.freshness(rows, now, "code", "ts", hours=6, slots=12, minutes=90)


@query("tim10_staleness", "SELECT code, epoch(TIMESTAMP '2024-01-31' - max(ts)) > 5400 AS stale FROM v_snapshot GROUP BY code")
def _(spark, sf):
    last = V.snapshots(spark, sf).groupBy("code").agg(F.max("ts").alias("last_at"))
    return last.select("code", (F.unix_micros(F.lit("2024-01-31").cast("timestamp")) - F.unix_micros(F.col("last_at").cast("timestamp")) > 5400 * 1_000_000).alias("stale"))


@query("stm05_sliding_count", "SELECT user_id, max(hits) AS most, count(*) FILTER (WHERE hits > 2) AS limited FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS hits FROM events) GROUP BY user_id")
def _(spark, sf):
    rows = signals.sliding_counts(V.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", 3600)
    return rows.groupBy("user_id").agg(F.max("hits").alias("most"), F.count_if(F.col("hits") > 2).alias("limited"))


@query("stm06_daily_quota", "SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS calls, count(*) > 5 AS spent FROM events GROUP BY ALL")
def _(spark, sf):
    return V.table(spark, sf, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("calls"), (F.count("*") > 5).alias("spent"))


_DUAL = "CASE WHEN event_id % 2 = 0 THEN concat('{\"population\":[{\"FCST_TIME\":\"t', event_id % 24, '\",\"FCST_CONGEST_LVL\":\"x\",\"FCST_PPLTN_MIN\":\"', event_id, '\",\"FCST_PPLTN_MAX\":\"9\"}]}') ELSE concat('[{\"FCST_TIME\":\"t', event_id % 24, '\",\"FCST_CONGEST_LVL\":\"x\",\"FCST_PPLTN_MIN\":\"', event_id, '\",\"FCST_PPLTN_MAX\":\"9\"}]') END"


@query("jsn03_dual_shape", "SELECT event_id, concat('t', event_id % 24) AS slot, CAST(event_id AS DOUBLE) AS people FROM events")
def _(spark, sf):
    rows = V.table(spark, sf, "events").selectExpr("event_id", f"{_DUAL} AS fcst".replace('\\"', '"'))
    first = F.get(signals.people_forecast(F.col("fcst")), F.lit(0))
    return rows.select("event_id", first["FCST_TIME"].alias("slot"), first["FCST_PPLTN_MIN"].try_cast("double").alias("people"))


_WEATHER = "concat('{\"', CASE WHEN event_id % 2 = 0 THEN 'TEMP' ELSE 'temp' END, '\":\"', CASE WHEN event_id % 7 = 0 THEN '-' ELSE concat(event_id % 40, '.5') END, '\",\"PRECIPITATION\":\"', CASE WHEN event_id % 3 = 0 THEN '1.5mm' ELSE '-' END, '\",\"PM25\":\"', event_id % 100, '\"}')"


@query("jsn01_snapshot_parse", "SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, event_type FROM events")
def _(spark, sf):
    parsed = F.from_json("props", "k long")
    return V.table(spark, sf, "events").select("event_id", parsed["k"].alias("k"), "event_type")


@query("jsn02_weather_parse", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id % 40) + 0.5 END::DOUBLE AS t, CASE WHEN event_id % 3 = 0 THEN 1.5 END::DOUBLE AS rain_mm, (CASE WHEN event_id % 100 <= 15 THEN 1 WHEN event_id % 100 <= 35 THEN 2 WHEN event_id % 100 <= 75 THEN 3 ELSE 4 END) AS pm FROM events")
def _(spark, sf):
    rows = V.table(spark, sf, "events").selectExpr("event_id", f"{_WEATHER} AS w")
    w = signals.weather_fields(F.col("w"))
    return rows.select("event_id", C.first_number(w["temp"]).alias("t"), C.first_number(w["precipitation"]).alias("rain_mm"), C.pm_grade(C.first_number(w["pm25"])).alias("pm"))


@query("jsn05_kma_pivot", "SELECT user_id, max(value) FILTER (WHERE event_type = 'click') AS clicks, max(value) FILTER (WHERE event_type = 'purchase') AS spent FROM events GROUP BY user_id")
def _(spark, sf):
    items = V.table(spark, sf, "events").select("user_id", F.col("event_type").alias("category"), "value")
    return signals.long_to_slot(items, ["user_id"], {"click": "clicks", "purchase": "spent"})


_AIR = "event_id, CASE WHEN event_id % 3 > 0 THEN (event_id * 7) % 120 - 20 END AS pm25, CASE WHEN event_id % 2 = 0 THEN event_id % 400 - 20 END AS pm10, CASE event_id % 5 WHEN 0 THEN '좋음' WHEN 1 THEN '보통' WHEN 2 THEN '나쁨' WHEN 3 THEN '매우나쁨' ELSE '점검중' END AS word"
_BY = lambda v, a, b, c: f"CASE WHEN {v} < 0 THEN NULL WHEN {v} <= {a} THEN 1 WHEN {v} <= {b} THEN 2 WHEN {v} <= {c} THEN 3 WHEN {v} IS NOT NULL THEN 4 END"


@query("sco14_pm_grade", f"SELECT event_id, coalesce({_BY('pm25', *K.PM25_BOUNDS)}, {_BY('pm10', *K.PM10_BOUNDS)}, CASE word WHEN '좋음' THEN 1 WHEN '보통' THEN 2 WHEN '나쁨' THEN 3 WHEN '매우나쁨' THEN 4 END) AS grade FROM (SELECT {_AIR} FROM events)")
def _(spark, sf):
    rows = V.table(spark, sf, "events").selectExpr(*_AIR.split(", "))
    return rows.select("event_id", C.air_grade(F.col("pm25"), F.col("pm10"), F.col("word")).alias("grade"))


_SKY_ROW = "event_id, user_id, (event_id * 13) % 101 / 100e0 AS rain, 1 + event_id % 4 AS pm, value - 10 AS feels, 1 + user_id % 7 AS party"


@query("sco15_weather_state", f"SELECT event_id, CASE WHEN rain > 0.3 THEN '{K.WEATHER_STATES[1]}' WHEN pm >= 3 THEN '{K.WEATHER_STATES[2]}' WHEN feels > 31 OR feels < -5 THEN '{K.WEATHER_STATES[3]}' ELSE '{K.WEATHER_STATES[0]}' END AS state, CASE WHEN party <= 2 THEN 1 WHEN party <= 4 THEN 2 ELSE 3 END AS party_band FROM (SELECT {_SKY_ROW} FROM events)")
def _(spark, sf):
    c = F.col
    rows = V.table(spark, sf, "events").selectExpr(*_SKY_ROW.split(", "))
    return rows.select("event_id", S.weather_state(c("rain"), c("pm"), c("feels")).alias("state"), C.party_band(c("party")).alias("party_band"))


@query("sco19_number_parse", "SELECT page_id, TRY_CAST(NULLIF(regexp_extract(url, '-?[0-9]+(?:\\.[0-9]+)?'), '') AS DOUBLE) AS number FROM pages")
def _(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", C.first_number(F.col("url")).alias("number"))


@query("str18_weather_label", f"SELECT event_id, CASE WHEN rain >= 0.99 THEN '{K.WEATHER_STATES[1]}' WHEN rain >= 0.3 THEN concat('{K.WEATHER_STATES[1]} ', CAST(floor(rain * 100 + 0.5) AS INT), '%') ELSE '{K.WEATHER_STATES[0]}' END AS label FROM (SELECT {_SKY_ROW} FROM events)")
def _(spark, sf):
    rain = F.col("rain")
    label = F.when(rain >= 0.99, K.WEATHER_STATES[1]).when(rain >= 0.3, F.concat(F.lit(f"{K.WEATHER_STATES[1]} "), F.floor(rain * 100 + 0.5).cast("int"), F.lit("%"))).otherwise(K.WEATHER_STATES[0])
    return V.table(spark, sf, "events").selectExpr(*_SKY_ROW.split(", ")).select("event_id", label.alias("label"))


@query("str19_age_top", "SELECT event_id, concat(10 * (1 + CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END), '대 ', greatest(a, b, c), '%') AS label FROM (SELECT event_id, event_id % 31 AS a, event_id % 37 AS b, event_id % 41 AS c FROM events)")
def _(spark, sf):
    rows = V.table(spark, sf, "events").selectExpr("event_id", "map('10', event_id % 31, '20', event_id % 37, '30', event_id % 41) AS rates")
    top = F.get(F.array_sort(F.transform(F.map_entries("rates"), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))), F.lit(0))
    return rows.select("event_id", F.concat(top["k"], F.lit("대 "), -top["v"], F.lit("%")).alias("label"))


_KNOWN = "(SELECT chunk_id, poi_id, sponsored, written, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS sim FROM v_review r LEFT JOIN embeddings e ON r.vec_id = e.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 11) q)"


def known(spark, sf):
    """Reviews with their similarity to the query vector (null without a vector)."""
    rows = V.reviews(spark, sf).join(embeddings(spark, sf), "vec_id", "left")
    q = V.table(spark, sf, "embeddings").where("vec_id = 11").select(F.col("embedding").alias("q"))
    return rows.crossJoin(F.broadcast(q)).withColumn("sim", C.cosine(F.col("v"), F.col("q"))).drop("v", "q")


def evidence(rows, order, n=3):
    w = Window.partitionBy("poi_id").orderBy(*order)
    return rows.withColumn("n", F.row_number().over(w).cast("long")).where(F.col("n") <= n)


RECENT = lambda: [F.col("sponsored"), F.col("written").desc_nulls_last(), F.col("chunk_id").desc()]
_RECENT = "sponsored, written DESC NULLS LAST, chunk_id DESC"
_VECTOR = "sponsored, round(sim, 9) DESC, chunk_id DESC"
VECTOR = lambda: [F.col("sponsored"), F.round("sim", 9).desc(), F.col("chunk_id").desc()]


@query("win02_evidence_vector", f"SELECT poi_id, chunk_id, n FROM (SELECT *, row_number() OVER (PARTITION BY poi_id ORDER BY {_VECTOR}) AS n FROM {_KNOWN} WHERE sim IS NOT NULL) WHERE n <= 3")
def _(spark, sf):
    return evidence(known(spark, sf).where("sim IS NOT NULL"), VECTOR()).select("poi_id", "chunk_id", "n")


@query("win03_evidence_recent", f"SELECT poi_id, chunk_id, n FROM (SELECT *, row_number() OVER (PARTITION BY poi_id ORDER BY {_RECENT}) AS n FROM v_review) WHERE n <= 3")
def _(spark, sf):
    return evidence(V.reviews(spark, sf), RECENT()).select("poi_id", "chunk_id", "n")


@query("win04_evidence_hybrid", f"SELECT poi_id, chunk_id, n, source FROM (SELECT *, 'vector' AS source, row_number() OVER (PARTITION BY poi_id ORDER BY {_VECTOR}) AS n FROM {_KNOWN} WHERE sim IS NOT NULL UNION ALL SELECT *, 'recent' AS source, row_number() OVER (PARTITION BY poi_id ORDER BY {_RECENT}) AS n FROM {_KNOWN} WHERE poi_id NOT IN (SELECT poi_id FROM {_KNOWN} WHERE sim IS NOT NULL)) WHERE n <= 3")
def _(spark, sf):
    rows = known(spark, sf)
    vector = evidence(rows.where("sim IS NOT NULL"), VECTOR()).withColumn("source", F.lit("vector"))
    rest = rows.join(vector.select("poi_id").distinct(), "poi_id", "left_anti")
    recent = evidence(rest, RECENT()).withColumn("source", F.lit("recent"))
    return vector.unionByName(recent).select("poi_id", "chunk_id", "n", "source")


@query("jon07_detail_reviews", f"SELECT p.poi_id, coalesce(ids, '') AS ids FROM v_poi p LEFT JOIN (SELECT poi_id, string_agg(chunk_id, ',' ORDER BY n) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY poi_id ORDER BY {_RECENT}) AS n FROM v_review) WHERE n <= 5 GROUP BY poi_id) USING (poi_id)")
def _(spark, sf):
    listed = evidence(V.reviews(spark, sf), RECENT(), 5).groupBy("poi_id").agg(F.array_sort(F.collect_list(F.struct("n", "chunk_id"))).alias("top"))
    return V.poi(spark, sf).join(listed, "poi_id", "left").select("poi_id", F.coalesce(F.concat_ws(",", F.col("top.chunk_id").cast("array<string>")), F.lit("")).alias("ids"))


def mean_vectors(rows, key, vector="v", dims=64):
    """Mean vector and number of rows of each key, by position: sums of fixed width, combined map-side."""
    sums = [F.avg(F.get(vector, F.lit(i)).cast("double")).alias(f"_{i}") for i in range(dims)]
    return rows.groupBy(key).agg(*sums, F.count("*").alias("n")).select(key, F.array(*(F.col(f"_{i}") for i in range(dims))).alias("mean"), "n")


@query("agg20_taste_vector", "SELECT label, count(*) AS n, round(avg(embedding[1]), 6) AS first, round(avg(embedding[64]), 6) AS last FROM embeddings GROUP BY label")
def _(spark, sf):
    rows = mean_vectors(V.table(spark, sf, "embeddings").withColumnRenamed("embedding", "v"), "label")
    return rows.select("label", "n", R6(F.get("mean", F.lit(0)), "first"), R6(F.get("mean", F.lit(63)), "last"))


@query("agg21_tag_vector", "SELECT tag1, round(m / sqrt(list_sum([x * x FOR x IN ms])), 6) AS first, n FROM (SELECT tag1, avg(embedding[1]) AS m, count(*) AS n, [" + ", ".join(f"avg(embedding[{i}])" for i in range(1, 65)) + "] AS ms FROM v_poi JOIN embeddings USING (vec_id) WHERE tag1 IS NOT NULL GROUP BY tag1)")
def _(spark, sf):
    rows = mean_vectors(V.poi(spark, sf).where("tag1 IS NOT NULL").join(embeddings(spark, sf), "vec_id"), "tag1")
    norm = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x * x))
    return rows.select("tag1", R6(F.get("mean", F.lit(0)) / norm, "first"), "n")


@query("jon16_tag_join", "SELECT tag, count(*) AS pois, count(DISTINCT vec_id) AS vectors FROM (SELECT unnest([tag1, tag2]) AS tag, vec_id FROM v_poi) WHERE tag IS NOT NULL GROUP BY tag")
def _(spark, sf):
    return V.poi(spark, sf).select(F.explode(F.array_compact(F.array("tag1", "tag2"))).alias("tag"), "vec_id").groupBy("tag").agg(F.count("*").alias("pois"), F.countDistinct("vec_id").alias("vectors"))


@query("jon12_query_grid", "SELECT purpose, zone, price, concat(purpose, ' ', zone, ' ', price) AS sentence, n FROM (SELECT DISTINCT tag1 AS purpose FROM v_poi WHERE tag1 IS NOT NULL), (SELECT DISTINCT zone FROM v_poi), (SELECT DISTINCT price FROM v_poi WHERE price IS NOT NULL) LEFT JOIN (SELECT tag1, zone AS z, price AS p, count(*) AS n FROM v_poi GROUP BY ALL) c ON c.tag1 = purpose AND c.z = zone AND c.p = price")
def _(spark, sf):
    """Every purpose, zone and price band that occurs, with every other, and how many places each cell has."""
    rows = V.poi(spark, sf)
    axes = rows.agg(*(F.collect_set(c).alias(c) for c in ("tag1", "zone", "price")))  # vocabularies of a handful of values
    grid = axes.select(F.explode("tag1").alias("purpose"), "zone", "price").select("purpose", F.explode("zone").alias("zone"), "price").select("purpose", "zone", F.explode("price").alias("price"))
    counts = rows.groupBy(F.col("tag1").alias("purpose"), "zone", "price").agg(F.count("*").alias("n"))
    return grid.join(counts, ["purpose", "zone", "price"], "left").withColumn("sentence", F.concat_ws(" ", "purpose", "zone", F.col("price").cast("string")))


@query("agg19_age_baseline", "SELECT code, round(sum(rate20 * people) / sum(people), 6) AS rate FROM v_snapshot WHERE rate20 IS NOT NULL GROUP BY code")
def _(spark, sf):
    return V.snapshots(spark, sf).where("rate20 IS NOT NULL").groupBy("code").agg(F.round(F.sum(F.col("rate20") * F.col("people")) / F.sum("people"), 6).alias("rate"))


_INSTANTS = ("2024-01-05 00:29:00", "2024-01-05 00:30:00", "2024-01-05 17:15:00", "2024-01-06 01:00:00", "2024-01-06 13:00:00", "2024-01-06 21:30:00", "2024-01-07 02:30:00", "2024-01-07 23:59:00", "2024-01-09 09:00:00", "2024-01-10 12:00:00")
_LOCAL = f"(SELECT instant, {C.DAYS}[dayofweek(instant + INTERVAL 9 HOUR) + 1] AS day, hour(instant + INTERVAL 9 HOUR) * 60 + minute(instant + INTERVAL 9 HOUR) AS m FROM (SELECT unnest({list(_INSTANTS)})::TIMESTAMP AS instant))".replace("('sun'", "['sun'").replace("'sat')", "'sat']")


@query("tim02_is_open_at", f"SELECT poi_id, CAST(instant AS VARCHAR) AS instant, {OPEN('m')} AS is_open FROM v_poi, {_LOCAL}")
def _(spark, sf):
    rows = V.poi(spark, sf).withColumn("instant", F.explode(F.array(*map(F.lit, _INSTANTS))))
    return rows.select("poi_id", "instant", C.is_open_at(F.col("hours"), F.col("instant").cast("timestamp")).alias("is_open"))


@query("tim03_day_key", f"SELECT event_id, {C.DAYS}[dayofweek(ts + INTERVAL 9 HOUR) + 1] AS day FROM events".replace("('sun'", "['sun'").replace("'sat')", "'sat']"))
def _(spark, sf):
    return V.table(spark, sf, "events").select("event_id", C.day_key(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Seoul")).alias("day"))


@query("tim04_hour_band", "SELECT event_id, CASE WHEN hour(ts) >= 21 THEN 5 WHEN hour(ts) >= 17 THEN 4 WHEN hour(ts) >= 14 THEN 3 WHEN hour(ts) >= 11 THEN 2 WHEN hour(ts) >= 6 THEN 1 ELSE 0 END AS band FROM events")
def _(spark, sf):
    return V.table(spark, sf, "events").select("event_id", C.hour_band(F.hour("ts")).alias("band"))


@query("tim05_dow_type", "SELECT o_orderkey, CASE WHEN isodow(o_orderdate) >= 6 THEN 1 ELSE 0 END AS dow_type FROM orders")
def _(spark, sf):
    return V.table(spark, sf, "orders").select("o_orderkey", C.dow_type(F.col("o_orderdate")).alias("dow_type"))


@query("tim08_publish_slot", "SELECT event_id, CASE WHEN hour(t) < 2 THEN concat(strftime(t - INTERVAL 1 DAY, '%Y%m%d'), ' 2300') ELSE concat(strftime(t, '%Y%m%d'), ' ', lpad(CAST(((hour(t) - 2) // 3) * 3 + 2 AS VARCHAR), 2, '0'), '00') END AS slot FROM (SELECT event_id, ts - INTERVAL 15 MINUTE AS t FROM events)")
def _(spark, sf):
    return V.table(spark, sf, "events").select("event_id", C.publish_slot(F.col("ts")).alias("slot"))


@query("tim09_use_forecast", "SELECT event_id, epoch(TIMESTAMP '2024-01-15' - ts) >= 10800 AS use_forecast FROM events")
def _(spark, sf):
    lead = F.unix_micros(F.lit("2024-01-15").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return V.table(spark, sf, "events").select("event_id", (lead >= 10800 * 1_000_000).alias("use_forecast"))


@query("tim06_forecast_time", "SELECT event_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS at FROM events")
def _(spark, sf):
    # the three formats of forecast times; seconds are cut
    text = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyyMMddHHmm")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    t = F.coalesce(F.try_to_timestamp(text, F.lit("yyyyMMddHHmm")), F.try_to_timestamp(F.substring(text, 1, 16), F.lit("yyyy-MM-dd HH:mm")), F.try_to_timestamp(F.substring(text, 1, 16), F.lit("yyyy-MM-dd'T'HH:mm")))
    return V.table(spark, sf, "events").select("event_id", F.date_format(t, "yyyy-MM-dd HH:mm").alias("at"))


@query("tim11_next_occurrence", "SELECT event_id, CAST(CAST(CASE WHEN c > ts THEN c ELSE c + INTERVAL 7 DAY END AS DATE) AS VARCHAR) AS day FROM (SELECT event_id, ts, date_trunc('day', ts) + to_days(CAST((event_id % 7 - (isodow(ts) - 1) + 7) % 7 AS INT)) + INTERVAL 12 HOUR AS c FROM events)")
def _(spark, sf):
    ahead = F.pmod(F.col("event_id") % 7 - F.weekday("ts"), F.lit(7)).cast("int")
    day = F.date_add("ts", ahead)
    at = day.cast("timestamp") + F.expr("interval 12 hours")
    return V.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", F.when(at > F.col("ts"), day).otherwise(F.date_add(day, 7)).cast("string").alias("day"))


@query("tim12_sunset_hour", "SELECT event_id, CASE WHEN event_id % 30 <= 23 THEN event_id % 30 ELSE 19 END AS sunset FROM events")
def _(spark, sf):
    text = F.concat((F.col("event_id") % 30).cast("string"), F.lit(":42"))
    h = F.regexp_extract(text, r"^\s*(\d{1,2})", 1).try_cast("int")
    return V.table(spark, sf, "events").select("event_id", F.when(h.between(0, 23), h).otherwise(19).cast("long").alias("sunset"))
