"""Time texts, context merges, JSON nullness, key reports, incremental unions, rounding, file round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions import columns as C
from wayfold.functions.rounding import rounded, rounded_sql
from wayfold.operators import merges
from wayfold.plans.registry import query
from wayfold.plans.retrieval import SCORED, scored
from wayfold.sources import files
from wayfold.sources import views as V
from wayfold.sources.work import work_path

NOW = "2024-02-01 00:00:00"


@query("tim01_iso_time", f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN floor(epoch(ts)) WHEN 3 THEN epoch(TIMESTAMP '{NOW}') ELSE floor(epoch(ts)) - 32400 END::BIGINT AS at FROM events")
def _(spark, sf):
    """ISO texts: with Z, with an offset, without (then Korean time), and broken (then now)."""
    plain = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("event_id") % 4 == 0, F.concat(plain, F.lit("Z"))).when(F.col("event_id") % 4 == 1, F.concat(plain, F.lit("+09:00"))).when(F.col("event_id") % 4 == 2, plain).otherwise("soon")
    return V.table(spark, sf, "events").select("event_id", F.unix_timestamp(C.iso_time(text, F.lit(NOW).cast("timestamp"))).alias("at"))


@query("tim07_poll_time", f"SELECT event_id, CASE WHEN event_id % 5 = 0 THEN epoch(TIMESTAMP '{NOW}') ELSE epoch(date_trunc('minute', ts)) - 32400 END::BIGINT AS at FROM events")
def _(spark, sf):
    text = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm"))
    return V.table(spark, sf, "events").select("event_id", F.unix_timestamp(C.poll_time(text, F.lit(NOW).cast("timestamp"))).alias("at"))


_SKY = "(SELECT code, epoch(date_trunc('hour', ts))::BIGINT AS s, concat('sky ', max(event_id % 4)) AS sky FROM v_snapshot GROUP BY ALL)"


@query("jsn04_sky_label", f"""SELECT a.event_id, coalesce(CASE WHEN event_id % 3 <> 0 THEN 'live' END, CASE WHEN event_id % 2 = 0 THEN arg_min(k.sky, (abs(k.s - floor(epoch(a.ts))), k.s)) END) AS sky
 FROM v_snapshot a LEFT JOIN {_SKY} k ON a.code = k.code AND k.s BETWEEN floor(epoch(a.ts)) - 5400 AND floor(epoch(a.ts)) + 5400 GROUP BY a.event_id""")
def _(spark, sf):
    """The live label, or that of the nearest forecast slot where there is none and it rains less than 1 mm."""
    from wayfold.operators import signals

    rows = V.snapshots(spark, sf).withColumn("live", F.when(F.col("event_id") % 3 != 0, "live")).withColumn("rain_mm", (F.col("event_id") % 2).cast("double"))
    slots = rows.groupBy("code", F.date_trunc("hour", "ts").alias("slot")).agg(F.concat(F.lit("sky "), F.max(F.col("event_id") % 4).cast("string")).alias("sky"))
    near = signals.as_of(rows.select("event_id", "code", "ts", "live", "rain_mm"), slots, "code", "ts", "slot", 5400, ["sky"])
    return near.select("event_id", F.coalesce("live", F.when(F.col("rain_mm") < 1, F.col("sky"))).alias("sky"))


@query("jsn07_context_merge", "SELECT event_id, concat('base', event_id % 2) AS a, CASE WHEN event_id % 3 = 0 THEN 'live' ELSE 'base' END AS b, CASE WHEN event_id % 5 = 0 THEN 'asked' WHEN event_id % 3 = 0 THEN 'live' END AS c FROM events")
def _(spark, sf):
    """Three objects merged key by key, the later one first; a missing object changes nothing."""
    rows = V.table(spark, sf, "events").selectExpr("event_id", "map('a', concat('base', event_id % 2), 'b', 'base') AS x", "CASE WHEN event_id % 3 = 0 THEN map('b', 'live', 'c', 'live') END AS y", "CASE WHEN event_id % 5 = 0 THEN map('c', 'asked') END AS z")
    merged = C.merged(F.col("x"), F.col("y"), F.col("z"))
    return rows.withColumn("m", merged).select("event_id", *(F.try_element_at("m", F.lit(k)).alias(k) for k in "abc"))


@query("jsn08_object_nullness", "SELECT event_id, event_id % 4 IN (0, 1) AS missing FROM events")
def _(spark, sf):
    """Whether an object has neither of two members: absent and JSON null are alike, and so is no object."""
    text = F.when(F.col("event_id") % 4 == 0, F.lit(None)).when(F.col("event_id") % 4 == 1, '{"lat":null}').when(F.col("event_id") % 4 == 2, '{"lat":37.5,"lng":null}').otherwise('{"lat":37.5,"lng":127.0}')
    none = F.get_json_object(text, "$.lat").isNull() & F.get_json_object(text, "$.lng").isNull()
    return V.table(spark, sf, "events").select("event_id", none.alias("missing"))


@query("jsn09_array_audit", "SELECT category, count(*) FILTER (WHERE tag1 IS NULL AND tag2 IS NULL) AS empty_tags, count(*) FILTER (WHERE (tag1 IS NOT NULL AND tag1 NOT IN ('데이트', '혼자')) OR (tag2 IS NOT NULL AND tag2 NOT IN ('데이트', '혼자'))) AS outside FROM v_poi GROUP BY category")
def _(spark, sf):
    """Empty arrays, and arrays with a value outside the vocabulary."""
    tags = F.array_compact(F.array("tag1", "tag2"))
    outside = F.exists(tags, lambda x: ~x.isin("데이트", "혼자"))
    return V.poi(spark, sf).groupBy("category").agg(F.count_if(F.size(tags) == 0).alias("empty_tags"), F.count_if(outside).alias("outside"))


@query("qcx03_key_report", "SELECT category, area, count(*) AS n, count(*) > 1 AS repeated, min(poi_id) AS first_id FROM v_poi GROUP BY category, area")
def _(spark, sf):
    """How often each pair that should be a key occurs."""
    return V.poi(spark, sf).groupBy("category", "area").agg(F.count("*").alias("n"), (F.count("*") > 1).alias("repeated"), F.min("poi_id").alias("first_id"))


@query("qcx03_uniqueness", "SELECT count(*) AS n, count(DISTINCT poi_id) AS ids, count(*) = count(DISTINCT poi_id) AS is_key FROM v_poi")
def _(spark, sf):
    return V.poi(spark, sf).agg(F.count("*").alias("n"), F.countDistinct("poi_id").alias("ids"), (F.count("*") == F.countDistinct("poi_id")).alias("is_key"))


@query("set05_incremental_union", "SELECT user_id, arg_max(event_id, (late, ts, event_id)) AS event_id, count(*) AS versions FROM (SELECT *, CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN 1 ELSE 0 END AS late FROM events) GROUP BY user_id")
def _(spark, sf):
    """An earlier load and a later one of other column order: all versions counted, the later load's last row wins."""
    rows = V.table(spark, sf, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    cut = F.col("ts") >= F.lit("2024-01-15").cast("timestamp")
    both = rows.where(~cut).withColumn("late", F.lit(0)).unionByName(rows.where(cut).withColumn("late", F.lit(1)).select("late", "ts", "event_id", "user_id"))
    counted = both.groupBy("user_id").agg(F.count("*").alias("versions"))
    return merges.last_wins(both, ["user_id"], ["late", "ts", "event_id"]).select("user_id", "event_id").join(counted, "user_id")


_EXACT = lambda n: {c: rounded_sql(c, d) for c, d in (("score", 4), ("purpose", 3), ("quality", 3), ("metres", 0))}[n]


@query("sco20_rounding", f"SELECT request_id, poi_id, {_EXACT('score')} AS score, {_EXACT('purpose')} AS purpose, {_EXACT('quality')} AS quality, ({_EXACT('metres')})::BIGINT AS metres FROM (SELECT request_id, poi_id, round(score, 12) AS score, t2::DOUBLE AS purpose, round(t5, 9) AS quality, round(dist, 6) AS metres FROM ({SCORED}))")
def _(spark, sf):
    rows = scored(spark, sf).select("request_id", "poi_id", F.round("score", 12).alias("score"), F.col("purpose_match").cast("double").alias("purpose"), F.round(F.coalesce("quality", F.lit(0.5)), 9).alias("quality"), F.round("dist", 6).alias("metres"))
    return rows.select("request_id", "poi_id", rounded(F.col("score"), 4).alias("score"), rounded(F.col("purpose"), 3).alias("purpose"), rounded(F.col("quality"), 3).alias("quality"), rounded(F.col("metres")).cast("long").alias("metres"))


@query("sco20_half_even", f"SELECT l_orderkey, l_linenumber, {rounded_sql('l_extendedprice / 16', 2)} AS two, {rounded_sql('l_quantity / 8 - 3', 1)} AS one, {rounded_sql('l_quantity / 2')} AS whole FROM lineitem")
def _(spark, sf):
    """Halves and near halves of every line's price and quantity."""
    d = lambda c: F.col(c).cast("double")
    rows = V.table(spark, sf, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", rounded(d("l_extendedprice") / 16, 2).alias("two"), rounded(d("l_quantity") / 8 - 3, 1).alias("one"), rounded(d("l_quantity") / 2).alias("whole"))


@query("sco22_hash_terms", "SELECT poi_id, round(('0x' || substr(sha256(concat(poi_id, ':taste')), 1, 8))::BIGINT / 4294967295.0, 9)::DOUBLE AS taste FROM v_poi")
def _(spark, sf):
    """A stand-in term between 0 and 1 from the first bytes of a hash."""
    head = F.conv(F.substring(F.sha2(F.concat("poi_id", F.lit(":taste")), 256), 1, 8), 16, 10).cast("double")
    return V.poi(spark, sf).select("poi_id", F.round(head / 4294967295.0, 9).alias("taste"))


_BYTES = ", ".join(f"('0x' || substr(h, {2 * i + 1}, 2))::INT - 127.5" for i in range(4))


@query("sco23_tag_vectors", f"SELECT tag, round(v[1] / sqrt(list_sum([x * x FOR x IN v])), 9)::DOUBLE AS first, round(v[4] / sqrt(list_sum([x * x FOR x IN v])), 9)::DOUBLE AS fourth FROM (SELECT tag, [x::DOUBLE FOR x IN [{_BYTES}]] AS v FROM (SELECT tag, sha256(tag) AS h FROM (SELECT DISTINCT tag1 AS tag FROM v_poi WHERE tag1 IS NOT NULL)))")
def _(spark, sf):
    """A unit vector for each tag from the bytes of its hash (here of four)."""
    byte = lambda i: F.conv(F.substring(F.sha2(F.col("tag"), 256), 2 * i + 1, 2), 16, 10).cast("double") - 127.5
    rows = V.poi(spark, sf).where("tag1 IS NOT NULL").select(F.col("tag1").alias("tag")).distinct().withColumn("v", F.array(*(byte(i) for i in range(4))))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return rows.select("tag", F.round(F.get("v", F.lit(0)) / norm, 9).alias("first"), F.round(F.get("v", F.lit(3)) / norm, 9).alias("fourth"))


_CUSTOMER = "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_nationkey AS area FROM customer"


@query("snk01_src01_csv", _CUSTOMER)
def _(spark, sf):
    """CSV with a byte order mark and a header, written and read back by a fixed schema: ids are strings."""
    path = work_path(spark, "csv")
    files.write_csv(V.table(spark, sf, "customer").selectExpr("c_custkey id", "c_name name", "c_nationkey area"), path)
    return files.read_csv(spark, path, "id string, name string, area long")


@query("src02_csv_columns", "SELECT id, area FROM (" + _CUSTOMER + ")")
def _(spark, sf):
    path = work_path(spark, "csv")
    files.write_csv(V.table(spark, sf, "customer").selectExpr("c_custkey id", "c_name name", "c_nationkey area"), path, mark=False)
    return files.read_csv(spark, path, "id string, name string, area long").select("id", "area")


@query("snk02_src03_json", _CUSTOMER)
def _(spark, sf):
    """JSON lines, written and read back."""
    path = work_path(spark, "json")
    files.write_json(V.table(spark, sf, "customer").selectExpr("CAST(c_custkey AS STRING) id", "c_name name", "c_nationkey area"), path)
    return files.read_json_lines(spark, path, "id string, name string, area long", "id")


@query("snk03_keep_last", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def _(spark, sf):
    """Batches appended as they come, of which a key's last row counts when the table is read."""
    path = work_path(spark, "appended")
    rows = V.table(spark, sf, "events").select("user_id", "event_id")
    for part in range(3):
        rows.where(F.col("event_id") % 3 == part).withColumn("batch", F.lit(part)).write.mode("append").parquet(path)
    return merges.last_wins(spark.read.schema("user_id long, event_id long, batch int").parquet(path), ["user_id"], ["event_id"]).select("user_id", "event_id")


@query("src01_mixed_encodings", "SELECT s_suppkey, concat('가게 ', s_name, CASE WHEN s_suppkey % 2 = 0 THEN ' é' ELSE '' END) AS name FROM supplier")
def _(spark, sf):
    """Suppliers landed as CSV files of two encodings in one folder, and read without being told which."""
    out, schema = work_path(spark, "mixed"), "s_suppkey long, name string"
    rows = V.table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("가게 "), "s_name", F.when(F.col("s_suppkey") % 2 == 0, " é").otherwise("")).alias("name"))
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    for rest, encoding in ((0, "UTF-8"), (1, "MS949")):
        rows.where(F.col("s_suppkey") % 2 == rest).write.mode("append").option("header", True).option("encoding", encoding).csv(out)
    return files.read_csv_detected(spark, out, schema)


@query("src09_paged", "SELECT (s_suppkey // 7 + (SELECT 1 - min(s_suppkey) // 7 FROM supplier))::INT AS page, s_suppkey, s_name FROM supplier")
def _(spark, sf):
    """Suppliers landed as pages of up to seven by key, one item as a single object and one page landed twice, and read whole."""
    out = work_path(spark, "pages")
    rows = V.table(spark, sf, "supplier").select("s_suppkey", "s_name")
    first = rows.agg(F.min(F.floor(F.col("s_suppkey") / 7)).alias("first"))
    pages = rows.crossJoin(F.broadcast(first)).withColumn("page", (F.floor(F.col("s_suppkey") / 7) - F.col("first") + 1).cast("int")).groupBy("page").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("rows"))
    one = F.when(F.size("rows") == 1, F.to_json(F.get("rows", F.lit(0)))).otherwise(F.to_json("rows"))
    pages = pages.select("page", one.alias("items")).crossJoin(F.broadcast(rows.agg(F.count("*").cast("int").alias("total"))))
    pages = pages.unionByName(pages.where("page = 2")).select("page", "total", "items")
    text = F.concat(F.lit('{"page":'), "page", F.lit(',"total":'), "total", F.lit(',"items":'), "items", F.lit("}"))
    pages.select(text.alias("value")).write.text(out)
    return files.complete_pages(spark, out, "s_suppkey long, s_name string", lines=True)
