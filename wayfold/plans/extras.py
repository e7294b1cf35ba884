"""Polygon, fuzzy and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions import fuzzy, projection
from wayfold.operators import overlay, polygons
from wayfold.operators.merges import last_wins
from wayfold.plans.registry import query
from wayfold.sources import views as V
from wayfold.sources.work import work_path, written
from wayfold.streaming import snapshots as st

#: Overlapping rectangles over the places: code n covers [x0, x1) x [y0, y1).
_BOXES = [(f"z{n}", 126.955 + 0.012 * (n % 3), 126.955 + 0.012 * (n % 3) + 0.014, 37.515 + 0.01 * (n // 3), 37.515 + 0.01 * (n // 3) + 0.008 + 0.001 * n) for n in range(9)]
_VALUES = ", ".join(f"('{c}', {a!r}, {b!r}, {p!r}, {q!r})" for c, a, b, p, q in _BOXES)


def boxes(spark):
    rows = [(c, [(a, p), (b, p), (b, q), (a, q), (a, p)]) for c, a, b, p, q in _BOXES]
    return spark.createDataFrame(rows, f"code string, ring {polygons.RING}")


def points(spark, sf):
    return V.poi(spark, sf).select(F.col("poi_id").alias("id"), F.col("lng").alias("x"), F.col("lat").alias("y"))


_IN = f"(SELECT poi_id AS id, code, (x1 - x0) * (y1 - y0) AS size FROM v_poi JOIN (VALUES {_VALUES}) b(code, x0, x1, y0, y1) ON lng >= x0 AND lng < x1 AND lat >= y0 AND lat < y1)"
_NEAR = f"(SELECT poi_id AS id, code, sqrt(pow(greatest(x0 - lng, lng - x1, 0), 2) + pow(greatest(y0 - lat, lat - y1, 0), 2)) AS d FROM v_poi, (VALUES {_VALUES}) b(code, x0, x1, y0, y1))"


#: Cells of a cover, in degrees.
CELL = 0.001
_INSIDE = lambda x, y: f"(({x} >= ax0 AND {x} < ax1 AND {y} >= ay0 AND {y} < ay1 AND NOT ({x} >= hx0 AND {x} < hx1 AND {y} >= hy0 AND {y} < hy1)) OR ({x} >= bx0 AND {x} < bx1 AND {y} >= by0 AND {y} < by1))"
_SIZE = "((ax1 - ax0) * (ay1 - ay0) - (hx1 - hx0) * (hy1 - hy0) + (bx1 - bx0) * (by1 - by0))"


@query("geo08_point_in_polygon", f"SELECT poi_id AS id, code FROM v_poi JOIN v_shape ON {_INSIDE('lng', 'lat')}")
def _(spark, sf):
    return overlay.located(points(spark, sf), overlay.cover(V.shapes(spark, sf), CELL), CELL).select("id", "code")


@query("geo07_user_zone", f"SELECT user_id, min(code) AS code FROM v_user LEFT JOIN v_shape ON {_INSIDE('u_lng', 'u_lat')} GROUP BY user_id")
def _(spark, sf):
    users = V.users(spark, sf)
    found = overlay.located(users.selectExpr("user_id AS id", "u_lng AS x", "u_lat AS y"), overlay.cover(V.shapes(spark, sf), CELL), CELL)
    zone = found.groupBy(F.col("id").alias("user_id")).agg(F.min("code").alias("code"))
    return users.select("user_id").join(zone, "user_id", "left")


@query("geo10_smallest_area", f"SELECT poi_id AS id, arg_min(code, (round({_SIZE}, 12), code)) AS code FROM v_poi JOIN v_shape ON {_INSIDE('lng', 'lat')} GROUP BY poi_id")
def _(spark, sf):
    return overlay.smallest(points(spark, sf), overlay.cover(V.shapes(spark, sf), CELL), CELL)


@query("geo09_geo11_nearest_polygon", f"SELECT p.poi_id AS id, coalesce(i.code, n.code) AS code, CASE WHEN i.code IS NOT NULL THEN 'polygon' WHEN n.code IS NOT NULL THEN 'nearest' ELSE 'unmapped' END AS method FROM v_poi p LEFT JOIN (SELECT id, arg_min(code, (round(size, 12), code)) AS code FROM {_IN} GROUP BY id) i ON p.poi_id = i.id LEFT JOIN (SELECT id, arg_min(code, (d, code)) AS code FROM {_NEAR} WHERE d <= 0.0006 GROUP BY id) n ON p.poi_id = n.id")
def _(spark, sf):
    return polygons.assign(points(spark, sf), boxes(spark), 0.0006, 0.005).select("id", "code", "method")


_AXIS = lambda a: f"(SELECT a AS lo, lead(a) OVER (ORDER BY a) AS hi FROM (SELECT DISTINCT unnest([a{a}0, a{a}1, h{a}0, h{a}1, b{a}0, b{a}1]) AS a FROM v_shape UNION SELECT unnest([a{a}0, a{a}1]) FROM v_district))"
_TILES = f"(SELECT s.code, {_SIZE} AS size, (x.hi - x.lo) * (y.hi - y.lo) AS piece FROM v_shape s JOIN {_AXIS('x')} x ON x.lo >= least(ax0, bx0) AND x.hi <= greatest(ax1, bx1) JOIN {_AXIS('y')} y ON y.lo >= least(ay0, by0) AND y.hi <= greatest(ay1, by1) WHERE {_INSIDE('(x.lo + x.hi) / 2', '(y.lo + y.hi) / 2')} AND EXISTS (SELECT 1 FROM v_district d WHERE x.lo >= d.ax0 AND x.hi <= d.ax1 AND y.lo >= d.ay0 AND y.hi <= d.ay1))"


@query("geo12_overlap_share", f"SELECT s.code, round(coalesce(sum(piece), 0) / any_value({_SIZE}), 6) AS share, coalesce(sum(piece), 0) / any_value({_SIZE}) >= 0.1 AS kept, coalesce(sum(piece), 0) > 0 AS point_inside FROM v_shape s LEFT JOIN {_TILES} t ON s.code = t.code GROUP BY s.code")
def _(spark, sf):
    """Each area's share in the union of the districts, and whether the overlay's point is in the area and a district."""
    shapes, districts = V.shapes(spark, sf), V.districts(spark, sf)
    rows = written(overlay.overlaid(shapes, districts, CELL), "overlaid")
    spots = rows.selectExpr("code AS id", "x", "y").where("x is not null")
    own = overlay.located(spots, overlay.cover(shapes, CELL), CELL).where("id = code").select(F.col("id"))
    within = overlay.located(spots, overlay.cover(districts, CELL), CELL).select("id").distinct().join(own, "id").select(F.col("id").alias("code"), F.lit(True).alias("hit"))
    return rows.join(within, "code", "left").select("code", F.round("share", 6).alias("share"), (F.col("share") >= 0.1).alias("kept"), F.coalesce("hit", F.lit(False)).alias("point_inside"))


@query("geo13_local_metres", "SELECT poi_id, round((lng - 126.98) * 111194.92664455873 * cos(radians(37.53)), 3) AS x, round((lat - 37.53) * 111194.92664455873, 3) AS y FROM v_poi")
def _(spark, sf):
    m = 111194.92664455873  # metres of a degree on the sphere
    return V.poi(spark, sf).select("poi_id", F.round((F.col("lng") - 126.98) * m * F.cos(F.radians(F.lit(37.53))), 3).alias("x"), F.round((F.col("lat") - 37.53) * m, 3).alias("y"))


_EAST, _NORTH = projection.to_grid_sql("lat", "lng", projection.UNIFIED)
_EAST2, _NORTH2 = projection.to_grid_sql("lat", "lng", projection.CENTRAL)


@query("geo13_projected", f"SELECT poi_id, round({_EAST}, 4) AS east, round({_NORTH}, 4) AS north, round({_EAST2}, 4) AS east2, round({_NORTH2}, 4) AS north2, TRUE AS returns FROM v_poi")
def _(spark, sf):
    """Places in two national grids, and whether the way back ends within a tenth of a millimetre."""
    rows = V.poi(spark, sf).select("poi_id", "lat", "lng", projection.to_grid(F.col("lat"), F.col("lng"), projection.UNIFIED).alias("a"), projection.to_grid(F.col("lat"), F.col("lng"), projection.CENTRAL).alias("b"))
    rows = rows.withColumn("back", projection.from_grid(F.col("a.east"), F.col("a.north"), projection.UNIFIED))
    returns = (F.abs(F.col("back.lat") - F.col("lat")) < 1e-9) & (F.abs(F.col("back.lng") - F.col("lng")) < 1e-9)
    return rows.select("poi_id", F.round("a.east", 4).alias("east"), F.round("a.north", 4).alias("north"), F.round("b.east", 4).alias("east2"), F.round("b.north", 4).alias("north2"), returns.alias("returns"))


@query("str13_quote_repair")
def _(spark, sf):
    turns = V.table(spark, sf, "conversations")
    chunks = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("text")).alias("chunks"))
    quote = F.concat(F.substring(F.element_at("chunks", -1), 1, 50), F.lit("..."))
    return chunks.select("conv_id", fuzzy.repaired(quote, F.col("chunks")).alias("quote"))


#: Polls that a table lands in, and the watermark of streams in seconds.
POLLS, DELAY = 4, 7200


def run_stream(spark, sf, start, read=None, polls: int = POLLS):
    """The events table as it would arrive: it lands in order of time in as many polls, each of which starts the stream anew on
    what is new, with the same checkpoint. start: (stream, checkpoint) -> a stream writer. Gives the streams' progress."""
    rows = (read or (lambda: V.table(spark, sf, "events")))().withColumn("ts", F.col("ts").cast("timestamp"))
    landed, checkpoint = work_path(spark, "landed"), work_path(spark, "stream-state")
    at = F.unix_micros("ts")
    low, high = rows.agg(F.min(at), F.max(at)).first()
    poll = F.least(F.floor((at - (low or 0)) * polls / ((high or 0) - (low or 0) + 1)), F.lit(polls - 1))
    done = []
    for k in range(polls):
        rows.where(F.coalesce(poll, F.lit(0)) == k).write.mode("append").parquet(landed)
        query = start(spark.readStream.schema(rows.schema).parquet(landed), checkpoint).start()
        query.awaitTermination()
        done += query.recentProgress
    return done


def appended(spark, sf, shape):
    """Rows that a shaped stream appends, read again."""
    out, kinds = work_path(spark, "stream"), []

    def start(rows, checkpoint):
        shaped = shape(rows)
        kinds.append(shaped.schema)
        return shaped.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append")

    run_stream(spark, sf, start)
    return spark.read.schema(kinds[0]).parquet(out)


@query("stm02_stream_dedup", "SELECT user_id, count(DISTINCT ts) AS n FROM events GROUP BY user_id")
def _(spark, sf):
    """Every event comes twice; each key and time counts once, with two hours of state."""
    twice = lambda r: st.deduplicated(r.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1)))), ["user_id"], "ts", f"{DELAY} seconds")
    return appended(spark, sf, twice).groupBy("user_id").agg(F.count("*").alias("n"))


@query("stm03_stream_latest", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS seen FROM events GROUP BY user_id")
def _(spark, sf):
    """Updates of each batch are written below its number, of which the last of a key counts."""
    out, kinds = work_path(spark, "updates"), []

    def start(rows, checkpoint):
        shaped = st.latest(rows.withColumn("at", F.struct("ts", "event_id")), "user_id", "at", ["event_id"])
        kinds.append(shaped.schema)
        write = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{out}/batch={epoch}")
        return shaped.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("update")

    run_stream(spark, sf, start)
    rows = last_wins(spark.read.schema(kinds[0]).parquet(out), ["user_id"], ["batch"])
    return rows.select("user_id", F.col("last.event_id").alias("event_id"), "seen")


_CLOSED = f"(SELECT epoch_us(max(ts)) // 1000 - {DELAY * 1000} FROM events)"


@query("stm01_stream_windows", f"SELECT user_id, date_trunc('day', ts) AS start, count(*) AS n FROM events WHERE epoch_us(date_trunc('day', ts) + INTERVAL 1 DAY) // 1000 <= {_CLOSED} GROUP BY ALL")
def _(spark, sf):
    """Days that the watermark has closed."""
    rows = appended(spark, sf, lambda r: st.windowed(r, "user_id", "ts", "1 day", delay=f"{DELAY} seconds"))
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


_POLLS = f"(SELECT *, least((epoch_us(ts) - min(epoch_us(ts)) OVER ()) * {POLLS} // (max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER () + 1), {POLLS - 1}) AS poll, event_type = 'error' AND value < 2 AS bad FROM events)"


@query("stm01_ingest", f"SELECT user_id, max(event_id) FILTER (NOT failed AND last) AS event_id, count(DISTINCT poll) FILTER (failed) AS failures FROM (SELECT *, row_number() OVER (PARTITION BY user_id, failed ORDER BY ts DESC, event_id DESC) = 1 AS last FROM (SELECT *, bool_or(coalesce(bad, TRUE)) OVER (PARTITION BY user_id, poll) AS failed FROM {_POLLS})) GROUP BY user_id")
def _(spark, sf):
    """Latest event of each user over the polls in which none of the user's rows was bad, and in how many one was."""
    out = work_path(spark, "ingest")
    bad = (F.col("event_type") == "error") & (F.col("value") < 2)
    columns = ["user_id", "event_id", "ts", "event_type", "value"]
    run_stream(spark, sf, lambda rows, checkpoint: st.ingested(rows.select(*columns), out, ["user_id"], "ts", bad, DELAY, checkpoint))
    schema = V.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).select(*columns).schema
    failed = st.ingested_table(spark, out, "failed", "user_id long, bad_rows long").groupBy("user_id").agg(F.count("*").alias("failures"))
    rows = st.ingested_table(spark, out, "table", schema).select("user_id", "event_id").join(failed, "user_id", "full_outer")
    return rows.select("user_id", "event_id", F.coalesce("failures", F.lit(0)).alias("failures"))


_HITS = f"(SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE epoch_us(ts) // 1000 <= {_CLOSED})"
_WINDOW = 86_400_000_000


@query("stm05_stream_rate_limit", f"""WITH RECURSIVE hits AS {_HITS}, fold AS (SELECT user_id, 0 AS i, NULL::BIGINT AS event_id, NULL::BIGINT AS first, NULL::BIGINT AS second, TRUE AS allowed, 0::BIGINT AS retry_after FROM (SELECT DISTINCT user_id FROM hits)
UNION ALL SELECT user_id, i, event_id, CASE WHEN ok THEN second ELSE first END, CASE WHEN ok THEN us ELSE second END, ok, CASE WHEN ok THEN 0 ELSE greatest(1, ({_WINDOW} - (us - first)) // 1000000 + 1) END
FROM (SELECT h.user_id, h.i, h.event_id, h.us, f.first, f.second, f.first IS NULL OR f.first <= h.us - {_WINDOW} AS ok FROM fold f JOIN hits h ON h.user_id = f.user_id AND h.i = f.i + 1))
SELECT user_id, event_id, allowed, retry_after FROM fold WHERE i > 0""")
def _(spark, sf):
    """Two hits a day for each user, as far as the watermark has come."""
    rows = appended(spark, sf, lambda r: st.limited(r, "user_id", "event_id", "ts", 86_400, 2, f"{DELAY} seconds"))
    return rows.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "allowed", "retry_after")
