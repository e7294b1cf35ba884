"""Service responses and feedback logs, made of the event rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold import constants as K
from wayfold.operators import feedback, payloads
from wayfold.plans.registry import query
from wayfold.sources import views as V

_c = F.col


def _text(sql: str):
    return F.expr(f"CAST({sql} AS STRING)")


def city_payloads(spark, sf) -> DataFrame:
    """A city response for each event, with dashes, empty fields, lists without an entry, times that do not parse and broken texts."""
    rates = [F.when(_c("event_id") % 5 == 0, "").otherwise(F.concat((_c("event_id") % 50 + a).cast("string"), F.lit(".5"))).alias(f"PPLTN_RATE_{a}") for a in K.AGE_RATES]
    time = F.when(_c("event_id") % 19 == 0, "soon").when(_c("event_id") % 17 == 0, "").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm"))
    forecast = F.when(_c("event_id") % 3 > 0, F.array(F.struct(F.concat(F.lit("t"), _text("event_id % 24")).alias("FCST_TIME"))))
    people = F.struct(
        time.alias("PPLTN_TIME"),
        F.lit(K.CONGESTION[0]).alias("AREA_CONGEST_LVL"),
        F.when(_c("event_id") % 7 == 0, "-").otherwise(F.concat(_text("event_id"), F.lit(".9"))).alias("AREA_PPLTN_MIN"),
        _text("event_id + 500").alias("AREA_PPLTN_MAX"),
        *rates,
        F.concat(_text("event_id % 60"), F.lit(".25")).alias("MALE_PPLTN_RATE"),
        F.lit("n/a").alias("FEMALE_PPLTN_RATE"),
        forecast.alias("FCST_PPLTN"),
    )
    weather = F.struct(_text("event_id % 40").alias("TEMP"), F.lit("-").alias("PRECIPITATION"), F.array(F.lit("x")).alias("NEWS_LIST"), F.when(_c("event_id") % 2 == 0, F.array(F.struct(_text("event_id % 100").alias("RAIN_CHANCE")))).alias("FCST24HOURS"))
    none = F.array().cast("array<string>")
    head = [F.concat(F.lit("POI"), _text("user_id")).alias("AREA_CD"), _c("event_type").alias("AREA_NM")]
    whole = F.to_json(F.struct(*head, F.array(people).alias("LIVE_PPLTN_STTS"), F.array(weather).alias("WEATHER_STTS")))
    empty = F.to_json(F.struct(*head, none.alias("LIVE_PPLTN_STTS"), none.alias("WEATHER_STTS")))
    return V.table(spark, sf, "events").select("event_id", "ts", F.when(_c("event_id") % 13 == 0, "{oops").when(_c("event_id") % 11 == 0, empty).otherwise(whole).alias("payload"))


_OK = "CASE WHEN fault IS NULL THEN"


@query("jsn01_city_payload", f"""SELECT event_id, fault, {_OK} concat('POI', user_id) END AS hotspot_code, {_OK} event_type END AS hotspot_name,
 {_OK} CASE WHEN event_id % 17 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d %H:%M:00') END END AS observed_at,
 CASE WHEN fault IS NULL AND event_id % 7 <> 0 THEN event_id END AS ppltn_min, {_OK} event_id + 500 END AS ppltn_max,
 CASE WHEN fault IS NULL AND event_id % 5 <> 0 THEN event_id % 50 + 0.5 END::DOUBLE AS rate_0, CASE WHEN fault IS NULL AND event_id % 5 <> 0 THEN event_id % 50 + 70.5 END::DOUBLE AS rate_70,
 {_OK} event_id % 60 + 0.25 END::DOUBLE AS male_rate, CAST(NULL AS DOUBLE) AS female_rate, {_OK} CAST(event_id % 40 AS VARCHAR) END AS temp, {_OK} 'PRECIPITATION,TEMP' END AS weather_fields,
 {_OK} concat('{{"population":', CASE WHEN event_id % 3 > 0 THEN concat('[{{"FCST_TIME":"t', event_id % 24, '"}}]') ELSE '[]' END, ',"weather":', CASE WHEN event_id % 2 = 0 THEN concat('[{{"RAIN_CHANCE":"', event_id % 100, '"}}]') ELSE '[]' END, '}}') END AS fcst
 FROM (SELECT *, CASE WHEN event_id % 13 = 0 THEN 'payload' WHEN event_id % 11 = 0 THEN 'population' WHEN event_id % 19 = 0 THEN 'time' END AS fault FROM events)""")
def _(spark, sf):
    found = payloads.city_snapshot(city_payloads(spark, sf), "payload", _c("ts"))
    names = F.array_join(F.array_sort(F.map_keys("weather")), ",")
    return found.select(
        "event_id", "fault", "hotspot_code", "hotspot_name", F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss").alias("observed_at"), "ppltn_min", "ppltn_max",
        F.try_element_at("age_rates", F.lit("0")).alias("rate_0"), F.try_element_at("age_rates", F.lit("70")).alias("rate_70"), "male_rate", "female_rate",
        F.try_element_at("weather", F.lit("TEMP")).alias("temp"), names.alias("weather_fields"), "fcst",
    )


def forecast_payloads(spark, sf) -> DataFrame:
    """A forecast response for each event: the hour of its time and the next one, in either order, one item without a valid time, some with
    an error code, some without a temperature or a chance of rain."""
    def slot(later: int) -> list:
        at = F.date_trunc("hour", _c("ts")) + F.expr(f"INTERVAL {later} HOURS")
        values = {"TMP": f"event_id % 40 - 8 + {later}", "POP": "event_id % 100", "PTY": "event_id % 9", "SKY": "event_id % 5", "REH": "50", "WSD": "2.5D"}
        left_out = {"TMP": _c("event_id") % 12 == 5, "POP": _c("event_id") % 3 == 0}
        return [F.struct(F.when(left_out.get(n, F.lit(False)), "NONE").otherwise(n).alias("category"), F.date_format(at, "yyyyMMdd").alias("fcstDate"), F.date_format(at, "HHmm").alias("fcstTime"), _text(v).alias("fcstValue")) for n, v in values.items()]

    bad = F.struct(F.lit("TMP").alias("category"), F.lit("someday").alias("fcstDate"), F.lit("noon").alias("fcstTime"), F.lit("99").alias("fcstValue"))
    early, late = slot(0), slot(1)
    items = F.when(_c("event_id") % 2 == 0, F.array(bad, *late, *early)).otherwise(F.array(*early, bad, *late))
    code = F.when(_c("event_id") % 10 == 0, "03").when(_c("event_id") % 4 == 1, "").otherwise("00")
    body = F.struct(F.struct(F.struct(code.alias("resultCode")).alias("header"), F.struct(F.struct(items.alias("item")).alias("items")).alias("body")).alias("response"))
    return V.table(spark, sf, "events").select("event_id", "ts", F.to_json(body).alias("payload"))


_named = lambda table, key: f"CASE {key} {' '.join(f'WHEN {k} THEN {v!r}' for k, v in table.items())} END"
_KNOWN = "CASE WHEN known THEN"


@query("jsn05_slot_forecast", f"""SELECT event_id, {_KNOWN} CASE WHEN event_id % 3 <> 0 THEN (event_id % 100) / 100.0 WHEN pty > 0 THEN 1 ELSE 0 END END::DOUBLE AS rain_prob, {_KNOWN} t END AS temp,
 {_KNOWN} round(CASE WHEN t >= 27 THEN ((-42.379 + 2.04901523 * f + 10.14333127 * 50 - 0.22475541 * f * 50 - 6.83783e-3 * f * f - 5.481717e-2 * 2500 + 1.22874e-3 * f * f * 50 + 8.5282e-4 * f * 2500 - 1.99e-6 * f * f * 2500) - 32) * 5 / 9
 WHEN t <= 10 THEN 13.12 + 0.6215 * t - 11.37 * pow(9.0, 0.16) + 0.3965 * t * pow(9.0, 0.16) ELSE t END, 6) END AS feels_like,
 {_KNOWN} CASE WHEN pty > 0 THEN {_named(K.PRECIPITATION, 'pty')} ELSE coalesce({_named(K.SKY, 'event_id % 5')}, '{K.SKY[1]}') END END AS label, {_KNOWN} coalesce({_named(K.PRECIPITATION, 'pty')}, '{K.PRECIPITATION[0]}') END AS precpt_type,
 {_KNOWN} strftime(slot_at, '%Y%m%d%H00') END AS fcst_slot FROM (SELECT *, t * 9 / 5 + 32 AS f FROM (SELECT *, event_id % 9 AS pty, (event_id % 40 - 8 + late)::DOUBLE AS t, date_trunc('hour', ts) + to_hours(late) AS slot_at,
 event_id % 10 <> 0 AND event_id % 12 <> 5 AS known FROM (SELECT *, CASE WHEN s > 1800000000 OR (s = 1800000000 AND event_id % 2 = 0) THEN 1 ELSE 0 END AS late FROM (SELECT *, epoch_us(ts) - epoch_us(date_trunc('hour', ts)) AS s FROM events))))""")
def _(spark, sf):
    rows = forecast_payloads(spark, sf).withColumn("items", payloads.forecast_items(_c("payload")))
    return payloads.slot_forecast(rows, "items", "ts").select("event_id", "rain_prob", "temp", F.round("feels_like", 6).alias("feels_like"), "label", "precpt_type", "fcst_slot")


def shown_log(spark, sf) -> DataFrame:
    """Events as shown candidates: clicks are picks, ranks go by time; a term that only picks have is in no report."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = V.table(spark, sf, "events").withColumn("rank", F.when(_c("event_id") % 13 > 0, rank))
    return rows.select((_c("event_type") == "click").alias("picked"), "rank", F.when(_c("event_id") % 3 > 0, _c("value")).alias("taste_similarity"), (_c("event_id") % 10 / F.lit(10.0)).alias("quality"), F.when(_c("event_type") == "click", 1.0).alias("live_segment_match"))


_SHOWN = "(SELECT event_type = 'click' AS picked, CASE WHEN event_id % 13 > 0 THEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS rank, CASE WHEN event_id % 3 > 0 THEN value END AS a, (event_id % 10) / 10.0::DOUBLE AS b FROM events)"


@query("jsn13_rank_histogram", f"SELECT rank, count(*) AS n FROM {_SHOWN} WHERE picked AND rank > 0 GROUP BY rank")
def _(spark, sf):
    return feedback.rank_histogram(shown_log(spark, sf)).withColumn("rank", _c("rank").cast("long"))


_GAP = "SELECT '{0}' AS term, round(avg({1}) FILTER (WHERE picked), 6) AS picked_mean, round(avg({1}) FILTER (WHERE NOT picked), 6) AS passed_mean, count({1}) AS samples FROM " + _SHOWN


@query("jsn13_term_gaps", f"{_GAP.format('taste_similarity', 'a')} UNION ALL {_GAP.format('quality', 'b')}")
def _(spark, sf):
    gaps = feedback.term_gaps(shown_log(spark, sf), ["taste_similarity", "quality", "live_segment_match"])
    return gaps.select("term", F.round("picked_mean", 6).alias("picked_mean"), F.round("passed_mean", 6).alias("passed_mean"), "samples")


@query("jsn13_verdict", f"SELECT picked, passed, round(share, 6) AS top2_share, CASE WHEN picked + passed < 200 THEN 'few' WHEN share >= 0.7 THEN 'biased' ELSE 'ok' END AS verdict FROM (SELECT count(*) FILTER (WHERE picked) AS picked, count(*) FILTER (WHERE NOT picked) AS passed, coalesce(count(*) FILTER (WHERE picked AND rank <= 2) / nullif(count(rank) FILTER (WHERE picked), 0), 0)::DOUBLE AS share FROM {_SHOWN})")
def _(spark, sf):
    return feedback.verdict(shown_log(spark, sf)).withColumn("top2_share", F.round("top2_share", 6))
