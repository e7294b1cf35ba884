"""Whole responses of city and forecast services, landed as JSON text, as flat rows. Expressions only: no shuffle, one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold import constants as K
from wayfold.functions import scoring as S

AGES = [f"PPLTN_RATE_{a}" for a in K.AGE_RATES]
PEOPLE_NOW = ", ".join(f"{c} string" for c in ["PPLTN_TIME", "AREA_CONGEST_LVL", "AREA_PPLTN_MIN", "AREA_PPLTN_MAX", "MALE_PPLTN_RATE", "FEMALE_PPLTN_RATE", "FCST_PPLTN", *AGES])
#: Nested values that are only handed on stay JSON text.
CITY = f"AREA_CD string, AREA_NM string, LIVE_PPLTN_STTS array<struct<{PEOPLE_NOW}>>, WEATHER_STTS array<string>"
ITEMS = "response struct<header struct<resultCode string>, body struct<items struct<item array<struct<category string, fcstDate string, fcstTime string, fcstValue string>>>>>"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def plain_number(text: Column) -> Column:
    """A text that is a decimal number as double; a dash, an empty or any other text gives null."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def listed(text: Column) -> Column:
    """A JSON list as text, `[]` in place of a null or an empty text."""
    return F.coalesce(F.when(F.trim(text) != "", text), F.lit("[]"))


def city_snapshot(rows: DataFrame, payload: str, landed_at: Column) -> DataFrame:
    """rows with the state of a place that the payload tells: code, name, observed_at (landed_at where it has no time), congestion,
    people, a map of rates by age band, rates by gender, the weather now as a map without its forecast and news, and fcst, an object of both
    forecasts as JSON. fault names what keeps a payload from being used (`payload`, `population`, `time`), in which case the rest is null;
    one bad payload does not touch the others. Names of rows that clash with these are replaced."""
    city = F.from_json(F.col(payload), CITY)
    out = rows.withColumn("_city", city).withColumn("_now", F.get("_city.LIVE_PPLTN_STTS", F.lit(0))).withColumn("_sky", F.get("_city.WEATHER_STTS", F.lit(0)))
    now, sky = lambda c: F.col(f"_now.{c}"), F.col("_sky")
    said = F.when(F.trim(now("PPLTN_TIME")) != "", now("PPLTN_TIME"))
    at = F.coalesce(F.try_to_timestamp(said, F.lit("yyyy-MM-dd HH:mm")), F.when(said.isNull(), landed_at))
    known = F.coalesce(F.col("_city.AREA_CD"), F.col("_city.AREA_NM"), F.col("_city.LIVE_PPLTN_STTS").cast("string"), F.col("_city.WEATHER_STTS").cast("string"))
    fault = F.when(known.isNull(), "payload").when(F.col("_now").isNull(), "population").when(at.isNull(), "time")
    count = lambda c: plain_number(now(c)).try_cast("long")
    fields = {
        "hotspot_code": F.col("_city.AREA_CD"),
        "hotspot_name": F.col("_city.AREA_NM"),
        "observed_at": at,
        "congest_lvl": now("AREA_CONGEST_LVL"),
        "ppltn_min": count("AREA_PPLTN_MIN"),
        "ppltn_max": count("AREA_PPLTN_MAX"),
        "age_rates": F.create_map(*[x for a, c in zip(K.AGE_RATES, AGES) for x in (F.lit(str(a)), plain_number(now(c)))]),
        "male_rate": plain_number(now("MALE_PPLTN_RATE")),
        "female_rate": plain_number(now("FEMALE_PPLTN_RATE")),
        "weather": F.map_filter(F.coalesce(F.from_json(sky, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>")), lambda k, _: ~k.isin(*K.NOT_WEATHER_NOW)),
        "fcst": F.concat(F.lit('{"population":'), listed(now("FCST_PPLTN")), F.lit(',"weather":'), listed(F.get_json_object(sky, "$.FCST24HOURS")), F.lit("}")),
    }
    kept = [c for c in rows.columns if c not in fields and c != "fault"]
    return out.withColumn("_fault", fault).select(*kept, *(F.when(F.col("_fault").isNull(), c).alias(n) for n, c in fields.items()), F.col("_fault").alias("fault"))


def forecast_items(payload: Column) -> Column:
    """The items of a forecast response; null where its result code tells of an error or the list is missing. Errors, too, come with
    status 200, so that the code is what counts; an absent or empty one passes."""
    parsed = F.from_json(payload, ITEMS)
    code = F.coalesce(parsed["response"]["header"]["resultCode"], F.lit(""))
    return F.when(code.isin("", "0", "00"), parsed["response"]["body"]["items"]["item"])


def slot_forecast(rows: DataFrame, items: str, target: str) -> DataFrame:
    """rows with the forecast of the slot nearest to target: rain_prob, feels_like, temp, label, precpt_type, fcst_slot. Of two slots
    equally near the one listed first counts, of a category's several values the last; times are in the session's time zone. Rows without a
    usable slot or temperature hold nulls. Work per row goes with its list of items."""
    when = lambda x: F.try_to_timestamp(F.concat(x["fcstDate"], x["fcstTime"]), F.lit("yyyyMMddHHmm"))
    gaps = F.transform(items, lambda x, i: F.struct(F.abs(F.unix_micros(when(x)) - F.unix_micros(F.col(target).cast("timestamp"))).alias("gap"), i.alias("place"), x["fcstDate"].alias("day"), x["fcstTime"].alias("time")))
    out = rows.withColumn("_slot", F.array_min(F.filter(gaps, lambda g: g["gap"].isNotNull())))
    same = F.filter(items, lambda x: (x["fcstDate"] == F.col("_slot.day")) & (x["fcstTime"] == F.col("_slot.time")))
    out = out.withColumn("_items", same)
    number = lambda c: plain_number(F.try_element_at(F.filter("_items", lambda x: x["category"] == c), F.lit(-1))["fcstValue"])
    for name in ("TMP", "POP", "PTY", "SKY", "REH", "WSD"):
        out = out.withColumn(f"_{name}", number(name))
    c = F.col
    kind, sky = F.coalesce(c("_PTY").cast("int"), F.lit(0)), F.coalesce(F.nullif(c("_SKY"), F.lit(0.0)).cast("int"), F.lit(1))
    named = lambda table, key: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]
    fields = {
        "rain_prob": F.coalesce(c("_POP") / 100, F.when(kind != 0, 1.0).otherwise(0.0)),
        "feels_like": S.apparent_temperature(c("_TMP"), c("_REH"), c("_WSD")),
        "temp": c("_TMP"),
        "label": F.when(kind != 0, named(K.PRECIPITATION, kind)).otherwise(F.coalesce(named(K.SKY, sky), F.lit(K.SKY[1]))),
        "precpt_type": F.coalesce(named(K.PRECIPITATION, kind), F.lit(K.PRECIPITATION[0])),
        "fcst_slot": F.concat("_slot.day", "_slot.time"),
    }
    return out.select(*[n for n in rows.columns if n not in fields], *(F.when(c("_TMP").isNotNull(), v).alias(n) for n, v in fields.items()))
