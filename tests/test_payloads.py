"""Service responses and feedback reports on small inputs with edge cases."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wayfold.operators import feedback, payloads

LANDED = datetime(2026, 3, 1, 12, 0)


def city(**people):
    return json.dumps({"AREA_CD": "P1", "AREA_NM": "x", "LIVE_PPLTN_STTS": [people], "WEATHER_STTS": [{"TEMP": "3", "WIND": None, "NEWS_LIST": [{"a": 1}], "FCST24HOURS": [{"b": "2"}]}]})


@pytest.mark.parametrize(
    "text, fault",
    [(None, "payload"), ("", "payload"), ("{oops", "payload"), ("[]", "payload"), ("{}", "payload"), ('{"AREA_CD":"P"}', "population"), ('{"AREA_CD":"P","LIVE_PPLTN_STTS":[]}', "population"), (city(PPLTN_TIME="noon"), "time"), (city(), None)],
)
def test_a_bad_payload_is_named_and_null(spark, text, fault):
    rows = spark.createDataFrame([(1, text, LANDED, "own")], "id int, payload string, at timestamp, fault string")
    found = payloads.city_snapshot(rows, "payload", F.col("at")).collect()
    assert len(found) == 1 and found[0].id == 1 and found[0].fault == fault
    assert (found[0].observed_at, found[0].fcst) == ((LANDED, '{"population":[],"weather":[{"b":"2"}]}') if fault is None else (None, None))


def test_fields_of_a_city_payload(spark):
    text = city(PPLTN_TIME="2026-03-02 23:40", AREA_PPLTN_MIN="-12.9", AREA_PPLTN_MAX="1e300", PPLTN_RATE_0="-", PPLTN_RATE_10=" 1.5 ", PPLTN_RATE_20="2d", PPLTN_RATE_30="", PPLTN_RATE_70="7", MALE_PPLTN_RATE="NaN", FCST_PPLTN=[{"FCST_TIME": "t"}])
    r = payloads.city_snapshot(spark.createDataFrame([(text,)], "payload string"), "payload", F.lit(None).cast("timestamp")).first()
    assert (r.observed_at, r.ppltn_min, r.ppltn_max, r.male_rate, r.congest_lvl) == (datetime(2026, 3, 2, 23, 40), -12, None, None, None)
    assert r.age_rates == {"0": None, "10": 1.5, "20": None, "30": None, "40": None, "50": None, "60": None, "70": 7.0}
    assert r.weather == {"TEMP": "3", "WIND": None}
    assert json.loads(r.fcst) == {"population": [{"FCST_TIME": "t"}], "weather": [{"b": "2"}]}
    assert payloads.city_snapshot(spark.createDataFrame([], "payload string"), "payload", F.current_timestamp()).count() == 0


def test_items_need_a_good_code_and_a_list(spark):
    item = [{"category": "TMP", "fcstDate": "20260301", "fcstTime": "1200", "fcstValue": "4"}]
    case = lambda code, items: json.dumps({"response": {"header": {"resultCode": code}, "body": {"items": {"item": items}}}})
    texts = [case("00", item), case("0", item), case("", item), case("03", item), case("00", None), case("00", []), "<xml/>", None, "{}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, payload string").select("id", payloads.forecast_items(F.col("payload")).alias("items"))
    assert {r.id: r.items if r.items is None else len(r.items) for r in rows.collect()} == {0: 1, 1: 1, 2: 1, 3: None, 4: None, 5: 0, 6: None, 7: None, 8: None}


def slot_of(spark, items, target=datetime(2026, 3, 1, 12, 30)):
    kind = "items array<struct<category string, fcstDate string, fcstTime string, fcstValue string>>, at timestamp, temp string"
    return payloads.slot_forecast(spark.createDataFrame([(items, target, "old")], kind), "items", "at").first()


def test_the_nearest_slot_counts_the_first_listed_on_a_tie(spark):
    day = "20260301"
    early, late = [("TMP", day, "1200", "5"), ("POP", day, "1200", "30")], [("TMP", day, "1300", "6")]
    assert slot_of(spark, early + late).fcst_slot == day + "1200"
    assert slot_of(spark, late + early).fcst_slot == day + "1300"
    assert slot_of(spark, early + late, datetime(2026, 3, 1, 12, 31)).temp == 6.0
    assert slot_of(spark, [("TMP", "x", None, "9"), *early]).rain_prob == 0.3


def test_values_of_a_slot(spark):
    at = lambda **v: [(k, "20260301", "1200", x) for k, x in v.items()]
    assert slot_of(spark, at(POP="30")).fcst_slot is None  # no temperature
    assert slot_of(spark, None).temp is None and slot_of(spark, []).temp is None
    r = slot_of(spark, at(TMP="20", PTY="1"))
    assert (r.rain_prob, r.label, r.precpt_type, r.feels_like) == (1.0, "비", "비", 20.0)
    r = slot_of(spark, at(TMP="20", PTY="9", SKY="4"))
    assert (r.rain_prob, r.label, r.precpt_type) == (1.0, None, "없음")
    assert slot_of(spark, at(TMP="20", SKY="0")).label == "맑음" and slot_of(spark, at(TMP="20", SKY="4", PTY="-")).label == "흐림"
    assert slot_of(spark, at(TMP="20") + at(TMP="21")).temp == 21.0  # the last value of a category


def test_feedback_reports(spark):
    shown = [(True, 1, 0.5, None), (True, None, 0.7, 1.0), (True, 0, None, None), (True, 3, 0.6, None), (False, 1, 0.2, None), (False, 2, None, None)]
    rows = spark.createDataFrame(shown, "picked boolean, rank int, a double, b double")
    assert sorted(map(tuple, feedback.rank_histogram(rows).collect())) == [(1, 1), (3, 1)]
    [gap] = feedback.term_gaps(rows, ["a", "b"]).collect()
    assert (gap.term, round(gap.picked_mean, 9), gap.passed_mean, gap.samples) == ("a", 0.6, 0.2, 4)
    assert tuple(feedback.verdict(rows).first()) == (4, 2, 0.5, "few")
    assert feedback.verdict(rows, samples=6).first().verdict == "ok" and feedback.verdict(rows, samples=6, bias=0.5).first().verdict == "biased"
    assert tuple(feedback.verdict(rows.limit(0)).first()) == (0, 0, 0.0, "few") and feedback.term_gaps(rows.limit(0), ["a"]).count() == 0
