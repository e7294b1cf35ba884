"""Score terms as columns. An unknown live term is null and drops out; any other unknown term is neutral."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold import constants as K
from wayfold.functions.rounding import rounded
from wayfold.functions.columns import clip01, lookup


def context_fit(exposure: Column, rain: Column, pm: Column, feels: Column, hour: Column, sunset: Column, sensitivity: Column) -> Column:
    """0 to 1.5 around a neutral 1: each weather condition scales by the outdoor exposure (unknown: 0)."""
    e = F.coalesce(exposure, F.lit(0.0))
    coefficient = lookup(sensitivity, K.RAIN_COEFFICIENT, F.lit(0.7))
    fit = (
        F.when(rain > 0.3, 1 - coefficient * e * F.least(rain, F.lit(1.0))).otherwise(1.0)
        * F.when(pm >= 3, 1 - 0.5 * e).otherwise(1.0)
        * F.when((feels > 31) | (feels < -5), 1 - 0.6 * e).otherwise(1.0)
        * F.when((rain < 0.2) & feels.between(15, 25), 1 + 0.4 * e).otherwise(1.0)
        * F.when(hour >= sunset, 1 - 0.3 * e).otherwise(1.0)
    )
    return F.least(F.greatest(fit, F.lit(0.0)), F.lit(1.5))


def apparent_temperature(t: Column, humidity: Column, wind: Column) -> Column:
    """Heat index from 27 degrees, wind chill up to 10 degrees with wind, else the temperature; unrounded."""
    f = t * 9 / 5 + 32
    # fixed values: coefficients of the heat index in (Fahrenheit, humidity) and of the wind chill
    index = (
        F.lit(-42.379) + 2.04901523 * f + 10.14333127 * humidity - 0.22475541 * f * humidity - 6.83783e-3 * f * f
        - 5.481717e-2 * humidity * humidity + 1.22874e-3 * f * f * humidity + 8.5282e-4 * f * humidity * humidity - 1.99e-6 * f * f * humidity * humidity
    )
    v = F.pow(wind * 3.6, F.lit(0.16))
    chill = F.lit(13.12) + 0.6215 * t - 11.37 * v + 0.3965 * t * v
    return F.when((t >= 27) & humidity.isNotNull(), (index - 32) * 5 / 9).when((t <= 10) & (wind >= 1.3), chill).otherwise(t)


def purpose_match(tags: Column, purpose: Column) -> Column:
    return F.when(F.coalesce(F.size(tags), F.lit(0)) <= 0, K.NEUTRAL).when(F.get(tags, F.lit(0)) == purpose, 0.95).when(F.array_contains(tags, purpose), 0.80).otherwise(0.35)


def taste_term(similarity: Column) -> Column:
    return F.coalesce(clip01(similarity), F.lit(K.NEUTRAL))


def segment_term(affinity: Column, reference: Column) -> Column:
    a = F.greatest(affinity, F.lit(0.0))
    return F.when(affinity.isNull() | reference.isNull() | (reference <= 0), K.NEUTRAL).otherwise(clip01(a / (a + reference)))


def quality_term(quality: Column) -> Column:
    return F.coalesce(clip01(quality), F.lit(K.NEUTRAL))


def live_match(rate: Column, band: Column) -> Column:
    """Share of the age band against its baseline, halved; rates above 1 are percents."""
    return clip01(F.when(rate > 1.0, rate / 100.0).otherwise(rate) / lookup(band, K.AGE_BASELINE) / 2.0)


def crowd_fit(level: Column, purpose: Column) -> Column:
    neutral = F.lit(K.CROWD_NEUTRAL)
    return (
        F.when(level.isNull() | (level == ""), None)
        .when(purpose.isin(*K.QUIET_PURPOSES), lookup(level, K.CROWD_QUIET, neutral))
        .when(purpose.isin(*K.LIVELY_PURPOSES), lookup(level, K.CROWD_LIVELY, neutral))
        .otherwise(neutral)
    )


def renormalised(terms: dict[str, Column]) -> Column:
    """Weighted mean of the known terms over their weights; 0 if none is known."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, term in terms.items():
        total = total + F.coalesce(term * K.WEIGHTS[name], F.lit(0.0))
        weight = weight + F.when(term.isNotNull(), K.WEIGHTS[name]).otherwise(0.0)
    return F.when(weight > 0, total / weight).otherwise(0.0)


def distance_penalty(metres: Column, rain: Column) -> Column:
    """metres: zone-weighted distance."""
    return F.least(F.least(metres / K.DISTANCE_NORM_M, F.lit(1.0)) * F.when(rain > 0.5, 2.0).otherwise(1.0), F.lit(1.0))


def total_score(base: Column, penalty: Column) -> Column:
    return clip01(base - K.DISTANCE_WEIGHT * penalty)


def weather_state(rain: Column, pm: Column, feels: Column) -> Column:
    return F.when(rain > 0.3, K.WEATHER_STATES[1]).when(pm >= 3, K.WEATHER_STATES[2]).when((feels > 31) | (feels < -5), K.WEATHER_STATES[3]).otherwise(K.WEATHER_STATES[0])


#: Fields of a place's attributes, by how they can be without a value.
ATTRIBUTES = {"outdoor_exposure": "value", "group_capacity": "value", "noise_level": "text", "purpose_tags": "list", "atmosphere_tags": "list", "price_band": "value", "wait_intensity": "text", "business_hours_hint": "object", "sentiment_score": "value"}


def without_value(field: Column, kind: str) -> Column:
    """Null, a blank text, an empty list, or a JSON object of which no member has a value."""
    empty = {
        "value": lambda: F.lit(False),
        "text": lambda: F.trim(field) == "",
        "list": lambda: F.size(field) == 0,
        "object": lambda: F.size(F.filter(F.map_values(F.from_json(field, "map<string,string>")), lambda v: F.coalesce(F.trim(v) != "", F.lit(False)))) <= 0,
    }[kind]()
    return field.isNull() | F.coalesce(empty, F.lit(False))


def attr_confidence(clean_reviews: Column, missing: Column) -> Column:
    """clean_reviews: relevant and not sponsored; missing: how many of the ATTRIBUTES have no value."""
    return F.greatest(rounded(F.least(clean_reviews / 8.0, F.lit(1.0)) - missing * F.lit(0.08), 3), F.lit(0.0))
