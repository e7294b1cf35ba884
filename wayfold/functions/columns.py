"""Null-safe column helpers: text, numbers, time, space, vectors."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold import constants as K
from wayfold.functions.entities import WHITE, stripped, unescaped


def clip01(x: Column) -> Column:
    """x within 0..1; unknown stays unknown (greatest and least alone would skip a null)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def lookup(of: Column, table: dict, default: Column | None = None) -> Column:
    """Value of a small fixed table, as a chain of conditions."""
    out: Column | None = None
    for key, value in table.items():
        out = F.when(of == F.lit(key), F.lit(value)) if out is None else out.when(of == F.lit(key), F.lit(value))
    return out.otherwise(default) if default is not None else out


def normalised(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^0-9a-z가-힣]", "")


def clean_html(text: Column) -> Column:
    """Entities, then tags, then white space."""
    tagless = F.regexp_replace(unescaped(F.coalesce(text, F.lit(""))), "<[^>]+>", "")
    return stripped(F.regexp_replace(tagless, f"{WHITE}+", " "))


def clean_html_tags_first(text: Column) -> Column:
    """Tags, then entities: an escaped tag survives."""
    return stripped(unescaped(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", "")))


def first_number(text: Column) -> Column:
    """First number in a text, or null."""
    return F.nullif(F.regexp_extract(text, r"-?\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double")


def specificity(name: Column) -> Column:
    n = F.length(normalised(name))
    return F.when(n <= 1, 0.2).when(n == 2, 0.4).when(n == 3, 0.6).when(n == 4, 0.8).otherwise(1.0)


def bounded_name(name: Column) -> Column:
    """Pattern of a name whose characters may be parted by space and signs and that stands alone."""
    chars = F.regexp_replace(normalised(name), "(.)(?=.)", r"$1[\\s\\p{Punct}_]*")
    return F.concat(F.lit("(?iU)(^|[^0-9a-z가-힣])"), chars, F.lit("($|[^0-9a-z가-힣])"))


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres."""
    p, q = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * K.EARTH_RADIUS_M) * F.asin(F.sqrt(a))


def grid(lat: Column, lng: Column) -> tuple[Column, Column]:
    """Cell of a 5 km Lambert conformal grid (parallels 30 and 60, origin 126 E 38 N at cell 43, 136)."""
    rad = math.pi / 180
    re, s1, s2, lon, lat0 = 6371.00877 / 5.0, 30 * rad, 60 * rad, 126 * rad, 38 * rad
    tan = lambda x: math.tan(math.pi / 4 + x / 2)
    n = math.log(math.cos(s1) / math.cos(s2)) / math.log(tan(s2) / tan(s1))
    f = tan(s1) ** n * math.cos(s1) / n
    r0 = re * f / tan(lat0) ** n
    r = F.lit(re * f) / F.pow(F.tan(F.lit(math.pi / 4) + lat * rad / 2), F.lit(n))
    t = (lng * rad - lon) * n
    return F.floor(r * F.sin(t) + 43.5), F.floor(F.lit(r0) - r * F.cos(t) + 136.5)


def resistance(a: Column, b: Column) -> Column:
    """Zone multiplier of a walk; 1 within a zone or if either is unknown."""
    out = F.when(a.isNull() | b.isNull() | (a == b), F.lit(1.0))
    for (x, y), value in K.ZONE_RESISTANCE.items():
        out = out.when(((a == x) & (b == y)) | ((a == y) & (b == x)), F.lit(value))
    return out.otherwise(F.lit(1.0))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it (inside a lambda nothing is shared)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null if either is missing, zero, or of another length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), once(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), lambda norm: F.when(norm > 0, dot(a, b) / norm)))


def hour_band(hour: Column) -> Column:
    h = F.least(F.greatest(hour, F.lit(0)), F.lit(23))
    out = F.lit(0)
    for band, start in enumerate(K.HOUR_BAND_STARTS):
        out = F.when(h >= start, F.lit(band)).otherwise(out)
    return out


def party_band(size: Column) -> Column:
    return F.when(size.between(1, 2), 1).when(size.between(3, 4), 2).otherwise(3)


def dow_type(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def minutes_of(clock: Column) -> Column:
    """Minutes after midnight of H:MM or HH:MM up to 24:00, else null."""
    h, m = F.substring_index(clock, ":", 1).try_cast("int"), F.substring_index(clock, ":", -1).try_cast("int")
    return F.when(F.rlike(clock, F.lit("^[0-9]{1,2}:[0-9]{2}$")) & ((h < 24) & (m < 60) | (h == 24) & (m == 0)), h * 60 + m)


def within_hours(o: Column, c: Column, minute: Column) -> Column:
    """Half-open hours in minutes; a close at or before the open runs overnight; unknown or malformed counts as open."""
    return F.when(o.isNull() | c.isNull(), True).when(c <= o, (minute >= o) | (minute < c)).otherwise((minute >= o) & (minute < c))


#: Keys of the opening hours, Sunday first.
DAYS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")


def day_key(local: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, DAYS)), F.dayofweek(local))


def week_of(hours: Column) -> Column:
    """Opening and closing minutes by weekday of a JSON object of [open, close]; an entry that is no list of two, or
    a malformed time, has nulls."""

    def entry(text: Column) -> Column:
        times = F.when(F.startswith(text, F.lit("[")), F.split(F.translate(text, '[]"', ""), ","))
        return once(times, lambda t: F.struct(minutes_of(F.get(t, F.lit(0))).alias("o"), minutes_of(F.get(t, F.lit(1))).alias("c")))

    return F.transform_values(F.from_json(hours, "map<string,string>"), lambda _, v: entry(v))


def is_open_on(week: Column, day: Column, minute: Column) -> Column:
    """Whether a parsed week has that minute of the day open. No hours and no entry count as open."""
    entry = F.try_element_at(week, day)
    return within_hours(entry["o"], entry["c"], minute)


def is_open_at(hours: Column, at: Column, zone: str = "Asia/Seoul") -> Column:
    """is_open_on at a UTC instant, read in the local time of zone."""
    local = F.from_utc_timestamp(at, zone)
    return is_open_on(week_of(hours), day_key(local), F.hour(local) * 60 + F.minute(local))


def iso_time(text: Column, now: Column, zone: str = "Asia/Seoul") -> Column:
    """An instant from ISO text; without an offset it is local time of zone; what cannot be read is now."""
    offset = F.rlike(text, F.lit("(Z|[+-][0-9]{2}:?[0-9]{2})$"))
    read = F.try_to_timestamp(text)
    return F.coalesce(F.when(offset, read).otherwise(F.to_utc_timestamp(read, zone)), now)


def poll_time(text: Column, now: Column, zone: str = "Asia/Seoul") -> Column:
    """An instant from local 'yyyy-MM-dd HH:mm'; empty or unreadable text is now."""
    return F.coalesce(F.to_utc_timestamp(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm")), zone), now)


def merged(*objects: Column) -> Column:
    """Maps merged key by key; the later one wins; a null map changes nothing."""
    empty = F.create_map().cast("map<string,string>")
    out = empty
    for x in objects:
        out = F.map_zip_with(out, F.coalesce(x, empty), lambda _, a, b: F.coalesce(b, a))
    return out


def publish_slot(ts: Column) -> Column:
    """Latest forecast issue (02, 05, ..., 23 h) that has been out for 15 minutes."""
    t = ts - F.expr("interval 15 minutes")
    issue = (F.floor((F.hour(t) - 2) / 3) * 3 + 2).cast("int")
    return F.when(F.hour(t) < 2, F.concat(F.date_format(F.date_sub(t, 1), "yyyyMMdd"), F.lit(" 2300"))).otherwise(F.concat(F.date_format(t, "yyyyMMdd"), F.lit(" "), F.lpad(issue.cast("string"), 2, "0"), F.lit("00")))


def air_grade(pm25: Column, pm10: Column, index: Column) -> Column:
    """Grade by the fine dust, else by the coarse, else by the word of the index."""
    return F.coalesce(pm_grade(pm25), pm_grade(pm10, K.PM10_BOUNDS), lookup(index, K.AIR_GRADES))


def pm_grade(value: Column, bounds: tuple[int, int, int] = K.PM25_BOUNDS) -> Column:
    """Grade 1..4 of a concentration, upper bounds included; negative or unknown gives null."""
    return F.when(value < 0, None).when(value <= bounds[0], 1).when(value <= bounds[1], 2).when(value <= bounds[2], 3).when(value.isNotNull(), 4)
