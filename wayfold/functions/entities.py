"""Character references of HTML decoded in one pass, as a column.

A text is split at &; the head of each following piece is a numeric reference, a named one (with or without its semicolon; of a name that is
none, the longest beginning that may stand without one), or no reference at all, and then the & comes back. What a
reference decodes to is never read again. Names and replacements of forbidden numbers come from the standard library's tables.
"""

from __future__ import annotations

import html
import json
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of texts, wider than a regular expression's \\s.
WHITE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
NUMERIC, NAMED = r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", r"^[^\t\n\f <&#;]{1,32};?"


@cache
def names() -> dict[str, str]:
    return dict(html5)


@cache
def short_names() -> dict[str, str]:
    """Names that may stand without a semicolon."""
    return {k: v for k, v in html5.items() if not k.endswith(";")}


@cache
def forbidden() -> dict[int, str]:
    """Numbers that do not stand for their character: controls, and what is no character."""
    some = [*range(0xA0), *range(0xFDD0, 0xFDF0), *(p + e for p in range(0, 0x110000, 0x10000) for e in (0xFFFE, 0xFFFF))]
    return {n: c for n in some if (c := html.unescape(f"&#{n};")) != chr(n)}


def _table(values: dict) -> Column:
    return F.from_json(F.lit(json.dumps({str(k): v for k, v in values.items()})), "map<string,string>")


def _character(number: Column) -> Column:
    other = F.element_at(_table(forbidden()), number.cast("string"))
    plain = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.when(number.isNull() | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF), "�").when(other.isNotNull(), other).otherwise(plain)


def _decoded(piece: Column) -> Column:
    rest = lambda of: F.substr(piece, F.length(of) + 1)
    number = F.regexp_extract(piece, NUMERIC, 0)
    digits = F.regexp_replace(number, "[#xX;]", "")
    short = F.length(F.regexp_replace(digits, "^0+", "")) <= 8
    value = F.when(short, F.when(number.rlike("^#[xX]"), F.conv(F.right(digits, F.lit(9)), 16, 10)).otherwise(F.right(digits, F.lit(9)))).try_cast("bigint")
    name = F.regexp_extract(piece, NAMED, 0)
    longest = max(map(len, short_names()))
    begins = F.transform(F.sequence(F.lit(longest), F.lit(2), F.lit(-1)), lambda n: F.when(n < F.length(name), F.substr(name, F.lit(1), n)))
    begin = F.get(F.filter(begins, lambda b: b.isNotNull() & F.element_at(_table(short_names()), b).isNotNull()), F.lit(0))
    whole = F.element_at(_table(names()), name)
    return (
        F.when(number != "", F.concat(_character(value), rest(number)))
        .when((name != "") & whole.isNotNull(), F.concat(whole, rest(name)))
        .when(begin.isNotNull(), F.concat(F.element_at(_table(short_names()), begin), rest(begin)))
        .otherwise(F.concat(F.lit("&"), piece))
    )


def unescaped(text: Column) -> Column:
    pieces = F.split(text, "&", -1)
    decoded = F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), _decoded), ""))
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def _quoted(value: str) -> str:
    """A DuckDB string, control characters and quotes by number."""
    return "'" + value.replace("'", "''") + "'" if value.isprintable() and value else "(" + (" || ".join(f"chr({ord(c)})" for c in value) or "''") + ")"


def unescaped_sql(text: str) -> str:
    """The same in DuckDB."""
    table = lambda d: f"MAP([{', '.join(_quoted(str(k)) for k in d)}], [{', '.join(map(_quoted, d.values()))}])"
    number, name = "regexp_extract(p, '^#([0-9]+|[xX][0-9a-fA-F]+);?')", "regexp_extract(p, '^[^\\t\\n\\f <&#;]{1,32};?')"
    value = f"CASE WHEN regexp_matches({number}, '^#[xX]') THEN TRY_CAST('0x' || regexp_replace({number}, '[#xX;]', '', 'g') AS BIGINT) ELSE TRY_CAST(regexp_replace({number}, '[#;]', '', 'g') AS BIGINT) END"
    character = f"CASE WHEN ({value}) IS NULL OR ({value}) > 1114111 OR ({value}) BETWEEN 55296 AND 57343 THEN chr(65533) ELSE coalesce(t.forbidden[({value})::VARCHAR], chr(({value})::INT)) END"
    begin = f"list_filter(list_transform([6, 5, 4, 3, 2], lambda n: CASE WHEN n < length({name}) THEN left({name}, n) END), lambda b: b IS NOT NULL AND t.short[b] IS NOT NULL)[1]"
    piece = f"CASE WHEN {number} <> '' THEN {character} || substr(p, length({number}) + 1) WHEN t.names[{name}] IS NOT NULL THEN t.names[{name}] || substr(p, length({name}) + 1) WHEN {begin} IS NOT NULL THEN t.short[{begin}] || substr(p, length({begin}) + 1) ELSE '&' || p END"
    tables = f"(SELECT {table(names())} AS names, {table(short_names())} AS short, {table(forbidden())} AS forbidden)"
    return f"(SELECT string_split({text}, '&')[1] || list_aggregate(list_concat([''], list_transform(string_split({text}, '&')[2:], lambda p: {piece})), 'string_agg', '') FROM {tables} t)"
