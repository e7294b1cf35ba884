"""Named queries and their SQL. In the SQL, v_<name> stands for a domain view and is put in front as a CTE."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayfold import constants as K
from wayfold.sources import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _values() -> str:
    show = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else repr(v)
    rows = ", ".join("(" + ", ".join(map(show, r)) + ")" for r in V.request_rows())
    return f"SELECT * FROM (VALUES {rows}) t({', '.join(V.REQUEST_COLUMNS)})"


_select = lambda columns, rest: f"SELECT {', '.join(V.aliased(columns))} FROM {rest}"
HAVERSINE = f"2 * {K.EARTH_RADIUS_M} * asin(sqrt(pow(sin(radians(lat - u_lat) / 2), 2) + cos(radians(u_lat)) * cos(radians(lat)) * pow(sin(radians(lng - u_lng) / 2), 2)))"
VIEWS = {
    "v_poi": _select(V.POI, "customer"),
    "v_hotspot": _select(V.HOTSPOT, "nation WHERE n_nationkey < 11"),
    "v_shape": _select(V.SHAPE, "nation"),
    "v_district": _select(V.DISTRICT, "region"),
    "v_user": _select(V.USER, "supplier"),
    "v_snapshot": _select(V.SNAPSHOT, "events"),
    "v_review": _select(V.REVIEW, "documents d LEFT JOIN labels l USING (doc_id)"),
    "v_sales": _select(V.SALES, "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey"),
    "v_request": _values(),
    # all pairs of a request and a place within the widest radius
    "v_near": f"SELECT * FROM (SELECT *, {HAVERSINE} AS dist FROM v_request, v_poi) WHERE dist <= {K.RADII[2]}",
}


def with_views(sql: str) -> str:
    """sql with the views it uses, and those they use, as CTEs."""
    used: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bv_\w+", text):
            if name in VIEWS and name not in used:
                need(VIEWS[name])
                used.append(name)

    need(sql)
    ctes = [f"{n} AS ({VIEWS[n]})" for n in used]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join([*ctes, body[5:]])
    return ("WITH " + ", ".join(ctes) + " " if ctes else "") + body


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return f

    return add
