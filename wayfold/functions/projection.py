"""Transverse Mercator both ways as columns: the series in the third flattening to its fourth power, good to a micrometre within some
hundreds of kilometres of the central meridian."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Ellipsoid (half axis, inverse flattening), origin in degrees, scale, and the origin's easting and northing in metres."""

    axis: float
    inverse_flattening: float
    lat: float
    lng: float
    scale: float
    east: float
    north: float

    @property
    def n(self) -> float:
        f = 1 / self.inverse_flattening
        return f / (2 - f)

    @property
    def e(self) -> float:
        f = 1 / self.inverse_flattening
        return math.sqrt(f * (2 - f))

    @property
    def radius(self) -> float:
        n = self.n
        return self.scale * self.axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    @property
    def forward(self) -> list[float]:
        n = self.n
        return [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]

    @property
    def back(self) -> list[float]:
        n = self.n
        return [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]

    @property
    def latitude(self) -> list[float]:
        n = self.n
        return [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]

    @property
    def base(self) -> float:
        """The origin's distance along the meridian, in radii."""
        s = math.sin(math.radians(self.lat))
        x = math.atan(math.sinh(math.atanh(s) - self.e * math.atanh(self.e * s)))
        return x + sum(a * math.sin(2 * (j + 1) * x) for j, a in enumerate(self.forward))


#: Public grids: Korea 2000 unified, Korea 2000 central belt 2010's predecessor, and the British national grid (for control points).
UNIFIED = Grid(6378137.0, 298.257222101, 38.0, 127.5, 0.9996, 1_000_000.0, 2_000_000.0)
CENTRAL = Grid(6378137.0, 298.257222101, 38.0, 127.0, 1.0, 200_000.0, 500_000.0)
BRITISH = Grid(6377563.396, 299.3249646, 49.0, -2.0, 0.9996012717, 400_000.0, -100_000.0)


def to_grid(lat: Column, lng: Column, grid: Grid) -> Column:
    """Struct of east and north in metres."""
    s, turn = F.sin(F.radians(lat)), F.radians(lng - grid.lng)
    t = F.sinh(F.atanh(s) - F.atanh(s * grid.e) * grid.e)
    first = F.array(F.struct(F.atan2(t, F.cos(turn)).alias("x"), F.atanh(F.sin(turn) / F.sqrt(t * t + 1)).alias("y")))

    def point(p: Column) -> Column:
        x = p["x"] + sum(F.sin(p["x"] * (2 * j)) * F.cosh(p["y"] * (2 * j)) * a for j, a in enumerate(grid.forward, 1))
        y = p["y"] + sum(F.cos(p["x"] * (2 * j)) * F.sinh(p["y"] * (2 * j)) * a for j, a in enumerate(grid.forward, 1))
        return F.struct((y * grid.radius + grid.east).alias("east"), ((x - grid.base) * grid.radius + grid.north).alias("north"))

    return F.get(F.transform(first, point), F.lit(0))


def from_grid(east: Column, north: Column, grid: Grid) -> Column:
    """Struct of lat and lng in degrees."""
    first = F.array(F.struct(((north - grid.north) / grid.radius + grid.base).alias("x"), ((east - grid.east) / grid.radius).alias("y")))

    def point(p: Column) -> Column:
        x = p["x"] - sum(F.sin(p["x"] * (2 * j)) * F.cosh(p["y"] * (2 * j)) * b for j, b in enumerate(grid.back, 1))
        y = p["y"] - sum(F.cos(p["x"] * (2 * j)) * F.sinh(p["y"] * (2 * j)) * b for j, b in enumerate(grid.back, 1))
        return F.struct(F.asin(F.sin(x) / F.cosh(y)).alias("chi"), F.atan2(F.sinh(y), F.cos(x)).alias("turn"))

    def place(p: Column) -> Column:
        lat = p["chi"] + sum(F.sin(p["chi"] * (2 * j)) * d for j, d in enumerate(grid.latitude, 1))
        return F.struct(F.degrees(lat).alias("lat"), (F.degrees(p["turn"]) + grid.lng).alias("lng"))

    return F.get(F.transform(F.transform(first, point), place), F.lit(0))


def to_grid_sql(lat: str, lng: str, grid: Grid) -> tuple[str, str]:
    """East and north in DuckDB."""
    s, turn = f"sin(radians({lat}))", f"radians({lng} - {grid.lng!r})"
    t = f"sinh(atanh({s}) - {grid.e!r} * atanh({grid.e!r} * {s}))"
    x, y = f"atan2({t}, cos({turn}))", f"atanh(sin({turn}) / sqrt(1 + {t} * {t}))"
    north = " + ".join([x, *(f"{a!r} * sin({2 * j} * {x}) * cosh({2 * j} * {y})" for j, a in enumerate(grid.forward, 1))])
    east = " + ".join([y, *(f"{a!r} * cos({2 * j} * {x}) * sinh({2 * j} * {y})" for j, a in enumerate(grid.forward, 1))])
    return f"({grid.east!r} + {grid.radius!r} * ({east}))", f"({grid.north!r} + {grid.radius!r} * (({north}) - {grid.base!r}))"
