"""Rounding of doubles as a decimal reading of their exact binary value has it, halves to even.

x * 10**n is rarely a double. Its rounded product p and the exact error e (both factors are split into halves of 26 bits, whose
products are exact) say on which side of a half the true product lies; only where p + e is a half itself does the even neighbour
count. 2.675 at two digits is 2.67, as the double lies below; 0.125 is 0.12.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT = 134217729.0  # 2**27 + 1


def _halves(x: float) -> tuple[float, float]:
    high = SPLIT * x - (SPLIT * x - x)
    return high, x - high


def rounded(x: Column, digits: int = 0) -> Column:
    """x (below 2**53 / 10**digits in size) at so many digits, as a double; null stays null, as do infinities and NaN."""
    x, scale = x.cast("double"), 10.0**digits
    above, below = _halves(scale)
    high = SPLIT * x - (SPLIT * x - x)
    low = x - high
    p = x * scale
    error = ((high * above - p) + high * below + low * above) + low * below
    floor = F.floor(p).cast("double")
    side = (p - floor - 0.5) + error
    up = F.when(side > 0, 1.0).when(side < 0, 0.0).otherwise(F.pmod(floor, F.lit(2.0)))
    return F.when(F.abs(x) < 2.0**53 / scale, (floor + up) / scale).otherwise(x)


def rounded_sql(x: str, digits: int = 0) -> str:
    """The same in DuckDB."""
    scale = 10.0**digits
    above, below = (f"{v!r}::DOUBLE" for v in _halves(scale))
    split, ten = f"{SPLIT!r}::DOUBLE", f"{scale!r}::DOUBLE"
    high = f"({split} * x - ({split} * x - x))"
    error = f"((({high} * {above} - x * {ten}) + {high} * {below} + (x - {high}) * {above}) + (x - {high}) * {below})"
    side = f"((x * {ten} - floor(x * {ten}) - 0.5::DOUBLE) + {error})"
    return f"(SELECT (floor(x * {ten}) + CASE WHEN {side} > 0 THEN 1 WHEN {side} < 0 THEN 0 ELSE abs(floor(x * {ten}) % 2) END) / {ten} FROM (SELECT ({x})::DOUBLE AS x))"
