"""Column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of an angle of the period (a day of the year divides by 365 in leap years too)."""
    angle = value * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def wind(degrees: Column) -> tuple[Column, Column]:
    return F.sin(F.radians(degrees)), F.cos(F.radians(degrees))


def clip(x: Column, lo: float, hi: float) -> Column:
    """Null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def lloyd_taylor(rref: Column, e0: Column | float, temp: Column, tref: float = 10.0, t0: float = -46.02) -> Column:
    """Respiration at a temperature in C; rref is that at 10 C."""
    e0 = F.lit(float(e0)) if not isinstance(e0, Column) else e0
    return rref * F.exp(e0 * (F.lit(1 / (tref - t0)) - 1 / (temp - F.lit(t0))))


def gpp(reco: Column, nee: Column, rg: Column) -> Column:
    """max(Reco - NEE, 0) by day, null without flux; 0 at night."""
    return F.when(rg < 20, 0.0).otherwise(F.when(nee.isNotNull() & reco.isNotNull(), F.greatest(reco - nee, F.lit(0.0))))


def low_turbulence(rg: Column, ustar: Column, threshold: Column | float) -> Column:
    return ((rg < 20) & (ustar < threshold)).cast("int")


def doy_distance(a: Column, b: Column) -> Column:
    return F.least(F.abs(a - b), 365 - F.abs(a - b))


def smear(z: Column, quantiles: Column) -> Column:
    """Mean of sinh(z + q) over residual quantiles."""
    return F.aggregate(F.transform(quantiles, lambda q: F.sinh(z + q)), F.lit(0.0), lambda a, x: a + x) / F.size(quantiles)


def conformal_level(n: Column, alpha: float = 0.1) -> Column:
    return F.least(F.lit(1.0), F.ceil((n + 1) * F.lit(1 - alpha)) / n)


def moving_average(arr: Column, k: int) -> Column:
    """Centred over k values, the ends repeated."""
    half = k // 2
    padded = F.concat(F.array_repeat(F.element_at(arr, 1), half), arr, F.array_repeat(F.element_at(arr, -1), half))
    return F.transform(arr, lambda _, i: F.aggregate(F.slice(padded, i + 1, F.lit(k)), F.lit(0.0), lambda a, x: a + x) / k)


def parse_time(c: Column, *formats: str) -> Column:
    """The first format that fits; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])
