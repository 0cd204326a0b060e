"""Numbers: distances on the globe, the normal law, interpolation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
# A rational approximation of the normal quantile (relative error below 1.15e-9).
A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01]
C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    up, over = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(up) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(over) ** 2
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    inside = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return lat.between(south, north) & inside


def polynomial(coefficients: list[float], x: Column) -> Column:
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """The value below which a standard normal lies with probability p; null outside (0, 1)."""
    low = 0.02425
    tail = lambda q: polynomial(C, q) / (polynomial(D, q) * q + 1)
    q = p - 0.5
    middle = polynomial(A, q * q) * q / (polynomial(B, q * q) * q * q + 1)
    return (
        F.when((p <= 0) | (p >= 1), None)
        .when(p < low, tail(F.sqrt(-2 * F.log(F.greatest(p, F.lit(1e-300))))))
        .when(p > 1 - low, -tail(F.sqrt(-2 * F.log(F.greatest(1 - p, F.lit(1e-300))))))
        .otherwise(middle)
    )


def normal_cdf(x: Column) -> Column:
    """Probability that a standard normal is below x (absolute error below 7.5e-8)."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    upper = density * polynomial([1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530], t) * t
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def interpolate(x: Column, knots: list[float], values: list[float]) -> Column:
    """Piecewise linear through the knots, constant outside."""
    out = F.when(x <= knots[0], F.lit(float(values[0])))
    for a, b, u, v in zip(knots, knots[1:], values, values[1:], strict=False):
        out = out.when(x <= b, u + (x - a) * ((v - u) / (b - a) if b > a else 0.0))
    return out.otherwise(F.lit(float(values[-1])))


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of the chi-squared law, by the incomplete gamma function's series or continued fraction."""
    if x <= 0 or df <= 0:
        return 1.0
    a, z = df / 2, x / 2
    scale = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - total * scale)
    b, c = z + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale
