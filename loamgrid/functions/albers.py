"""Albers equal-area projection (EPSG:5070) as plain arithmetic of columns.

Snyder's formulas for the ellipsoid, GRS80, standard parallels 29.5 and 45.5,
origin 23 N 96 W.
"""

from __future__ import annotations

from math import cos, log, radians, sin, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

AXIS, FLATTENING = 6378137.0, 1 / 298.257222101
E2 = FLATTENING * (2 - FLATTENING)
E = sqrt(E2)


def _q(phi: float) -> float:
    s = sin(phi)
    return (1 - E2) * (s / (1 - E2 * s * s) - log((1 - E * s) / (1 + E * s)) / (2 * E))


def _m2(phi: float) -> float:
    return cos(phi) ** 2 / (1 - E2 * sin(phi) ** 2)


_PHI1, _PHI2, _PHI0, LON0 = radians(29.5), radians(45.5), radians(23.0), radians(-96.0)
N = (_m2(_PHI1) - _m2(_PHI2)) / (_q(_PHI2) - _q(_PHI1))
C = _m2(_PHI1) + N * _q(_PHI1)
RHO0 = AXIS * sqrt(C - N * _q(_PHI0)) / N


def to_5070(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Metres east and north of longitude and latitude in degrees."""
    s = F.sin(F.radians(lat))
    q = (1 - E2) * (s / (1 - E2 * s * s) - F.log((1 - E * s) / (1 + E * s)) / (2 * E))
    rho = AXIS * F.sqrt(C - N * q) / N
    theta = N * (F.radians(lon) - LON0)
    return rho * F.sin(theta), RHO0 - rho * F.cos(theta)


def to_4326(x, y, by=F) -> tuple:
    """Longitude and latitude in degrees, by the series in the authalic latitude; of columns, or of arrays ``by`` NumPy."""
    rho = by.sqrt(x * x + (RHO0 - y) * (RHO0 - y))
    theta = by.atan2(x, RHO0 - y)
    q = (C - rho * rho * N * N / (AXIS * AXIS)) / N
    beta = by.asin(q / (1 - (1 - E2) / (2 * E) * log((1 - E) / (1 + E))))
    e4, e6 = E2 * E2, E2 * E2 * E2
    phi = (
        beta
        + (E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * by.sin(2 * beta)
        + (23 * e4 / 360 + 251 * e6 / 3780) * by.sin(4 * beta)
        + (761 * e6 / 45360) * by.sin(6 * beta)
    )
    return by.degrees(LON0 + theta / N), by.degrees(phi)
