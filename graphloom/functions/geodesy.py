"""Distances on the WGS84 ellipsoid."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The ellipsoid's fixed values: half axes in metres and flattening.
A, FLAT = 6378137.0, 1 / 298.257223563
B = A * (1 - FLAT)
E2 = FLAT * (2 - FLAT)


def inverse(lat1, lon1, lat2, lon2) -> np.ndarray:
    """Metres between points in degrees, by Vincenty's inverse formula on whole arrays.

    Nearly antipodal pairs for which it doesn't converge get the distance on a sphere of mean radius.
    """
    u1, u2 = np.arctan((1 - FLAT) * np.tan(np.radians(lat1))), np.arctan((1 - FLAT) * np.tan(np.radians(lat2)))
    gap = np.radians((np.asarray(lon2, float) - lon1 + 180) % 360 - 180)
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = gap.copy()
    with np.errstate(all="ignore"):
        for _ in range(100):
            sin_s = np.hypot(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam))
            cos_s = s1 * s2 + c1 * c2 * np.cos(lam)
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s == 0, 0.0, c1 * c2 * np.sin(lam) / sin_s)
            cos2_a = 1 - sin_a**2
            cos_m = np.where(cos2_a <= 1e-24, 0.0, cos_s - 2 * s1 * s2 / cos2_a)
            c = FLAT / 16 * cos2_a * (4 + FLAT * (4 - 3 * cos2_a))
            new = gap + (1 - c) * FLAT * sin_a * (sigma + c * sin_s * (cos_m + c * cos_s * (2 * cos_m**2 - 1)))
            done = np.abs(new - lam) < 1e-12
            lam = new
            if np.all(done | ~np.isfinite(new)):
                break
        w = cos2_a * (A**2 - B**2) / B**2
        k = 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w)))
        q = w / 1024 * (256 + w * (-128 + w * (74 - 47 * w)))
        twist = q * sin_s * (cos_m + q / 4 * (cos_s * (2 * cos_m**2 - 1) - q / 6 * cos_m * (4 * sin_s**2 - 3) * (4 * cos_m**2 - 3)))
        out = B * k * (sigma - twist)
        half = np.sin(np.radians(np.subtract(lat2, lat1)) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(gap / 2) ** 2
        sphere = 2 * (2 * A + B) / 3 * np.arcsin(np.minimum(1, np.sqrt(half)))
    return np.where(done & np.isfinite(out), out, sphere)


@F.pandas_udf(T.DoubleType())
def metres(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    return pd.Series(inverse(*(s.to_numpy(float) for s in (lat1, lon1, lat2, lon2))))


#: Codes of geographic systems, whose coordinates are degrees; those of other systems are taken for metres (or for what
#: ``unit`` says that one of them is in metres).
GEOGRAPHIC = (4001, 4999)


def projected(srid: Column) -> Column:
    """Whether a system's coordinates are lengths. No system is the geographic one."""
    return F.coalesce((srid > 0) & ~srid.between(*GEOGRAPHIC), F.lit(False))


def _reduced(latitude: Column) -> Column:
    return F.atan((1 - FLAT) * F.tan(F.radians(latitude)))


def _half(b1: Column, b2: Column, lon1: Column, lon2: Column) -> Column:
    """Half of the angle between two points of the sphere of reduced latitudes."""
    return F.asin(F.least(F.lit(1.0), F.sqrt(F.pow(F.sin((b2 - b1) / 2), 2) + F.cos(b1) * F.cos(b2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2))))


def lambert_of(half: Column, b1: Column, b2: Column) -> Column:
    """Lambert's closed formula from half the angle and the reduced latitudes."""
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    x = (2 * half - F.sin(2 * half)) * F.pow(F.sin(p), 2) * F.pow(F.cos(q), 2) / F.pow(F.cos(half), 2)
    y = (2 * half + F.sin(2 * half)) * F.pow(F.cos(p), 2) * F.pow(F.sin(q), 2) / F.pow(F.sin(half), 2)
    return F.when(half == 0, 0.0).otherwise(A * (2 * half - (x + y) * FLAT / 2))


def lambert(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between points in degrees by Lambert's closed formula, as SQL can write it: within half a metre of metres() at
    250 km, some ten metres at thousands."""
    b1, b2 = _reduced(lat1), _reduced(lat2)
    return lambert_of(_half(b1, b2, lon1, lon2), b1, b2)


def sphere(mark: str) -> dict[str, Column]:
    """What pairs of points need of each one (columns <mark>cx, <mark>cy in degrees): reduced latitude phi, and its place on the
    unit sphere of reduced latitudes."""
    phi, lon = _reduced(F.col(f"{mark}cy")), F.radians(F.col(f"{mark}cx"))
    return {f"{mark}phi": phi, f"{mark}ux": F.cos(phi) * F.cos(lon), f"{mark}uy": F.cos(phi) * F.sin(lon), f"{mark}uz": F.sin(phi)}


def half_of(one: str, two: str) -> Column:
    """_half() of two points by their columns."""
    return _half(F.col(f"{one}phi"), F.col(f"{two}phi"), F.col(f"{one}cx"), F.col(f"{two}cx"))


def chord2(one: str, two: str) -> Column:
    """The square of the chord between two places on the unit sphere."""
    dx, dy, dz = (F.col(f"{one}{u}") - F.col(f"{two}{u}") for u in ("ux", "uy", "uz"))
    return dx * dx + dy * dy + dz * dz


def chords(metres: float) -> tuple[float, float]:
    """Squares of chords: points nearer than the first are less than metres apart by Lambert's formula, those as far as the
    second aren't.

    With h half the angle, the formula's x is at most 2h - sin 2h and its y at most 2h + sin 2h, and neither is negative: so a
    distance lies between 2hA(1 - FLAT) and 2hA. A billionth of slack is for rounding.
    """
    side = lambda h: 4 * math.sin(min(max(h, 0.0), math.pi / 2)) ** 2
    return side(metres / (2 * A)) * (1 - 1e-9) - 1e-15, side(metres / (2 * A * (1 - FLAT))) * (1 + 1e-9) + 1e-15


def distance(one: Column, two: Column, closed: bool = False) -> Column:
    """Metres between the centroids of two parsed geometries: of one projected system in its plane, else with x as longitude and
    y as latitude; by Lambert's formula where ``closed`` says so."""
    flat = projected(one["srid"]) & (one["srid"] == two["srid"])
    plane = F.hypot(one["cx"] - two["cx"], one["cy"] - two["cy"])
    at = lambda g, c: F.when(~flat, g[c])
    return F.when(flat, plane).otherwise((lambert if closed else metres)(at(one, "cy"), at(one, "cx"), at(two, "cy"), at(two, "cx")))


def degrees(distance: Column, latitude: Column) -> tuple[Column, Column]:
    """(longitude, latitude) degrees that a distance in metres spans at a latitude; latitudes beyond the poles are theirs."""
    phi = F.radians(F.least(F.greatest(latitude, F.lit(-90.0)), F.lit(90.0)))
    w = 1 - E2 * F.pow(F.sin(phi), 2)
    meridian, normal = A * (1 - E2) / F.pow(w, 1.5), A / F.sqrt(w)
    across = normal * F.greatest(F.cos(phi), F.lit(1e-12))
    return F.least(F.degrees(distance / across), F.lit(360.0)), F.least(F.degrees(distance / meridian), F.lit(180.0))


def buffered(box: Column, distance: Column, srid: Column | None = None, unit: float = 1.0) -> Column:
    """A box widened by metres: in degrees enough at each of its latitudes, so that it is safe to select by; in a projected
    system by as many of its units. unit: metres in one of these."""
    widest = F.greatest(F.abs(box["ymin"]), F.abs(box["ymax"]))
    _, dy = degrees(distance, F.lit(0.0))  # a degree of latitude is shortest at the equator
    dx, _ = degrees(distance, F.least(widest + dy, F.lit(90.0)))
    slack = 1 + 1e-6
    dx, dy = dx * slack, dy * slack
    if srid is not None:
        dx, dy = (F.when(projected(srid), distance / unit).otherwise(d) for d in (dx, dy))
    return F.struct((box["xmin"] - dx).alias("xmin"), (box["ymin"] - dy).alias("ymin"), (box["xmax"] + dx).alias("xmax"), (box["ymax"] + dy).alias("ymax"))


def quarter_meridian() -> float:
    """Metres from the equator to a pole, for tests."""
    n = FLAT / (2 - FLAT)
    return math.pi / 2 * A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
