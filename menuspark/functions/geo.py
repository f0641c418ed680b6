"""Distances in metres between points given as latitude and longitude columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6_371_008.8
# The WGS84 spheroid.
WGS84_A = 6_378_137.0
WGS84_F = 1 / 298.257223563


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; for ranking, within about half a percent of the spheroid."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dp, dl = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dp / 2), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), F.lit(2.0))
    return F.asin(F.sqrt(F.least(F.lit(1.0), a))) * (2 * EARTH_RADIUS)


def vincenty_metres(lat1, lon1, lat2, lon2) -> np.ndarray:
    """Geodesic distance on WGS84 by Vincenty's inverse formula, over arrays. Pairs that do not converge
    (nearly antipodal) give NaN."""
    lat1, lon1, lat2, lon2 = (np.radians(np.asarray(x, dtype=float)) for x in (lat1, lon1, lat2, lon2))
    b = WGS84_A * (1 - WGS84_F)
    u1, u2 = np.arctan((1 - WGS84_F) * np.tan(lat1)), np.arctan((1 - WGS84_F) * np.tan(lat2))
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    first = lon2 - lon1
    lam = first.copy() if isinstance(first, np.ndarray) else np.array(first)
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(100):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
            cs = su1 * su2 + cu1 * cu2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0.0, cu1 * cu2 * sl / ss)
            c2 = 1 - sa**2
            cm = np.where(c2 == 0, 0.0, cs - 2 * su1 * su2 / c2)
            c = WGS84_F / 16 * c2 * (4 + WGS84_F * (4 - 3 * c2))
            new = first + (1 - c) * WGS84_F * sa * (sigma + c * ss * (cm + c * cs * (2 * cm**2 - 1)))
            done = np.abs(new - lam) < 1e-12
            lam = new
            if done.all():
                break
        uu = c2 * (WGS84_A**2 - b**2) / b**2
        aa = 1 + uu / 16384 * (4096 + uu * (uu * (320 - 175 * uu) - 768))
        bb = uu / 1024 * (256 + uu * (uu * (74 - 47 * uu) - 128))
        ds = bb * ss * (cm + bb / 4 * (cs * (2 * cm**2 - 1) - bb / 6 * cm * (4 * ss**2 - 3) * (4 * cm**2 - 3)))
        return np.where(done | (ss == 0), b * aa * (sigma - ds), np.nan)


def geodesic(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """``vincenty_metres`` over columns."""

    @F.pandas_udf("double")
    def run(points: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b, c, d in points:
            yield pd.Series(vincenty_metres(a, b, c, d))

    return run(lat1, lon1, lat2, lon2)
