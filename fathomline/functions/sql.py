"""The engine's functions for SQL: expressions that the optimizer inlines, and one table function."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from fathomline.constants import DEFLECTION_DEG, KM_PER_DEG_LAT, KM_PER_DEG_LON, SHIP_TYPES, STEP_MINUTES, TYPE_BASE, TYPE_BASE_OTHER, WIND_FACTOR

_TYPES = " ".join(f"when code = {k} then '{v}'" for k, v in SHIP_TYPES.items()) + " " + " ".join(f"when code div 10 * 10 = {k} then '{v}'" for k, v in SHIP_TYPES.items() if k % 10 == 0)
_BASES = " ".join(f"when '{k}' then {v}d" for k, v in TYPE_BASE.items())

#: Parameters, type and body of each function.
FUNCTIONS = {
    "haversine_km": ("lat1 double, lon1 double, lat2 double, lon2 double", "double", "12742d * asin(sqrt(least(1d, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"),
    "bearing_deg": ("lat1 double, lon1 double, lat2 double, lon2 double", "double", "pmod(degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) + 360d, 360d)"),
    "angle_diff": ("a double, b double", "double", "abs(pmod(a - b + 180d, 360d) - 180d)"),
    "knots_to_ms": ("knots double", "double", "knots * 0.514444d"),
    "km_per_deg_lon": ("lat double", "double", f"{KM_PER_DEG_LON}d * cos(radians(lat))"),
    "ship_type_name": ("code int", "string", f"case when code is null then 'Unknown' {_TYPES} else 'Other' end"),
    "type_score": ("code int, length_m double", "double", f"case ship_type_name(code) {_BASES} else {TYPE_BASE_OTHER}d end * (0.6d + 0.4d * least(1d, coalesce(length_m, 0d) / 250d))"),
}


class Backtrack:
    """Snapshots of particles drifted back from a ring, as ``drift.backtrack`` without diffusion.

    ``environment`` is a list of (ts, wind_speed, wind_from, cur_speed, cur_to), hourly.
    """

    def eval(self, ring: list, detected_at: float, hours: int, environment: list) -> Iterator[tuple]:
        rows = sorted(environment, key=lambda r: r[0])
        series = np.array([[float(v) for v in r] for r in rows]).T
        lon, lat = (np.array([float(p[k]) for p in ring]) for k in (0, 1))
        dt = STEP_MINUTES * 60.0
        for step in range(int(hours * 60 / STEP_MINUTES) + 1):
            at = detected_at - step * dt
            for p, (y, x) in enumerate(zip(lat.tolist(), lon.tolist(), strict=True)):
                yield p, step, at, y, x
            wind, origin, current, to = (float(np.interp(at, series[0], s)) for s in series[1:])
            blow = math.radians((origin + 180.0 + DEFLECTION_DEG) % 360)
            north = current * math.cos(math.radians(to)) + wind * WIND_FACTOR * math.cos(blow)
            east = current * math.sin(math.radians(to)) + wind * WIND_FACTOR * math.sin(blow)
            wide = max(KM_PER_DEG_LON * math.cos(math.radians(float(lat.mean()))), 1e-6)
            lat, lon = lat - north * dt / 1000.0 / KM_PER_DEG_LAT, lon - east * dt / 1000.0 / wide


def register(spark: SparkSession) -> None:
    """Make all functions known to a session's SQL."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {kind} return {body}")
    spark.udtf.register("backtrack", udtf(Backtrack, returnType="p int, step int, ts double, lat double, lon double"))
