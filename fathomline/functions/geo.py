"""Geodesy and angles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomline.constants import EARTH_RADIUS_M, KM_PER_DEG_LAT, KM_PER_DEG_LON, KNOT_MS, Region

Value = Column | float


def _c(value: Value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(float(high))), F.lit(float(low)))


def km_per_deg_lon(lat: Value) -> Column:
    return F.lit(KM_PER_DEG_LON) * F.cos(F.radians(_c(lat)))


def haversine_km(lat1: Value, lon1: Value, lat2: Value, lon2: Value) -> Column:
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M / 1000) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def floor_mod(value: Column, modulus: float) -> Column:
    """Modulo with the sign of the modulus, for doubles too."""
    return value - F.lit(float(modulus)) * F.floor(value / F.lit(float(modulus)))


def bearing_deg(lat1: Value, lon1: Value, lat2: Value, lon2: Value) -> Column:
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return floor_mod(F.degrees(F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d))) + 360.0, 360)


def offset_km(lat: Value, lon: Value, north: Value, east: Value) -> tuple[Column, Column]:
    lat, lon = _c(lat), _c(lon)
    return lat + _c(north) / KM_PER_DEG_LAT, lon + _c(east) / km_per_deg_lon(lat)


def move_bearing(lat: Value, lon: Value, bearing: Value, km: Value) -> tuple[Column, Column]:
    b = F.radians(_c(bearing))
    return offset_km(lat, lon, _c(km) * F.cos(b), _c(km) * F.sin(b))


def angle_diff(a: Value, b: Value) -> Column:
    """Smallest difference of two bearings, 0 to 180."""
    return F.abs(floor_mod(_c(a) - _c(b) + 180.0, 360) - 180.0)


def knots_to_ms(knots: Value) -> Column:
    return _c(knots) * KNOT_MS


def ms_to_knots(ms: Value) -> Column:
    return _c(ms) / KNOT_MS


def local_km(lat: Value, lon: Value, lat0: Value, lon0: Value) -> Column:
    """Distance to a near point, on a plane that is true at the first one."""
    lat = _c(lat)
    return F.hypot((_c(lon0) - _c(lon)) * km_per_deg_lon(lat), (_c(lat0) - lat) * KM_PER_DEG_LAT)


def ring_centroid(ring: Column) -> Column:
    """Struct (lat, lon): the mean of the vertices of a [[lon, lat], ...] ring."""
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[k]) / F.size(ring)
    return F.struct(mean(1).alias("lat"), mean(0).alias("lon"))


def polygon_area_km2(ring: Column) -> Column:
    """Shoelace area of a [[lon, lat], ...] ring; 0 below three vertices."""
    lat0 = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[1]) / F.size(ring)
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(1))), F.slice(ring, 1, 1))
    twice = F.aggregate(F.zip_with(ring, following, lambda p, q: p[0] * q[1] - q[0] * p[1]), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(F.abs(twice) * km_per_deg_lon(lat0) * KM_PER_DEG_LAT / 2)


def crossings_odd(lon: Value, lat: Value, edges: Column) -> Column:
    """Even-odd rule over edges (x, y, x2, y2): an odd number of them crosses the ray to the east."""
    lon, lat = _c(lon), _c(lat)

    def crosses(e: Column) -> Column:
        at = e["x"] + (lat - e["y"]) * (e["x2"] - e["x"]) / F.when(e["y2"] != e["y"], e["y2"] - e["y"]).otherwise(1.0)
        return F.when((e["y"] > lat) != (e["y2"] > lat), F.when(lon < at, 1).otherwise(0)).otherwise(0)

    return F.pmod(F.aggregate(edges, F.lit(0), lambda s, e: s + crosses(e)), F.lit(2)) == 1


def point_in_ring(lon: Value, lat: Value, ring: Column) -> Column:
    """Even-odd rule: an odd number of edges crosses the ray to the east."""
    lon, lat = _c(lon), _c(lat)
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(1))), F.slice(ring, 1, 1))

    def crosses(p: Column, q: Column) -> Column:
        straddles = (p[1] > lat) != (q[1] > lat)
        at = p[0] + (lat - p[1]) * (q[0] - p[0]) / F.when(q[1] != p[1], q[1] - p[1]).otherwise(1.0)
        return F.when(straddles & (lon < at), 1).otherwise(0)

    return F.pmod(F.aggregate(F.zip_with(ring, following, crosses), F.lit(0), lambda s, x: s + x), F.lit(2)) == 1


def in_box(lat: Column, lon: Column, region: Region) -> Column:
    return lat.between(region.lat_min, region.lat_max) & lon.between(region.lon_min, region.lon_max)
