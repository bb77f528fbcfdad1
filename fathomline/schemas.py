"""Schemas of the engine's tables, as DDL."""

from __future__ import annotations

from pyspark.sql.types import StructType

POSITIONS = "mmsi long, ts double, lat double, lon double, sog double, cog double, heading double, nav_status int, source string"
VESSELS = "mmsi long, name string, imo string, callsign string, ship_type int, length_m double, width_m double, draught_m double, destination string, first_seen double, last_seen double"
INCIDENTS = (
    "incident_id string, detected_at double, lat double, lon double, area_km2 double, length_km double, width_km double, volume_min_m3 double, volume_max_m3 double, "
    "confidence double, status string, polygon array<array<double>>, scene_id string, source string, region string, created_at double"
)
TIMELINE = "incident_id string, ts double, stage string, detail string"
CANDIDATES = (
    "incident_id string, mmsi long, rank int, score double, components struct<spatial:double,temporal:double,persistence:double,behaviour:double,vessel_type:double>, "
    "evidence array<string>, track array<array<double>>, computed_at double"
)
DRIFT_RUNS = "incident_id string, computed_at double, hours_back double, particles int, result string"
ALERTS = "ts double, incident_id string, kind string, message string"

TABLES = {"ais_positions": POSITIONS, "vessels": VESSELS, "incidents": INCIDENTS, "incident_timeline": TIMELINE, "candidates": CANDIDATES, "drift_runs": DRIFT_RUNS, "alerts": ALERTS}


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])
