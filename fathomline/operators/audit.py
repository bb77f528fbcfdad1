"""Checks of stored tables against each other; each gives a count of offending rows, or the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.constants import REGIONS
from fathomline.functions.geo import haversine_km, ring_centroid


def orphans(incidents: DataFrame, **tables: DataFrame) -> DataFrame:
    """Rows of each table whose incident is unknown (null refers to none)."""
    out = None
    for name, df in sorted(tables.items()):
        lost = df.where("incident_id is not null").join(incidents.select("incident_id"), "incident_id", "left_anti")
        row = lost.agg(F.lit(name).alias("table"), F.count("*").alias("orphans"))
        out = row if out is None else out.unionByName(row)
    return out


def _counts(df: DataFrame, **checks: str) -> DataFrame:
    one = df.agg(*[F.count_if(F.expr(c)).alias(k) for k, c in checks.items()])
    return one.selectExpr(f"stack({len(checks)}, " + ", ".join(f"'{k}', {k}" for k in checks) + ") as (check, bad)")


def ranges(positions: DataFrame, incidents: DataFrame, candidates: DataFrame, now: float, vessels: DataFrame | None = None) -> DataFrame:
    """Impossible or missing values, one row a check.

    Incidents that have volumes are checked for their order.
    """
    world = "not (lat between -90 and 90 and lon between -180 and 180)"
    rows = _counts(positions, position_coordinates=world, position_future=f"ts > {now} + 3600", position_source="source is null", position_missing="mmsi is null or ts is null or lat is null or lon is null")
    own = {"incident_coordinates": world, "incident_future": f"detected_at > {now} + 3600", "incident_confidence": "not (confidence between 0 and 1)", "incident_missing": "region is null or scene_id is null or created_at is null"}
    if "volume_min_m3" in incidents.columns:
        own["incident_volumes"] = "volume_min_m3 > volume_max_m3"
    rows = rows.unionByName(_counts(incidents, **own))
    if vessels is not None:
        rows = rows.unionByName(_counts(vessels, vessel_missing="mmsi is null or coalesce(name, '') = ''", vessel_length="not (length_m between 0 and 500)"))
    return rows.unionByName(_counts(candidates, candidate_score="not (score between 0 and 1)"))


def duplicate_ranks(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("incident_id", "rank").agg(F.count("*").alias("n")).where("n > 1")


def broken_polygons(incidents: DataFrame, far_km: float = 10.0) -> DataFrame:
    """Rings of under three vertices, or whose centre is far from the incident."""
    centre = ring_centroid(F.col("polygon"))
    far = haversine_km(centre["lat"], centre["lon"], F.col("lat"), F.col("lon")) > far_km
    return incidents.where(F.coalesce((F.size("polygon") < 3) | far, F.lit(True))).select("incident_id")


def outside_region(incidents: DataFrame) -> DataFrame:
    """Incidents that lie outside the box of the region they are stamped with."""
    inside = F.lit(False)
    for r in REGIONS:
        inside = inside | ((F.col("region") == r.key) & F.col("lat").between(r.lat_min, r.lat_max) & F.col("lon").between(r.lon_min, r.lon_max))
    return incidents.where(F.col("region").isNotNull() & ~F.coalesce(inside, F.lit(False)))


def wrong_scores(candidates: DataFrame, weights: dict[str, float], tolerance: float = 1e-3) -> DataFrame:
    """Scores that are not the weighted sum of their components (columns of those names)."""
    total = sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0))
    return candidates.withColumn("recomputed", total).where(F.abs(F.col("recomputed") - F.col("score")) > tolerance)


def report_totals(incidents: DataFrame, by_region: DataFrame, by_status: DataFrame, bands: DataFrame) -> DataFrame:
    """Sums of the reports beside the number of incidents."""
    total = incidents.agg(F.count("*").alias("incidents"))
    for name, df in (("by_region", by_region), ("by_status", by_status), ("by_band", bands)):
        total = total.crossJoin(df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name)))  # one row each
    return total


def region_totals(incidents: DataFrame, by_region: DataFrame, scoped: dict[str, DataFrame]) -> DataFrame:
    """Of each region: its incidents by the table, by the report of all regions, and by reports scoped to it."""
    stored = incidents.groupBy(F.coalesce("region", F.lit("unknown")).alias("region")).agg(F.count("*").alias("incidents"))
    each = None
    for key, df in sorted(scoped.items()):
        row = df.agg(F.lit(key).alias("region"), F.coalesce(F.sum("n"), F.lit(0)).alias("by_scope"))
        each = row if each is None else each.unionByName(row)
    rows = stored.join(by_region.select("region", F.col("n").alias("by_region")), "region", "full")
    return rows if each is None else rows.join(each, "region", "full")


def repeated_values(incidents: DataFrame, *columns: str, most: int = 2) -> DataFrame:
    """Values of a measured column that many incidents share."""
    pairs = ", ".join(f"'{c}', cast({c} as double)" for c in columns)
    long = incidents.selectExpr(f"stack({len(columns)}, {pairs}) as (measure, value)").where("value is not null")
    return long.groupBy("measure", "value").agg(F.count("*").alias("n")).where(F.col("n") > most)


def constant_offsets(timeline: DataFrame, incidents: DataFrame) -> DataFrame:
    """How many distinct delays each stage has after detection."""
    rows = timeline.join(incidents.select("incident_id", "detected_at"), "incident_id", "left")
    return rows.groupBy("stage").agg(F.count_distinct(F.col("ts") - F.col("detected_at")).alias("offsets"), F.count("*").alias("n"))


def duplicate_spots(incidents: DataFrame) -> DataFrame:
    """Detections of one scene at one spot."""
    spot = [F.round("lat", 3).alias("lat3"), F.round("lon", 3).alias("lon3")]
    return incidents.groupBy("scene_id", *spot).agg(F.count("*").alias("n")).where("n > 1")
