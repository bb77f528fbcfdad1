"""Cleaning, throttling, deduplication and merging of raw positions and vessels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.constants import REGIONS, RETENTION_DAYS, THROTTLE_S
from fathomline.functions.geo import haversine_km
from fathomline.functions.scalars import one_decimal, sane
from fathomline.operators.reports import next_incident_ids


def clean(raw: DataFrame) -> DataFrame:
    """Measurements with markers and impossible values as nulls (columns raw_sog, raw_cog, raw_heading)."""
    return raw.withColumns({"sog": sane(F.col("raw_sog"), 102.3, 0, 102.2), "cog": sane(F.col("raw_cog"), 360, 0, 359.9), "heading": sane(F.col("raw_heading"), 511, 0, 359)})


def throttle(fixes: DataFrame, seq: str | Sequence[str] = "seq", interval: float = THROTTLE_S) -> DataFrame:
    """Per vessel in order of arrival, the fixes at least ``interval`` after the last one kept.

    The decision depends on the last *kept* fix, so each vessel is a fold.  Its
    rows stream through a task in order of ``seq`` (one column or several, which
    need not be unique), and the task remembers one number.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vessel, last = None, 0.0
        for batch in batches:
            kept = []
            for i, (mmsi, ts) in enumerate(zip(batch.column("mmsi").to_pylist(), batch.column("ts").to_pylist(), strict=True)):
                if mmsi != vessel or ts - last >= interval:
                    kept.append(i)
                    vessel, last = mmsi, ts
            yield batch.take(pa.array(kept, pa.int64()))

    order = [seq] if isinstance(seq, str) else list(seq)
    known = fixes.where("mmsi is not null and ts is not null")
    return known.repartition("mmsi").sortWithinPartitions("mmsi", *order, "ts").mapInArrow(fold, fixes.schema)


def first_wins(batch: DataFrame, history: DataFrame | None = None, seq: str = "seq", keys: Sequence[str] = ("mmsi", "ts")) -> DataFrame:
    """Rows of the batch whose key is new: the first in the batch, none that history has."""
    first = Window.partitionBy(*keys).orderBy(seq)
    rows = batch.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return rows if history is None else rows.join(history.select(*keys), list(keys), "left_anti")


def merge_vessels(updates: DataFrame, seq: str = "seq", keys: Sequence[str] = ("mmsi",), known: DataFrame | None = None) -> DataFrame:
    """One row a vessel: of each column the latest known value, first and last time seen."""
    if known is not None:
        updates = known.withColumn(seq, F.lit(-1)).unionByName(updates, allowMissingColumns=True)
    columns = [c for c in updates.columns if c not in (*keys, seq, "ts")]
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in columns]
    return updates.groupBy(*keys).agg(*latest, F.min_by("ts", seq).alias("first_seen"), F.max("ts").alias("last_seen"))


def keep_latest(rows: DataFrame, key: str, by: str) -> DataFrame:
    """Replace by key: the row with the largest ``by``."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), by).alias("r")).select("r.*")


def prune(positions: DataFrame, now: float, days: float = RETENTION_DAYS) -> DataFrame:
    """Old live fixes go; fixes of archives stay."""
    return positions.where(~((F.col("ts") < now - days * 86400.0) & (F.coalesce("source", F.lit("live")) == "live")))


def stamp_region(points: DataFrame, default: str) -> DataFrame:
    """The first region whose box holds the point, in their fixed order."""
    lat, lon = F.col("lat"), F.col("lon")
    found = F.coalesce(*[F.when(lat.between(r.lat_min, r.lat_max) & lon.between(r.lon_min, r.lon_max), r.key) for r in REGIONS], F.lit(default))
    return points.withColumn("stamped", found)


def existing_incident(detections: DataFrame, incidents: DataFrame, radius_km: float = 1.5) -> DataFrame:
    """Each detection with the first incident of its scene within the radius, or null."""
    known = incidents.select("scene_id", F.col("incident_id").alias("existing"), F.col("lat").alias("lat0"), F.col("lon").alias("lon0")).where("scene_id <> ''")
    near = detections.join(known, "scene_id").where(haversine_km(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0")) <= radius_km)
    first = near.groupBy("detection_id").agg(F.min("existing").alias("existing"))
    return detections.join(first, "detection_id", "left")


def upsert_incidents(incidents: DataFrame, matched: DataFrame, measured: Sequence[str] = ("lat", "lon", "area_km2", "confidence")) -> DataFrame:
    """Refresh the measurements of matched incidents; their time, status and id stay."""
    fresh = matched.where("existing is not null").groupBy("existing").agg(*[F.max_by(c, "detection_id").alias(f"new_{c}") for c in measured])
    rows = incidents.join(fresh, incidents["incident_id"] == fresh["existing"], "left")
    return rows.select(*[F.when(F.col("existing").isNotNull(), F.col(f"new_{c}")).otherwise(incidents[c]).alias(c) if c in measured else incidents[c] for c in incidents.columns])


def new_incidents(incidents: DataFrame, matched: DataFrame, year: int, default_region: str, now: float, status: str = "Under Investigation") -> DataFrame:
    """Rows of incidents for the detections that match none: numbered on, stamped with a region, with volumes.

    ``matched`` is a result of ``existing_incident`` with a column detected_at.
    """
    fresh = volumes(stamp_region(matched.where("existing is null"), default_region)).withColumnRenamed("stamped", "region")
    return next_incident_ids(incidents, fresh.drop("existing"), year, "detection_id").withColumns({"status": F.lit(status), "created_at": F.lit(now)})


def store_detections(incidents: DataFrame, detections: DataFrame, year: int, default_region: str, now: float) -> DataFrame:
    """All incidents after a scene: known ones refreshed in place, new ones added."""
    matched = existing_incident(detections, incidents)
    return upsert_incidents(incidents, matched).unionByName(new_incidents(incidents, matched, year, default_region, now).drop("detection_id"), allowMissingColumns=True)


def detection_stages(incidents: DataFrame) -> DataFrame:
    """Two stages of an incident's timeline, with words: when it was seen, and when it was stored."""
    seen = F.format_string("Dark region of %s km2 in %s, confidence %d %%", one_decimal(F.col("area_km2")), F.coalesce("scene_id", F.lit("an unknown scene")), F.bround(F.col("confidence") * 100).cast("int"))
    kept = F.concat(F.lit("Stored as "), F.col("incident_id"), F.lit(", "), F.lower("status"))
    stages = F.array(F.struct(F.col("detected_at").alias("ts"), F.lit("detected").alias("stage"), seen.alias("text")), F.struct(F.col("created_at").alias("ts"), F.lit("created").alias("stage"), kept.alias("text")))
    return incidents.select("incident_id", F.explode(stages).alias("s")).select("incident_id", "s.*")


def replace_stages(timeline: DataFrame, fresh: DataFrame) -> DataFrame:
    """Delete the incident's stages that come anew, then append them."""
    return timeline.join(fresh.select("incident_id", "stage").distinct(), ["incident_id", "stage"], "left_anti").unionByName(fresh)


def volumes(detections: DataFrame) -> DataFrame:
    """Volume range of a slick: films of one to fifty micrometres."""
    return detections.withColumns({"volume_min_m3": F.col("area_km2") * 1e6 * 1e-6, "volume_max_m3": F.col("area_km2") * 1e6 * 50e-6})
