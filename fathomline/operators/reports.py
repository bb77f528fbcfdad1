"""Report queries over positions, vessels, incidents, candidates and alerts.

Times are epoch seconds and ``now`` is an argument, so results are repeatable.
A region argument is a key, or None for all regions.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.constants import STATUSES, region
from fathomline.functions.geo import in_box
from fathomline.functions.scalars import display_name, ship_type_name

DAY = 86400.0


def checked(name: str, value: float, low: float, high: float) -> float:
    if not low <= value <= high:
        raise ValueError(f"{name} must lie in {low} to {high}")
    return value


def within(df: DataFrame, key: str | None) -> DataFrame:
    """Fixes inside a region's box."""
    return df if key is None else df.where(in_box(F.col("lat"), F.col("lon"), region(key)))


def scoped(df: DataFrame, key: str | None) -> DataFrame:
    """Incidents stamped with a region; rows without one belong to none."""
    return df if key is None else df.where(F.col("region") == region(key).key)


def vessels_live(positions: DataFrame, vessels: DataFrame, now: float, minutes: int = 60, key: str | None = None) -> DataFrame:
    """The latest fix of each vessel among those in the box and window; of equal times the first to arrive (by ``seq``, if there is one), else the largest."""
    checked("minutes", minutes, 1, 1440)
    recent = within(positions.where(F.col("ts") >= now - minutes * 60.0), key)
    arrived = [(-F.col("seq")).alias("arrived")] if "seq" in positions.columns else []
    last = recent.groupBy("mmsi").agg(F.max(F.struct("ts", *arrived, "lat", "lon", "sog", "cog", "heading")).alias("f")).select("mmsi", "f.*")
    out = last.join(vessels.select("mmsi", "name", "ship_type", "length_m"), "mmsi", "left")
    return out.select("mmsi", "ts", "lat", "lon", "sog", "cog", "heading", display_name(F.col("name"), F.col("mmsi")).alias("name"), ship_type_name(F.col("ship_type")).alias("vessel_type"), "length_m")


def vessel_list(positions: DataFrame, vessels: DataFrame, now: float, hours: float = 72, key: str | None = None, text: str | None = None, limit: int = 300) -> DataFrame:
    """Activity by vessel, the newest first; ``text`` matches name, number or IMO in any case."""
    checked("hours", hours, 0.5, 8760)
    checked("limit", limit, 1, 2000)
    recent = within(positions.where(F.col("ts") >= now - hours * 3600.0), key)
    sums = recent.groupBy("mmsi").agg(F.count("*").alias("fixes"), F.max("ts").alias("last_seen"), F.min("ts").alias("first_seen"), F.avg("sog").alias("avg_sog"), F.max("sog").alias("max_sog"))
    rows = sums.join(vessels, "mmsi", "left")
    if text:
        like = f"%{text}%"
        rows = rows.where(F.col("name").ilike(like) | F.col("mmsi").cast("string").ilike(like) | F.col("imo").ilike(like))
    rows = rows.orderBy(F.desc("last_seen"), "mmsi").limit(limit)
    return rows.select("mmsi", "fixes", "last_seen", "first_seen", F.round("avg_sog", 6).alias("avg_sog"), "max_sog", display_name(F.col("name"), F.col("mmsi")).alias("name"), "imo", ship_type_name(F.col("ship_type")).alias("vessel_type"), "length_m")


def vessel_track(positions: DataFrame, mmsi: int, now: float, hours: float = 24) -> DataFrame:
    checked("hours", hours, 0.5, 8760)
    return positions.where((F.col("mmsi") == mmsi) & (F.col("ts") >= now - hours * 3600.0)).select("ts", "lat", "lon", "sog", "cog").orderBy("ts")


def holdings(positions: DataFrame, key: str | None = None) -> DataFrame:
    """Fixes, vessels and the span of time held, in a region or everywhere."""
    return within(positions, key).agg(F.count("*").alias("positions"), F.count_distinct("mmsi").alias("vessels"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


def ais_status(positions: DataFrame, key: str) -> DataFrame:
    """Holdings of all and of one region in one pass."""
    here = in_box(F.col("lat"), F.col("lon"), region(key))
    return positions.agg(
        F.count("*").alias("positions"), F.count_distinct("mmsi").alias("vessels"), F.max("ts").alias("latest_ts"),
        F.count_if(here).alias("positions_in_region"), F.count_distinct(F.when(here, F.col("mmsi"))).alias("vessels_in_region"),
    )


def provenance(positions: DataFrame, key: str) -> DataFrame:
    """Where the fixes of a region come from."""
    return within(positions, key).groupBy("source").agg(F.count("*").alias("positions"), F.count_distinct("mmsi").alias("vessels"), F.max("ts").alias("latest_ts"))


def kpi_stats(incidents: DataFrame, candidates: DataFrame, now: float, days: int = 30, key: str | None = None) -> DataFrame:
    checked("days", days, 1, 365)
    own = scoped(incidents.where(F.col("detected_at") >= now - days * DAY), key)
    sums = own.agg(
        F.count("*").alias("total_incidents"), F.count_if(F.col("status") == "Confirmed").alias("confirmed_spills"),
        F.bround(F.avg(F.col("created_at") - F.col("detected_at")) / 3600.0, 1).alias("avg_detection_hours"),
    )
    seen = candidates.join(own.select("incident_id"), "incident_id").agg(F.count_distinct("mmsi").alias("vessels_analysed"))
    return sums.crossJoin(seen)  # one row each


def alerts_feed(alerts: DataFrame, incidents: DataFrame, key: str | None = None, limit: int = 12) -> DataFrame:
    """The newest alerts: those of no incident, and those of incidents of the region."""
    checked("limit", limit, 1, 100)
    rows = alerts
    if key is not None:
        rows = alerts.join(incidents.select("incident_id", "region"), "incident_id", "left").where(F.col("incident_id").isNull() | (F.col("region") == region(key).key)).drop("region")
    return rows.orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def incident_list(incidents: DataFrame, candidates: DataFrame, vessels: DataFrame, key: str | None = None, limit: int = 50) -> DataFrame:
    """Incidents, newest first, with their number of candidates, the best named vessel and the best score."""
    checked("limit", limit, 1, 500)
    top = scoped(incidents, key).orderBy(F.desc("detected_at"), "incident_id").limit(limit)
    candidates = candidates.join(F.broadcast(top.select("incident_id")), "incident_id", "left_semi")  # 500 incidents at most
    scores = candidates.groupBy("incident_id").agg(F.count("*").alias("candidate_count"), F.min_by("score", "rank").alias("top_score"))
    named = candidates.join(vessels.select("mmsi", "name"), "mmsi").groupBy("incident_id").agg(F.min_by("name", "rank").alias("top_vessel"))
    rows = top.join(scores, "incident_id", "left").join(named, "incident_id", "left")
    return rows.withColumn("candidate_count", F.coalesce("candidate_count", F.lit(0)))


def incident_candidates(candidates: DataFrame, vessels: DataFrame, incident_id: str) -> DataFrame:
    rows = candidates.where(F.col("incident_id") == incident_id).join(vessels, "mmsi", "left")
    return rows.select("rank", "mmsi", "score", display_name(F.col("name"), F.col("mmsi")).alias("name"), ship_type_name(F.col("ship_type")).alias("vessel_type"), "length_m").orderBy("rank")


def by_region(incidents: DataFrame, now: float, days: int = 90, key: str | None = None) -> DataFrame:
    own = scoped(incidents.where(F.col("detected_at") >= now - checked("days", days, 1, 3650) * DAY), key)
    return own.groupBy(F.coalesce("region", F.lit("unknown")).alias("region")).agg(F.count("*").alias("n"), F.round(F.avg("area_km2"), 1).alias("avg_area"), F.round(F.avg("confidence"), 3).alias("avg_conf"))


def by_status(incidents: DataFrame, now: float, days: int = 90, key: str | None = None) -> DataFrame:
    checked("days", days, 1, 3650)
    return scoped(incidents.where(F.col("detected_at") >= now - days * DAY), key).groupBy("status").agg(F.count("*").alias("n"))


def recent_scenes(incidents: DataFrame, now: float, days: int = 90, key: str | None = None, limit: int = 20) -> DataFrame:
    checked("days", days, 1, 3650)
    checked("limit", limit, 1, 200)
    own = scoped(incidents.where((F.col("detected_at") >= now - days * DAY) & F.col("scene_id").isNotNull()), key)
    return own.groupBy("scene_id").agg(F.count("*").alias("detections"), F.min("detected_at").alias("acquired")).orderBy(F.desc("acquired"), "scene_id").limit(limit)


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.7, "high (>=70%)").when(confidence >= 0.45, "medium (45-70%)").otherwise("low (<45%)")


def confidence_bands(incidents: DataFrame, now: float, days: int = 90, key: str | None = None) -> DataFrame:
    checked("days", days, 1, 3650)
    return scoped(incidents.where(F.col("detected_at") >= now - days * DAY), key).groupBy(band(F.col("confidence")).alias("band")).agg(F.count("*").alias("n"))


def no_candidate_reason(incidents: DataFrame, candidates: DataFrame, positions: DataFrame, key: str, hours: float = 24.0) -> DataFrame:
    """Why an incident has no candidates: one of five reasons."""
    bare = incidents.join(candidates.select("incident_id").distinct(), "incident_id", "left_anti").select("incident_id", "detected_at", (F.col("detected_at") - hours * 3600).alias("start"))
    held = positions.agg(F.count("*").alias("held"), F.min("ts").alias("oldest"))
    # whole minutes by their counts; only the two end minutes meet single fixes
    minute = lambda c: F.floor(F.col(c) / 60)
    first, last = minute("start"), minute("detected_at")
    counts = positions.groupBy(minute("ts").alias("minute")).agg(F.count("*").alias("n"))
    whole = bare.where(last - first >= 2).select("incident_id", F.explode(F.sequence(first + 1, last - 1)).alias("minute")).join(counts, "minute").select("incident_id", "n")
    ends = bare.select("*", F.explode(F.array_distinct(F.array(first, last))).alias("minute"))
    at_ends = ends.join(positions.select("ts", minute("ts").alias("minute")), "minute").where(F.col("ts").between(F.col("start"), F.col("detected_at"))).groupBy("incident_id").agg(F.count("*").alias("n"))
    hits = whole.unionByName(at_ends).groupBy("incident_id").agg(F.sum("n").alias("in_window"))
    rows = bare.join(hits, "incident_id", "left").crossJoin(held)  # held is one row
    inside = F.coalesce(F.col("in_window"), F.lit(0))
    reason = (
        F.when((F.col("held") == 0) & F.lit(region(key).ais_live == "none"), "no coverage")
        .when(F.col("held") == 0, "nothing collected")
        .when((inside == 0) & (F.col("oldest") > F.col("start")), "history too short")
        .when(inside == 0, "gap in history")
        .otherwise("no vessel near")
    )
    return rows.select("incident_id", inside.cast("long").alias("in_window"), reason.alias("reason"))


def set_status(incidents: DataFrame, incident_id: str, status: str) -> DataFrame:
    if status not in STATUSES:
        raise ValueError(f"status must be one of {STATUSES}")
    return incidents.withColumn("status", F.when(F.col("incident_id") == incident_id, status).otherwise(F.col("status")))


def status_alert(incidents: DataFrame, incident_id: str, status: str, now: float) -> DataFrame:
    """The alert that goes with a change of status; none for an incident that is not there."""
    if status not in STATUSES:
        raise ValueError(f"status must be one of {STATUSES}")
    own = incidents.where(F.col("incident_id") == incident_id)
    text = F.concat(F.col("incident_id"), F.lit(f" is now {status.lower()}, before: "), F.lower("status"))
    return own.select(F.lit(now).alias("ts"), "incident_id", F.lit("status").alias("kind"), text.alias("text"))


def incident_detail(incidents: DataFrame, candidates: DataFrame, vessels: DataFrame, timeline: DataFrame, runs: DataFrame, reasons: DataFrame, incident_id: str) -> DataFrame:
    """One row: the incident with its ranked candidates, its timeline, its drift run and, without candidates, the reason.

    Each list is of one incident: candidates are capped where they are ranked, and stages are few.
    """
    own = lambda df: df.where(F.col("incident_id") == incident_id)
    ranked = incident_candidates(candidates, vessels, incident_id)
    listed = ranked.agg(F.array_sort(F.collect_list(F.struct("rank", "mmsi", "score", "name", "vessel_type", "length_m"))).alias("candidates"))
    stages = own(timeline).agg(F.array_sort(F.collect_list(F.struct("ts", "stage"))).alias("timeline"))
    run = own(runs).groupBy("incident_id").agg(F.max_by("hours", "computed_at").alias("drift_hours"), F.max("computed_at").alias("drift_computed_at"))
    rows = own(incidents).crossJoin(listed).crossJoin(stages).join(run, "incident_id", "left")  # one row each
    return rows.join(own(reasons).select("incident_id", "reason"), "incident_id", "left")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``n``, their number from 1 in the given order.

    Rows are dealt by ranges of the order and sorted there; a range begins
    after the rows of all ranges before it, so no task sees more than a range.
    """
    dealt = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    starts = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(starts), "_range").withColumn("n", F.col("_start") + inside).drop("_range", "_start")


def next_incident_ids(incidents: DataFrame, new: DataFrame, year: int, *order: str) -> DataFrame:
    """``new`` rows numbered on from the largest numeric suffix of the year."""
    suffix = F.regexp_extract("incident_id", rf"^OTA-{year}-(\d+)$", 1).try_cast("bigint")
    last = incidents.agg(F.coalesce(F.max(suffix), F.lit(0)).alias("last"))
    rows = numbered(new, *order).crossJoin(F.broadcast(last))  # one row
    number = (F.col("last") + F.col("n")).cast("string")
    return rows.withColumn("incident_id", F.concat(F.lit(f"OTA-{year}-"), F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit("0")))).drop("n", "last")
