"""Readers of archives and of JSON and CSV results."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.constants import THROTTLE_S
from fathomline.functions.scalars import archive_number, blank_to_null
from fathomline.operators.ingest import throttle

# The columns of a day's archive, in their order.
ARCHIVE_COLUMNS = (
    "MMSI", "BaseDateTime", "LAT", "LON", "SOG", "COG", "Heading", "VesselName", "IMO", "CallSign", "VesselType", "Status",
    "Length", "Width", "Draft", "Cargo", "TransceiverClass",
)
ARCHIVE_SCHEMA = ", ".join(f"{c} string" for c in ARCHIVE_COLUMNS)
ZIP_ROWS = 50_000
#: The order of arrival of an archive's rows, unique over all files.
PLACE = ("file", "member", "row")


def archive_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of unpacked archive files, all as text, with their order of arrival."""
    rows = spark.read.schema(ARCHIVE_SCHEMA).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return rows.select("*", F.col("_metadata.file_path").alias("file"), F.lit("").alias("member"), F.monotonically_increasing_id().alias("row"))


def archive_zip(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """Rows of zipped archive files with their order of arrival (file, member, row).

    One task a file, which inflates its members as streams: it holds the packed file
    and one piece of rows.  The first ``max_rows`` of each member, if given.
    """

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    names = [n for n in archive.namelist() if n.lower().endswith(".csv")]
                    for number, name in enumerate(names):
                        with archive.open(name) as packed:
                            lines = csv.DictReader(io.TextIOWrapper(packed, encoding="utf-8-sig", errors="replace", newline=""))
                            rows = ([*(line.get(c) for c in ARCHIVE_COLUMNS), file, f"{number:06d} {name}", n] for n, line in enumerate(islice(lines, max_rows)))
                            while piece := list(islice(rows, ZIP_ROWS)):
                                yield pd.DataFrame(piece, columns=[*ARCHIVE_COLUMNS, *PLACE], dtype=object).astype({"row": "int64"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, f"{ARCHIVE_SCHEMA}, file string, member string, row long")


def archive_fixes(rows: DataFrame, box: tuple[float, float, float, float] | None = None, interval: float = THROTTLE_S) -> DataFrame:
    """Positions of an archive: box first, then number and time, then the throttle."""
    fixes = rows.select(
        F.col("MMSI").try_cast("long").alias("mmsi"), *PLACE, F.try_to_timestamp("BaseDateTime", F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("double").alias("ts"),
        F.col("LAT").try_cast("double").alias("lat"), F.col("LON").try_cast("double").alias("lon"), archive_number(F.col("SOG")).alias("sog"), archive_number(F.col("COG")).alias("cog"),
        archive_number(F.col("Heading")).alias("heading"), F.col("Status").try_cast("int").alias("nav_status"), F.lit("noaa").alias("source"),
    )
    if box is not None:
        west, south, east, north = box
        fixes = fixes.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    return throttle(fixes.where("mmsi is not null and ts is not null and lat is not null and lon is not null"), PLACE, interval)


def archive_report(rows: DataFrame, kept: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """One row of what became of an archive: rows read, rows in the box, fixes kept, vessels."""
    west, south, east, north = box
    inside = F.col("LAT").try_cast("double").between(south, north) & F.col("LON").try_cast("double").between(west, east)
    read = rows.agg(F.count("*").alias("scanned"), F.count_if(inside).alias("in_box"))
    return read.crossJoin(kept.agg(F.count("*").alias("stored"), F.count_distinct("mmsi").alias("vessels")))  # one row each


def archive_vessels(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The vessel described by the first kept row of each number."""
    first = kept.groupBy(F.col("mmsi").alias("number")).agg(F.min(F.struct(*PLACE)).alias("place")).select("number", "place.*")
    return rows.where(F.col("MMSI").try_cast("long").isNotNull()).join(first, list(PLACE)).select(
        F.col("number").alias("mmsi"), blank_to_null(F.col("VesselName")).alias("name"), blank_to_null(F.replace(F.col("IMO"), F.lit("IMO"), F.lit(""))).alias("imo"), blank_to_null(F.col("CallSign")).alias("callsign"),
        F.col("VesselType").try_cast("int").alias("ship_type"), archive_number(F.col("Length")).alias("length_m"), archive_number(F.col("Width")).alias("width_m"), archive_number(F.col("Draft")).alias("draught_m"),
    )


def archive_url(base: str, day: str) -> str:
    """Where the archive of a day (``2024-12-29``) lies below an index page."""
    year, month, number = day.split("-")
    return f"{base.rstrip('/')}/{int(year):04d}/AIS_{int(year):04d}_{int(month):02d}_{int(number):02d}.zip"


def newest_day(listing: DataFrame, year: int) -> DataFrame:
    """The newest day that an index page (column ``page``) links."""
    days = F.explode(F.regexp_extract_all("page", F.lit(rf"AIS_({year}_\d\d_\d\d)\.zip"), 1)).alias("day")
    return listing.select(days).agg(F.max(F.replace("day", F.lit("_"), F.lit("-"))).alias("day"))


ACTIVITY = "lat double, lon double, mmsi string, imo string, callsign string, shipName string, flag string, entryTimestamp string, exitTimestamp string, date string"


def activity_rows(reports: DataFrame, body: str = "body") -> DataFrame:
    """Rows of activity reports: entries, each a map of data sets to lists."""
    parsed = reports.select(F.from_json(body, f"entries array<map<string, array<struct<{ACTIVITY.replace(' ', ':').replace(',:', ', ')}>>>>").alias("b"))
    entry = parsed.select(F.explode("b.entries").alias("e"))
    return entry.select(F.explode("e")).select(F.explode("value").alias("r")).select("r.*")


def _epoch(text: str):
    value = F.col(text)
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(p)) for p in ("yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mmX", "yyyy-MM-dd")]).cast("double")


def activity_fixes(rows: DataFrame) -> DataFrame:
    """Two fixes a row, at entry and exit; its date where it has neither.  Times are UTC."""
    known = rows.withColumn("n", F.col("mmsi").try_cast("long")).where("n is not null and lat is not null and lon is not null")
    entry, leave, date = _epoch("entryTimestamp"), _epoch("exitTimestamp"), _epoch("date")
    times = F.array_compact(F.array(F.coalesce(entry, date), leave))
    return known.select(F.col("n").alias("mmsi"), F.explode(times).alias("ts"), "lat", "lon", F.lit("gfw").alias("source"))


SCENE = "id string, properties struct<datetime:string, `sar:instrument_mode`:string, `sar:polarizations`:array<string>>, bbox array<double>"


def scenes(catalogue: DataFrame, box: tuple[float, float, float, float], start: float, end: float, mode: str = "IW") -> DataFrame:
    """Scenes (of SCENE) of a mode that meet a box and a time, the newest first."""
    west, south, east, north = box
    ts = F.try_to_timestamp(F.col("properties.datetime")).cast("double")
    rows = catalogue.withColumn("ts", ts).where(F.col("ts").between(start, end) & (F.col("properties.sar:instrument_mode") == mode))
    b = F.col("bbox")
    return rows.where((b[0] <= east) & (b[2] >= west) & (b[1] <= north) & (b[3] >= south)).select("id", "ts", F.col("properties.sar:polarizations").alias("polarizations"), "bbox").orderBy(F.desc("ts"), "id")


def newest_scene(found: DataFrame, polarization: str = "vv") -> DataFrame:
    """The newest scene that has the polarization."""
    return found.where(F.exists("polarizations", lambda p: F.upper(p) == polarization.upper())).orderBy(F.desc("ts"), "id").limit(1)


HOURLY = "wind_speed_10m", "wind_direction_10m", "ocean_current_velocity", "ocean_current_direction", "wave_height", "sea_surface_temperature"


def environment(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Hourly series of weather and sea results side by side; the current in m/s."""
    schema = "hourly struct<time:array<string>, " + ", ".join(f"{c}:array<double>" for c in HOURLY) + ">"
    h = bodies.select(F.from_json(body, schema).alias("b")).select("b.hourly.*")
    at = F.coalesce(*[F.try_to_timestamp("x.time", F.lit(p)) for p in ("yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd'T'HH:mm:ss")]).cast("double").alias("ts")
    given = [F.coalesce(c, F.transform("time", lambda t: F.lit(None).cast("double"))).alias(c) for c in HOURLY]
    long = h.select("time", *given).select(F.explode(F.arrays_zip("time", *HOURLY)).alias("x")).select(at, *[F.col(f"x.{c}").alias(c) for c in HOURLY]).where("ts is not null")
    rows = long.groupBy("ts").agg(*[F.max(c).alias(c) for c in HOURLY])
    names = dict(zip(HOURLY, ("wind_speed", "wind_from", "cur_speed", "cur_to", "wave_m", "sst_c"), strict=True))
    return rows.select("ts", *[(F.col(c) / 3.6 if c == "ocean_current_velocity" else F.col(c)).alias(n) for c, n in names.items()])


def land_rings(spark: SparkSession, path: str) -> DataFrame:
    """Outer rings of at least three vertices of a GeoJSON collection."""
    features = spark.read.option("multiLine", True).schema("features array<struct<geometry:struct<type:string, coordinates:string>>>").json(path)
    g = features.select(F.explode("features.geometry").alias("g")).select("g.type", "g.coordinates")
    one = F.array(F.from_json("coordinates", "array<array<array<double>>>"))
    many = F.from_json("coordinates", "array<array<array<array<double>>>>")
    polygons = g.where("type in ('Polygon', 'MultiPolygon')").select(F.explode(F.when(F.col("type") == "Polygon", one).otherwise(many)).alias("p"))
    return polygons.select(F.get("p", 0).alias("ring")).where(F.size("ring") >= 3)


def vessel_matches(bodies: DataFrame, body: str = "body") -> DataFrame:
    """The first self-reported description of each vessel found."""
    info = "struct<ssvid:string, shipname:string, flag:string, callsign:string, imo:string>"
    rows = bodies.select(F.from_json(body, f"entries array<struct<selfReportedInfo:array<{info}>>>").alias("b")).select(F.explode("b.entries").alias("e"))
    return rows.select(F.get("e.selfReportedInfo", 0).alias("i")).select("i.*")
