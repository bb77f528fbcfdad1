"""Live position messages: a file-based stream of JSON lines, and its parsing.

A socket is one way to fill the landing folder; the engine reads the folder as
a stream, which a checkpoint makes restartable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.constants import Region
from fathomline.functions.scalars import blank_to_null, sane

_REPORT = "struct<UserID:bigint, Latitude:double, Longitude:double, Sog:double, Cog:double, TrueHeading:double, NavigationalStatus:int>"
_STATIC = (
    "struct<UserID:bigint, Name:string, ImoNumber:bigint, CallSign:string, Type:int, Dimension:struct<A:double, B:double, C:double, D:double>, "
    "MaximumStaticDraught:double, Destination:string>"
)
MESSAGE = (
    "MessageType string, MetaData struct<MMSI:bigint, ShipName:string, time_utc:string, latitude:double, longitude:double>, "
    f"Message struct<PositionReport:{_REPORT}, ShipStaticData:{_STATIC}>"
)
TYPES = ("PositionReport", "ShipStaticData")


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a landing folder as a stream: value, seq and ingest_ts.

    ``seq`` orders lines by the time of their file and their place in it;
    ``ingest_ts`` (epoch seconds) is the time of the file.  Files are small, as
    they land every few seconds, and each is read whole.
    """
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", 100).load(folder)
    landed = F.unix_millis("_metadata.file_modification_time")
    lines = files.select(F.posexplode(F.split("value", "\r?\n")).alias("place", "value"), landed.alias("landed")).where("value <> ''")
    return lines.select("value", (F.shiftleft("landed", 21) + F.col("place")).alias("seq"), (F.col("landed") / 1000.0).alias("ingest_ts"))


def message_time(text: Column, otherwise: Column) -> Column:
    """Epoch seconds of the four known notations; ``otherwise`` where none fits."""
    plain = F.regexp_replace(F.trim(text), r" UTC$", "")
    whole = F.regexp_extract(plain, r"^(\d{4}-\d\d-\d\d)[ T](\d\d:\d\d:\d\d)", 0)
    second = F.regexp_replace(whole, "T", " ")
    part = F.regexp_extract(plain, r"^\S+[ T]\d\d:\d\d:\d\d(\.\d{1,6})", 1)
    zone = F.regexp_extract(plain, r"( [+-]\d{4}|Z)$", 1)
    at = F.try_to_timestamp(F.concat(second, F.when(zone == "Z", " +0000").otherwise(zone)), F.lit("yyyy-MM-dd HH:mm:ss Z")).cast("double")
    return F.coalesce(F.when((second != "") & (zone != ""), at + F.coalesce(part.try_cast("double"), F.lit(0.0))), otherwise)


def parse(lines: DataFrame, ingest_ts: Column) -> DataFrame:
    """Messages of the known types with their number, time and body; others drop."""
    # inline, not a plain column: the optimizer would put the parser (and what made the text) into each condition on its fields
    m = lines.select("*", F.inline(F.array(F.from_json("value", MESSAGE)))).select(F.struct("MessageType", "MetaData", "Message").alias("m"), *[c for c in lines.columns if c != "value"])
    body = F.coalesce("m.Message.PositionReport.UserID", "m.Message.ShipStaticData.UserID")
    rows = m.where(F.col("m.MessageType").isin(*TYPES)).withColumn("mmsi", F.coalesce("m.MetaData.MMSI", body)).where("mmsi is not null")
    return rows.withColumn("ts", message_time(F.col("m.MetaData.time_utc"), ingest_ts))


def positions(messages: DataFrame, area: Region | None = None) -> DataFrame:
    """Fixes of position messages inside an area."""
    p = F.col("m.Message.PositionReport")
    rows = messages.where("m.MessageType = 'PositionReport'").select(
        "mmsi", "ts", F.coalesce(p["Latitude"], F.col("m.MetaData.latitude")).alias("lat"), F.coalesce(p["Longitude"], F.col("m.MetaData.longitude")).alias("lon"),
        sane(p["Sog"], 102.3, 0, 102.2).alias("sog"), sane(p["Cog"], 360, 0, 359.9).alias("cog"), sane(p["TrueHeading"], 511, 0, 359).alias("heading"),
        p["NavigationalStatus"].alias("nav_status"), F.lit("live").alias("source"), *[c for c in messages.columns if c not in ("m", "mmsi", "ts")],
    ).where("lat is not null and lon is not null")
    return rows if area is None else rows.where(F.col("lat").between(area.lat_min, area.lat_max) & F.col("lon").between(area.lon_min, area.lon_max))


def vessels(messages: DataFrame) -> DataFrame:
    """Descriptions from static messages, and names that come with positions."""
    s = F.col("m.Message.ShipStaticData")
    size = lambda a, b: F.nullif(F.coalesce(s["Dimension"][a], F.lit(0.0)) + F.coalesce(s["Dimension"][b], F.lit(0.0)), F.lit(0.0))
    return messages.select(
        "mmsi", "ts", blank_to_null(F.coalesce(s["Name"], F.col("m.MetaData.ShipName"))).alias("name"), F.nullif(s["ImoNumber"], F.lit(0)).cast("string").alias("imo"),
        blank_to_null(s["CallSign"]).alias("callsign"), F.nullif(s["Type"], F.lit(0)).alias("ship_type"), size("A", "B").alias("length_m"), size("C", "D").alias("width_m"),
        sane(s["MaximumStaticDraught"], 0).alias("draught_m"), blank_to_null(s["Destination"]).alias("destination"), *[c for c in messages.columns if c not in ("m", "mmsi", "ts")],
    )
