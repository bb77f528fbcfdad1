"""Deterministic projections of the generic input tables onto the engine's tables.

``Tables(spark, sf_dir)`` gives each as a DataFrame; ``CTES`` has the same
projections as SQL for DuckDB.  Every decimal constant is a double.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.functions.scalars import sane

#: The instant at which the incident of the drift queries is detected, and "now" of the reports.
DETECTED, NOW = 1704153600.0, 996624000.0

#: Order lines in a part of the candidates.
PART_ROWS = 400_000


def padded(x: str) -> str:
    """A number of five digits at least, never cut."""
    return f"lpad(cast({x} as string), cast(greatest(5, length(cast({x} as string))) as int), '0')"


def padded_sql(x: str) -> str:
    return padded(x).replace("string", "varchar")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        epoch = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))") / F.lit(1e6)
        return self.source("events").withColumn("e", epoch)

    @cached_property
    def ais_raw(self) -> DataFrame:
        return self.events.selectExpr(
            "200000000 + user_id as mmsi",
            "event_id as seq",
            "round(1704067200 + (e - 1704067200) / 30d, 1) as ts",
            "(case when user_id % 10 = 0 then 28 else 53 end) + ((user_id * 37) % 100) / 100d + case when user_id % 25 = 1 then 0d else (e - 1704067200) / 2592000d * 0.5d end as lat",
            "(case when user_id % 10 = 0 then -90 else 4 end) + ((user_id * 53) % 100) / 50d + case when user_id % 25 = 1 then 0d else ((event_id * 7919) % 1000) / 10000d end as lon",
            "case when user_id % 25 = 1 then 0.1d when event_type = 'error' then 102.3d else value / 20d end as raw_sog",
            "cast((event_id * 137) % 361 as double) as raw_cog",
            "cast((event_id * 71) % 512 as double) as raw_heading",
            "cast(event_id % 16 as int) as nav_status",
            "case event_type when 'signup' then 'noaa' when 'click' then 'gfw' else 'live' end as source",
        )

    @cached_property
    def positions(self) -> DataFrame:
        return self.arrivals.drop("seq")

    @cached_property
    def arrivals(self) -> DataFrame:
        """The positions with their order of arrival (seq)."""
        kept = ["seq", "mmsi", "ts", "lat", "lon"]
        return self.ais_raw.select(
            *kept, sane(F.col("raw_sog"), 102.3, 0, 102.2).alias("sog"), sane(F.col("raw_cog"), 360, 0, 359.9).alias("cog"),
            sane(F.col("raw_heading"), 511, 0, 359).alias("heading"), "nav_status", "source",
        )

    @cached_property
    def vessels(self) -> DataFrame:
        users = self.source("events").select("user_id").distinct().where("user_id % 12 <> 5")
        names = self.source("customer").select(F.col("c_custkey").alias("user_id"), "c_name")
        return users.join(names, "user_id", "left").selectExpr(
            "200000000 + user_id as mmsi",
            "case when user_id % 11 = 0 then null else c_name end as name",
            "cast(9000000 + user_id as string) as imo",
            "cast(case when user_id % 9 = 0 then null else 20 + (user_id * 7) % 80 end as int) as ship_type",
            "cast(20 + (user_id * 13) % 380 as double) as length_m",
        )

    @cached_property
    def incidents(self) -> DataFrame:
        return self.source("orders").selectExpr(
            f"concat('OTA-2024-', {padded('o_orderkey')}) as incident_id",
            "cast(datediff(o_orderdate, date'1970-01-01') * 86400L as double) as detected_at",
            "50 + (o_orderkey % 700) / 100d as lat",
            "2 + (o_custkey % 700) / 100d as lon",
            "o_totalprice / 10000d as area_km2",
            "((o_orderkey * 31) % 1000) / 1000d as confidence",
            "case o_orderstatus when 'F' then 'Confirmed' when 'O' then 'Under Investigation' else 'Dismissed' end as status",
            "case o_custkey % 7 when 0 then 'mumbai' when 1 then 'gulf-of-kutch' when 2 then 'north-sea' when 3 then 'english-channel' when 4 then 'gulf-of-mexico' when 5 then 'singapore' end as region",
            "concat('S1A_', cast(o_custkey as string)) as scene_id",
        ).withColumn("created_at", F.expr("detected_at + 3600d * (1 + cast(substr(incident_id, 10) as bigint) % 48)"))

    @cached_property
    def candidates(self) -> DataFrame:
        """One exchange, by incident, serves grouping, ranks and what groups them by incident; its parts hold so many rows at any scale."""
        lines = self.source("lineitem")
        parts = max(self.spark.sparkContext.defaultParallelism, -(-lines.count() // PART_ROWS))
        rows = lines.selectExpr(f"concat('OTA-2024-', {padded('l_orderkey')}) as incident_id", "200000000 + l_suppkey as mmsi", "l_discount").repartition(parts, "incident_id")
        rows = rows.groupBy("incident_id", "mmsi").agg(F.max("l_discount").alias("d")).selectExpr("incident_id", "mmsi", "round(1 - d * 5, 4) as score", "d")
        best = Window.partitionBy("incident_id").orderBy(F.desc("score"), "mmsi")
        return rows.withColumn("rank", F.row_number().over(best))

    @cached_property
    def alerts(self) -> DataFrame:
        return self.events.where("event_type = 'error'").selectExpr(
            "event_id as id", "e as ts", "case when event_id % 3 = 0 then null else concat('OTA-2024-', lpad(cast(event_id % 2500 as string), 5, '0')) end as incident_id", "event_type as kind"
        )

    @cached_property
    def timeline(self) -> DataFrame:
        return self.incidents.selectExpr("incident_id", "stack(2, detected_at, 'detected', created_at, 'created') as (ts, stage)")

    @cached_property
    def environment(self) -> DataFrame:
        """Wind and current of each hour, from the events of the hour."""
        hours = self.events.groupBy(F.floor((1704067200 + (F.col("e") - 1704067200) / 30) / 3600).alias("h"))
        sums = {"a": "event_id % 101", "b": "user_id", "c": "user_id % 13", "d": "event_id % 17"}
        return hours.agg(*[F.sum(F.expr(x)).alias(k) for k, x in sums.items()]).selectExpr(
            "3600d * h as ts", "6d + (a % 101) / 50d as wind_speed", "cast((280 + b % 120) % 360 as double) as wind_from", "0.2d + (c % 101) / 500d as cur_speed", "cast(90 + d % 150 as double) as cur_to"
        )

    @cached_property
    def particles(self) -> DataFrame:
        """A slick of 64 particles; the customers of each decide how wind moves it."""
        frac = lambda x: f"(({x}) - floor({x}))"
        dealt = self.source("customer").groupBy(F.expr("cast(c_custkey % 64 as int)").alias("p")).agg(F.expr("sum(c_custkey + c_nationkey) % 100003").alias("k"))
        return dealt.selectExpr(
            "p", "5d + 0.01d * (p % 8) as lon0", "54d + 0.01d * floor(p / 8d) as lat0",
            f"0.03d * (0.65d + 0.7d * {frac('k * 0.618034d')}) as wind_factor", f"15d + 8d * (2d * {frac('k * 0.7548777d')} - 1d) as deflection",
        )

    @cached_property
    def noise(self) -> DataFrame:
        return self.noise_of(self.particles)

    @staticmethod
    def noise_of(particles: DataFrame, *keys: str) -> DataFrame:
        """Currents that stand for diffusion, by particle and step."""
        frac = lambda c: f"((p * 131 + step * 71) * {c}d - floor((p * 131 + step * 71) * {c}d))"
        each = particles.select(*keys, "p", F.explode(F.sequence(F.lit(0), F.lit(47))).alias("step"))
        return each.selectExpr(*keys, "p", "step", f"0.06d * (2d * {frac('0.5698403')} - 1d) as north", f"0.06d * (2d * {frac('0.3247179')} - 1d) as east")

    @cached_property
    def pixels(self) -> DataFrame:
        """Fixes of the sea counted by cells of a fiftieth of a degree, a scene every 2,500 events."""
        rows = self.ais_raw.where("lat between 53 and 54.5 and lon between 4 and 6.1")
        rows = rows.selectExpr("cast(floor(seq / 2500) as bigint) as scene", "cast(floor((lat - 53) * 50) as int) as r", "cast(floor((lon - 4) * 50) as int) as c")
        return rows.groupBy("scene", "r", "c").agg(F.count("*").alias("v"))

    @cached_property
    def rings(self) -> DataFrame:
        """A five-cornered, not convex ring for each supplier."""
        lon, lat, size = "(2 + (s_suppkey * 37 % 500) / 100d)", "(52 + (s_suppkey * 53 % 400) / 100d)", "(0.05d + (s_suppkey % 7) / 50d)"
        corners = ((0, 1), (0.9, 0.3), (0.2, 0.1), (0.5, -0.8), (-1, -0.4))
        return self.source("supplier").selectExpr("s_suppkey as ring_id", f"array({', '.join(f'array({lon} + {x}d * {size}, {lat} + {y}d * {size})' for x, y in corners)}) as ring")

    @cached_property
    def raster(self) -> DataFrame:
        """Scenes of 96 x 96 pixels, each from 9,216 events in turn: speckle of its events, and a dark slick amidst."""
        rows = self.source("events").selectExpr("event_id div 9216 as scene", "cast(event_id % 9216 as int) as k", "user_id * 31 + event_id as x")
        grid = rows.select("scene").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9215))))
        cells = grid.join(rows.groupBy("scene", "k").agg(F.sum("x").alias("x")), ["scene", "k"], "left").selectExpr("scene", "k div 96 as r", "k % 96 as c", "coalesce(x, 0) as x")
        return cells.selectExpr(
            "scene", "cast(r as int) as r", "c", "(120d + 30d * (((x + r * 31 + c * 17 + r * c) % 97) / 97d)) * (1d - (0.7d - 0.25d * (scene % 3)) * exp(-pow(pow((c - 48) / 12d, 2d) + pow((r - 48) / 6d, 2d), 3d))) as v"
        )


# The same as SQL.  A projection may use those before it.
CTES = {
    "ev": "select *, epoch_us(ts) / 1e6 as e from events",
    "ais_raw": """select 200000000 + user_id as mmsi, event_id as seq, round(1704067200 + (e - 1704067200) / 30e0, 1) as ts,
  (case when user_id % 10 = 0 then 28 else 53 end) + ((user_id * 37) % 100) / 100e0 + case when user_id % 25 = 1 then 0e0 else (e - 1704067200) / 2592000e0 * 0.5e0 end as lat,
  (case when user_id % 10 = 0 then -90 else 4 end) + ((user_id * 53) % 100) / 50e0 + case when user_id % 25 = 1 then 0e0 else ((event_id * 7919) % 1000) / 10000e0 end as lon,
  case when user_id % 25 = 1 then 0.1e0 when event_type = 'error' then 102.3e0 else value / 20e0 end as raw_sog,
  cast((event_id * 137) % 361 as double) as raw_cog, cast((event_id * 71) % 512 as double) as raw_heading, cast(event_id % 16 as int) as nav_status,
  case event_type when 'signup' then 'noaa' when 'click' then 'gfw' else 'live' end as source from ev""",
    "ais_positions": """select mmsi, ts, lat, lon, case when not (abs(raw_sog - 102.3e0) < 1e-6 or raw_sog < 0 or raw_sog > 102.2e0) then raw_sog end as sog,
  case when not (abs(raw_cog - 360) < 1e-6 or raw_cog < 0 or raw_cog > 359.9e0) then raw_cog end as cog,
  case when not (abs(raw_heading - 511) < 1e-6 or raw_heading < 0 or raw_heading > 359) then raw_heading end as heading, nav_status, source from ais_raw""",
    "vessels": """select 200000000 + user_id as mmsi, case when user_id % 11 = 0 then null else c_name end as name, cast(9000000 + user_id as varchar) as imo,
  cast(case when user_id % 9 = 0 then null else 20 + (user_id * 7) % 80 end as int) as ship_type, cast(20 + (user_id * 13) % 380 as double) as length_m
  from (select distinct user_id from events where user_id % 12 <> 5) u left join customer on c_custkey = user_id""",
    "incidents": f"""select *, detected_at + 3600e0 * (1 + cast(substr(incident_id, 10) as bigint) % 48) as created_at from (
  select 'OTA-2024-' || {padded_sql('o_orderkey')} as incident_id, cast(date_diff('day', date '1970-01-01', cast(o_orderdate as date)) * 86400 as double) as detected_at,
  50 + (o_orderkey % 700) / 100e0 as lat, 2 + (o_custkey % 700) / 100e0 as lon, o_totalprice / 10000e0 as area_km2, ((o_orderkey * 31) % 1000) / 1000e0 as confidence,
  case o_orderstatus when 'F' then 'Confirmed' when 'O' then 'Under Investigation' else 'Dismissed' end as status,
  case o_custkey % 7 when 0 then 'mumbai' when 1 then 'gulf-of-kutch' when 2 then 'north-sea' when 3 then 'english-channel' when 4 then 'gulf-of-mexico' when 5 then 'singapore' end as region,
  'S1A_' || o_custkey as scene_id from orders)""",
    "candidates": f"""select *, cast(row_number() over (partition by incident_id order by score desc, mmsi) as int) as rank from (
  select 'OTA-2024-' || {padded_sql('l_orderkey')} as incident_id, 200000000 + l_suppkey as mmsi, round(1 - d * 5, 4) as score, d
  from (select l_orderkey, l_suppkey, max(l_discount) as d from lineitem group by 1, 2))""",
    "alerts": "select event_id as id, e as ts, case when event_id % 3 = 0 then null else 'OTA-2024-' || lpad(cast(event_id % 2500 as varchar), 5, '0') end as incident_id, event_type as kind from ev where event_type = 'error'",
    "timeline": "select incident_id, detected_at as ts, 'detected' as stage from incidents union all select incident_id, created_at, 'created' from incidents",
    "environment": """select 3600e0 * h as ts, 6e0 + (a % 101) / 50e0 as wind_speed, cast((280 + b % 120) % 360 as double) as wind_from, 0.2e0 + (c % 101) / 500e0 as cur_speed, cast(90 + d % 150 as double) as cur_to
  from (select cast(floor((1704067200 + (e - 1704067200) / 30e0) / 3600) as bigint) as h, sum(event_id % 101) as a, sum(user_id) as b, sum(user_id % 13) as c, sum(event_id % 17) as d from ev group by 1)""",
    "particles": """select p, 5e0 + 0.01e0 * (p % 8) as lon0, 54e0 + 0.01e0 * floor(p / 8e0) as lat0,
  0.03e0 * (0.65e0 + 0.7e0 * (k * 0.618034e0 - floor(k * 0.618034e0))) as wind_factor, 15e0 + 8e0 * (2e0 * (k * 0.7548777e0 - floor(k * 0.7548777e0)) - 1e0) as deflection
  from (select cast(c_custkey % 64 as int) as p, cast(sum(c_custkey + c_nationkey) % 100003 as bigint) as k from customer group by 1)""",
    "noise": """select p, cast(s as int) as step, 0.06e0 * (2e0 * ((p * 131 + s * 71) * 0.5698403e0 - floor((p * 131 + s * 71) * 0.5698403e0)) - 1e0) as north,
  0.06e0 * (2e0 * ((p * 131 + s * 71) * 0.3247179e0 - floor((p * 131 + s * 71) * 0.3247179e0)) - 1e0) as east from particles, range(48) t(s)""",
    "raster": """select scene, r, c, (120e0 + 30e0 * (((x + r * 31 + c * 17 + r * c) % 97) / 97e0)) * (1e0 - (0.7e0 - 0.25e0 * (scene % 3)) * exp(-pow(pow((c - 48) / 12e0, 2e0) + pow((r - 48) / 6e0, 2e0), 3e0))) as v
  from (select scene, cast(k // 96 as int) as r, cast(k % 96 as int) as c, cast(coalesce(x, 0) as bigint) as x from (select distinct event_id // 9216 as scene, k from events, range(9216) t(k))
    left join (select event_id // 9216 as scene, event_id % 9216 as k, sum(user_id * 31 + event_id) as x from events group by 1, 2) using (scene, k))""",
}
CTES["pixels"] = """select seq // 2500 as scene, cast(floor((lat - 53) * 50) as int) as r, cast(floor((lon - 4) * 50) as int) as c, count(*) as v
  from ais_raw where lat between 53 and 54.5 and lon between 4 and 6.1 group by 1, 2, 3"""
_NEEDS = {
    "pixels": ["ev", "ais_raw"],
    "ais_raw": ["ev"], "ais_positions": ["ev", "ais_raw"], "alerts": ["ev"], "timeline": ["incidents"], "noise": ["particles"], "environment": ["ev"],
}


def with_tables(body: str, *names: str, more: dict[str, str] | None = None) -> str:
    """A DuckDB query over projections (and further named ones of its own)."""
    order: list[str] = []
    for name in names:
        order += [n for n in [*_NEEDS.get(name, []), name] if n not in order]
    parts = [f"{n} as ({CTES[n]})" for n in order] + [f"{n} as ({q})" for n, q in (more or {}).items()]
    return f"with {', '.join(parts)} {body}" if parts else body
