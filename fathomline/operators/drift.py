"""Backward drift of particles through hourly wind and current.

The environment of an area is one series, so a particle's displacement in a
step does not depend on where it is, but for the length of a degree of
longitude, which is taken at the cloud's mean latitude of that step.  So
latitudes are a running sum, the mean latitude is one aggregate by step, and
longitudes are a second running sum: two windows, no loop.  Of many slicks, each
is small, so whole slicks are summed up in a task, many at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.constants import DEFLECTION_DEG, DIFFUSION_MS, DRIFT_SEED, KM_PER_DEG_LAT, KM_PER_DEG_LON, PARTICLES, STEP_MINUTES, WIND_FACTOR
from fathomline.functions.geo import crossings_odd, floor_mod, km_per_deg_lon, ring_centroid
from fathomline.operators.shapes import hull_area, trimmed

SERIES = ("wind_speed", "wind_from", "cur_speed", "cur_to")
#: Series that drift does not need; ``at_times`` gives those that the table has.
MORE = ("wave_m", "sst_c")


def require(environment: DataFrame, *series: str) -> DataFrame:
    """Raises, when run, where a series has no value at all: nothing is made up for it."""
    missing = F.concat_ws(", ", *[F.when(F.count(s).over(Window.partitionBy()) == 0, s) for s in series or SERIES])
    return environment.withColumn("_m", missing).where(F.when(F.col("_m") == "", True).otherwise(F.raise_error(F.concat(F.lit("no values of "), F.col("_m"))).isNull())).drop("_m")


def at_times(environment: DataFrame, times: list[float]) -> DataFrame:
    """The series at the grid's times: linear between hours, clamped at both ends.

    Directions are interpolated as plain numbers, without regard to the turn
    at north.
    """
    along = Window.orderBy("ts")  # an hourly series of one area: a few hundred rows
    series = (*SERIES, *[s for s in MORE if s in environment.columns])
    ahead = environment.select("ts", *series, F.lead("ts").over(along).alias("ts1"), *[F.lead(s).over(along).alias(f"{s}1") for s in series], F.lag("ts").over(along).alias("ts_"))
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(float(t)).alias("at")) for i, t in enumerate(times)])
    inside = lambda x: (F.col("ts1").isNull() | (x["at"] < F.col("ts1"))) & (F.col("ts_").isNull() | (x["at"] >= F.col("ts")))
    rows = ahead.select("*", F.explode(F.filter(steps, inside)).alias("s")).select("*", "s.step", "s.at")
    share = F.when(F.col("ts1").isNull() | (F.col("at") <= F.col("ts")), 0.0).otherwise((F.col("at") - F.col("ts")) / (F.col("ts1") - F.col("ts")))
    value = lambda s: F.col(s) + F.when(share == 0, 0.0).otherwise(share * (F.col(f"{s}1") - F.col(s)))
    return rows.select("step", F.col("at").alias("ts"), *[value(s).alias(s) for s in series]).withColumn("wind_to", floor_mod(F.col("wind_from") + 180.0, 360))


def velocity(wind_factor: Column, deflection: Column) -> tuple[Column, Column]:
    """North and east speed in m/s: the current, and a share of the wind turned to the right."""
    current, wind = F.radians("cur_to"), F.radians(floor_mod(F.col("wind_to") + deflection, 360))
    return F.col("cur_speed") * F.cos(current) + F.col("wind_speed") * wind_factor * F.cos(wind), F.col("cur_speed") * F.sin(current) + F.col("wind_speed") * wind_factor * F.sin(wind)


def drift_vector(sampled: DataFrame) -> DataFrame:
    north, east = velocity(F.lit(WIND_FACTOR), F.lit(DEFLECTION_DEG))
    return sampled.withColumns({"north_ms": north, "east_ms": east})


def backtrack(particles: DataFrame, environment: DataFrame, noise: DataFrame, detected_at: float, steps: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Clouds (p, step, ts, lat, lon), step 0 at detection, each step half an hour earlier.

    ``particles``: p, lon0, lat0, wind_factor, deflection; ``noise``: p, step,
    north, east, a row for each of the steps.  ``keys`` name further columns (an
    incident) that particles have; noise has them too, or is shared by all slicks.
    """
    dt = STEP_MINUTES * 60.0
    sampled = at_times(environment, [detected_at - i * dt for i in range(steps)]).drop("ts")
    if keys:
        return _backtrack_many(particles, sampled, noise, detected_at, steps, keys)
    north, east = velocity(F.col("wind_factor"), F.col("deflection"))
    moves = particles.join(noise, "p").join(F.broadcast(sampled), "step")  # one row a step
    moves = moves.select("p", "lon0", "lat0", (F.col("step") + 1).alias("step"), (-(north + F.col("north")) * dt / 1000.0 / KM_PER_DEG_LAT).alias("dlat"), (east + F.col("east")).alias("ve"))
    start = particles.select("p", "lon0", "lat0", F.lit(0).alias("step"), F.lit(0.0).alias("dlat"), F.lit(0.0).alias("ve"))
    so_far = Window.partitionBy("p").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    rows = start.unionByName(moves).withColumn("lat", F.col("lat0") + F.sum("dlat").over(so_far))
    mean = rows.groupBy((F.col("step") + 1).alias("step")).agg(F.avg("lat").alias("mean_lat"))
    rows = rows.join(F.broadcast(mean), "step", "left")
    dlon = F.when(F.col("step") == 0, 0.0).otherwise(-(F.col("ve") * dt) / 1000.0 / F.greatest(km_per_deg_lon(F.col("mean_lat")), F.lit(1e-6)))
    return rows.withColumn("lon", F.col("lon0") + F.sum(dlon).over(so_far)).select("p", "step", (F.lit(detected_at) - F.col("step") * dt).alias("ts"), "lat", "lon")


def _backtrack_many(particles: DataFrame, sampled: DataFrame, noise: DataFrame, detected_at: float, steps: int, keys: tuple[str, ...]) -> DataFrame:
    """Clouds of many slicks: particles come sorted by slick, and all whole slicks of a batch are summed up at once.

    What the steps of a particle share (current with noise, wind) is four arrays beside it.
    """
    dt, own = STEP_MINUTES * 60.0, [*[k for k in keys if k in noise.columns], "p"]
    current = F.radians("cur_to")
    moves = noise.join(F.broadcast(sampled), "step").select(
        *own, F.struct("step", (F.col("cur_speed") * F.cos(current) + F.col("north")).alias("north"), (F.col("cur_speed") * F.sin(current) + F.col("east")).alias("east"), "wind_speed", "wind_to").alias("s")
    )
    arrays = ("north", "east", "wind_speed", "wind_to")
    moves = moves.groupBy(*own).agg(F.sort_array(F.collect_list("s")).alias("s")).select(*own, *[F.col(f"s.{c}").alias(c) for c in arrays])
    sized = lambda df: df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))  # noqa: E731  # brings slicks together, sorted
    rows = particles.select(*keys, "p", "lon0", "lat0", "wind_factor", "deflection")
    rows = sized(rows).join(F.broadcast(moves), "p") if own == ["p"] else sized(rows.join(moves, own))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        ahead, carried = 0, 0  # rows that the last slick of ``rest`` still lacks, and that wait in it
        for batch in batches:
            if batch.num_rows == 0:
                continue
            sizes, at = batch.column("_n"), ahead
            while at < batch.num_rows:
                begun, at = at, at + sizes[at].as_py()
            if at == batch.num_rows:
                rest, ahead, whole = [], 0, [*rest, batch]
            elif ahead >= batch.num_rows:
                rest, ahead = [*rest, batch], ahead - batch.num_rows
                continue
            else:
                whole, rest, ahead = [*rest, batch.slice(0, begun)], [batch.slice(begun)], at - batch.num_rows
            table = pa.Table.from_batches(whole)
            if table.num_rows:
                yield moved(table)

    def moved(table: pa.Table) -> pa.RecordBatch:
        column = lambda c: table.column(c).to_numpy()[:, None]
        north, east, wind, to = (table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, steps) for c in arrays)
        sizes, starts = table.column("_n").to_numpy(), [0]
        while starts[-1] + sizes[starts[-1]] < len(sizes):
            starts.append(starts[-1] + sizes[starts[-1]])
        turned, wind = np.radians(np.mod(to + column("deflection"), 360)), wind * column("wind_factor")
        still = np.zeros((len(sizes), 1))
        lat = column("lat0") + np.cumsum(np.hstack([still, -(north + wind * np.cos(turned)) * dt / 1000.0 / KM_PER_DEG_LAT]), axis=1)
        mean = np.add.reduceat(lat[:, :-1], starts, axis=0) / sizes[starts][:, None]
        wide = np.repeat(np.maximum(KM_PER_DEG_LON * np.cos(np.radians(mean)), 1e-6), sizes[starts], axis=0)
        lon = column("lon0") + np.cumsum(np.hstack([still, -((east + wind * np.sin(turned)) * dt) / 1000.0 / wide]), axis=1)
        step = np.tile(np.arange(steps + 1, dtype=np.int32), len(sizes))
        each = pa.array(np.repeat(np.arange(len(sizes)), steps + 1))
        columns = [*[table.column(c).combine_chunks().take(each) for c in (*keys, "p")], pa.array(step), pa.array(detected_at - step * dt)]
        columns += [pa.array(v.ravel(), from_pandas=True) for v in (lat, lon)]
        return pa.RecordBatch.from_arrays(columns, names=[*keys, "p", "step", "ts", "lat", "lon"])

    kept = ", ".join(f"`{k}` {particles.schema[k].dataType.simpleString()}" for k in (*keys, "p"))
    return rows.mapInArrow(summed, f"{kept}, step int, ts double, lat double, lon double")


def centreline(cloud: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return cloud.groupBy(*keys, "step", "ts").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def regions(cloud: DataFrame, detected_at: float, hours: tuple[int, ...]) -> DataFrame:
    """Hull and area of the trimmed cloud at some hours before detection, as far as it reaches."""
    steps = [int(h * 60 / STEP_MINUTES) for h in hours]
    own = trimmed(cloud.where(F.col("step").isin(steps)), 0.9)
    rows = hull_area(own.select("step", "lon", "lat"), "step")
    return rows.select((F.col("step") * STEP_MINUTES / 60).cast("int").alias("hours_back"), (F.lit(detected_at) - F.col("step") * STEP_MINUTES * 60.0).alias("ts"), "ring", F.bround("area_km2", 1).alias("area_km2")).where(F.size("ring") >= 3)


def envelope(cloud: DataFrame) -> DataFrame:
    """Hull of all snapshots together."""
    pooled = trimmed(cloud.withColumn("step", F.lit(0)), 0.97)
    return hull_area(pooled.select("step", "lon", "lat"), "step").select("ring", "area_km2")


#: Steps of an even sequence in the plane and of two more: fractions of the powers of the roots of x^3 = x + 1 and x^5 = x + 1.
EVEN = (0.7548776662466927, 0.5698402909980532, 0.8566748838545029, 0.733891856627126)


def seeds(rings: DataFrame, n: int = PARTICLES, id: str = "incident_id") -> DataFrame:
    """Particles (p, lon0, lat0, wind_factor, deflection) of many slicks, ``n`` in each ring ([[lon, lat], ...]).

    Places are the first ``n`` points inside, of an even sequence over the ring's box;
    one and a half times as many as the ring's share of its box asks for, and 64 more,
    are tried, 200 a particle at most.  Too few are taken in turns; none (a ring without
    area) gives the ring's centre.  Wind factors are even, deflections normal.  The
    sequence decides everything, so a task that runs again draws the same.
    """
    side = lambda k, f: f(F.transform("ring", lambda p: p[k]))
    spread = int(rings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    boxed = rings.where(F.size("ring") > 0).repartition(spread, id)  # a small file of rings is much work
    boxed = boxed.select(id, "ring", *[side(k, f).alias(f"{c}{m}") for k, c in ((0, "x"), (1, "y")) for f, m in ((F.array_min, 0), (F.array_max, 1))])
    following = F.concat(F.slice("ring", 2, F.greatest(F.size("ring") - 1, F.lit(1))), F.slice("ring", 1, 1))
    area = F.abs(F.aggregate(F.zip_with("ring", following, lambda p, q: p[0] * q[1] - q[0] * p[1]), F.lit(0.0), lambda s, x: s + x)) / 2
    box = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    tries = F.least(F.lit(200 * n), F.ceil(1.5 * n * box / F.when(area > 0, area)) + 64)
    fraction = lambda i, k: i * EVEN[k] - F.floor(i * EVEN[k])
    edges = F.zip_with("ring", following, lambda p, q: F.struct(p[0].alias("x"), p[1].alias("y"), q[0].alias("x2"), q[1].alias("y2")))

    def hits(of: Column) -> Column:
        place = lambda i: F.struct((of["x0"] + fraction(i, 0) * (of["x1"] - of["x0"])).alias("lon0"), (of["y0"] + fraction(i, 1) * (of["y1"] - of["y0"])).alias("lat0"))
        return F.slice(F.filter(F.transform(F.sequence(F.lit(1).cast("long"), of["tries"]), place), lambda t: crossings_odd(t["lon0"], t["lat0"], of["edges"])), 1, n)

    # an array of one, so that its lambda binds what a ring's tries share: else the optimizer works out edges for each try
    shared = F.array(F.struct("x0", "x1", "y0", "y1", edges.alias("edges"), F.coalesce(tries, F.lit(1)).cast("long").alias("tries")))
    each, inside = boxed.select(id, ring_centroid(F.col("ring")).alias("m"), shared.alias("shared")), F.transform("shared", hits)[0]
    rows = each.select(id, "m", inside.alias("inside")).select(id, "m", "inside", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("p"))
    at = F.when(F.size("inside") > 0, F.get("inside", F.pmod("p", F.greatest(F.size("inside"), F.lit(1)))))
    i = F.col("p") + 1
    normal = F.sqrt(-2 * F.log(1 - fraction(i, 2))) * F.cos(2 * F.pi() * fraction(i, 3))
    return rows.withColumn("at", at).select(
        id, F.col("p").cast("int").alias("p"), F.coalesce("at.lon0", "m.lon").alias("lon0"), F.coalesce("at.lat0", "m.lat").alias("lat0"),
        (WIND_FACTOR * (0.65 + 0.7 * fraction(i, 2))).alias("wind_factor"), (DEFLECTION_DEG + 8.0 * normal).alias("deflection"),
    )


def _inside(at: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Which points (rows of x, y) lie in a ring, by the crossings of a ray to the right."""
    x, y = at[:, :1], at[:, 1:]
    (x1, y1), (x2, y2) = ring.T, np.roll(ring, -1, axis=0).T
    slope = (x2 - x1) / np.where(y2 == y1, 1.0, y2 - y1)
    crossed = ((y1 > y) != (y2 > y)) & (x < x1 + (y - y1) * slope)
    return crossed.sum(axis=1) % 2 == 1


def draws(spark: SparkSession, ring: list[list[float]], steps: int, n: int = PARTICLES, seed: int = DRIFT_SEED) -> tuple[DataFrame, DataFrame]:
    """Random particles and noise of one slick, for ``backtrack``.

    Results to match fix the order of the draws from one generator: points in
    the ring's box (longitude, latitude) until ``n`` lie inside, 200 tries a
    particle at most; wind factors; deflections; then noise step by step, north
    before east.  Too few points are taken in turns; none gives the ring's centre.
    """
    shape = np.array(ring, float)
    low, span = shape.min(axis=0), np.ptp(shape, axis=0)
    tries = low + span * np.random.default_rng(seed).random((200 * n, 2))
    hits = np.flatnonzero(_inside(tries, shape))[:n]
    points = tries[hits] if len(hits) else shape.mean(axis=0, keepdims=True)
    points = points[np.arange(n) % len(points)]
    rng = np.random.default_rng(seed)
    rng.random((hits[-1] + 1 if len(hits) == n else 200 * n, 2))  # as many as were looked at
    factor, turn = rng.uniform(0.65 * WIND_FACTOR, 1.35 * WIND_FACTOR, n), rng.normal(DEFLECTION_DEG, 8.0, n)
    noise = rng.normal(0, DIFFUSION_MS, (steps, 2, n))
    number = np.arange(n, dtype=np.int32)
    particles = pd.DataFrame({"p": number, "lon0": points[:, 0], "lat0": points[:, 1], "wind_factor": factor, "deflection": turn})
    moves = pd.DataFrame({"p": np.tile(number, steps), "step": np.repeat(np.arange(steps, dtype=np.int32), n), "north": noise[:, 0].ravel(), "east": noise[:, 1].ravel()})
    return spark.createDataFrame(particles, "p int, lon0 double, lat0 double, wind_factor double, deflection double"), spark.createDataFrame(moves, "p int, step int, north double, east double")
