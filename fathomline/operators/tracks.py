"""Tracks: interpolation at times of a grid, and distances to particle clouds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fathomline.constants import KM_PER_DEG_LAT, KM_PER_DEG_LON
from fathomline.functions.geo import angle_diff, haversine_km, local_km

Keys = tuple[str, ...]

#: Seconds beyond a track's ends for which its end point still counts.
REACH_S = 1800.0
#: Rows of a cloud (or of its cells) that are broadcast; more are joined by a shuffle.
BROADCAST_PARTICLES = 500_000


def grid(end: float, steps: int, seconds: float) -> list[float]:
    """Snapshot times from ``end`` backwards."""
    return [end - i * seconds for i in range(steps + 1)]


#: What orders fixes of equal times.
TIES = ("lat", "lon", "sog", "cog", "heading", "nav_status", "source")


def along(rows: DataFrame, *keys: str) -> WindowSpec:
    """A vessel's fixes by time, and by all else that is known of them where times are equal: every run is alike."""
    return Window.partitionBy(*keys, "mmsi").orderBy("ts", *[c for c in TIES if c in rows.columns])


def interpolate(positions: DataFrame, times: list[float] | Column, keys: Keys = ()) -> DataFrame:
    """mmsi, step, ts, lat, lon at the grid's times that the track covers.

    The grid is small, so each segment takes the times inside it from an
    array: no range join.  The ends of a track reach a little further.  ``times``
    may be a column with an array of (step, at), where each of the ``keys`` (an
    incident) has tracks and a grid of its own.
    """
    order = along(positions, *keys)
    whole = Window.partitionBy(*keys, "mmsi")
    steps = times if isinstance(times, Column) else F.array(*[F.struct(F.lit(i).alias("step"), F.lit(t).alias("at")) for i, t in enumerate(times)])
    ahead = positions.select(*keys, "mmsi", "ts", "lat", "lon", steps.alias("steps"), F.lead("ts").over(order).alias("ts1"), F.lead("lat").over(order).alias("lat1"), F.lead("lon").over(order).alias("lon1"), F.min("ts").over(whole).alias("first"))

    def covered(x):
        at = x["at"]
        inside = (at >= F.col("ts")) & (at < F.col("ts1")) & (at > F.col("first"))
        start = (F.col("ts") == F.col("first")) & (at <= F.col("ts")) & (F.col("ts") - at < REACH_S)
        end = F.col("ts1").isNull() & (at >= F.col("ts")) & (at - F.col("ts") < REACH_S) & ((at > F.col("first")) | ~start)
        return F.coalesce(inside, F.lit(False)) | start | end

    rows = ahead.select("*", F.explode(F.filter("steps", covered)).alias("s")).select("*", "s.step", F.col("s.at"))
    share = F.when(F.col("ts1").isNull() | (F.col("at") <= F.col("ts")), 0.0).otherwise((F.col("at") - F.col("ts")) / (F.col("ts1") - F.col("ts")))
    between = lambda a, b: F.col(a) + F.when(share == 0, 0.0).otherwise(share * (F.col(b) - F.col(a)))
    return rows.select(*keys, "mmsi", "step", F.col("at").alias("ts"), between("lat", "lat1").alias("lat"), between("lon", "lon1").alias("lon"))


def _beside(cloud: DataFrame) -> DataFrame:
    """A cloud, broadcast if its rows are counted to be few."""
    return F.broadcast(cloud) if cloud.count() <= BROADCAST_PARTICLES else cloud


def nearest_matched(points: DataFrame, cloud: DataFrame, keys: Keys = ()) -> DataFrame:
    """Distance of each vessel and step to the nearest particle of the same step."""
    own = cloud.select(*keys, "step", F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    d = local_km(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))
    return points.join(_beside(own), [*keys, "step"]).groupBy(*keys, "mmsi", "step", "ts").agg(F.min(d).alias("km"))


def nearest_any(points: DataFrame, cloud: DataFrame, cell_km: float = 25.0, keys: Keys = ()) -> DataFrame:
    """Distance of each vessel to the nearest particle of any step, as far as ``cell_km``.

    Particles and positions meet by cells of a grid (a particle in its cell
    and the eight around it); a vessel with none so near is left out.  Cells
    are wide enough at every latitude of the cloud.  Particles that share a
    place count once.
    """
    places = cloud.select(*keys, "lat", "lon").distinct()
    rows = F.lit(cell_km / KM_PER_DEG_LAT)
    wide = F.broadcast(cloud.agg((F.lit(cell_km / KM_PER_DEG_LON) / F.cos(F.radians(F.least(F.lit(85.0), F.max(F.abs("lat")) + 1)))).alias("width")))  # one row
    cell = lambda i, j: [(F.floor(F.col("lat") / rows) + i).alias("y"), (F.floor(F.col("lon") / F.col("width")) + j).alias("x")]
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("o")
    spread = places.crossJoin(wide).select("*", around).select(*keys, *cell(F.col("o.i"), F.col("o.j")), F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    own = points.crossJoin(wide).select(*keys, "mmsi", "lat", "lon", *cell(F.lit(0), F.lit(0)))
    d = local_km(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))
    return own.join(_beside(spread), [*keys, "y", "x"]).groupBy(*keys, "mmsi").agg(F.min(d).alias("any_km")).where(F.col("any_km") <= cell_km)


#: Degrees of the finest cells of the descent, and how many of them side by side make one of the next level.
CELL_DEG, WIDEN, LEVELS = 0.05, 4, 6


def nearest(points: DataFrame, cloud: DataFrame, keys: Keys = ()) -> DataFrame:
    """Distance of each vessel to the nearest particle (``any_km``), however far that is.

    Cells of six levels hold boxes of the vessel's points and of the cloud.  Pairs
    of boxes go down from the widest cells (70 are around the earth, so they are
    broadcast without keys): those stay that may hold something nearer than the
    vessel's bound, which is the farthest reach of its best pair, and at first its
    points' distances to one particle of the same finest cell.  Only the points
    and particles of the last pairs are measured.  All joins are on cells;
    nothing is paired with a whole cloud.
    """
    who, edges = [*keys, "mmsi"], ((F.min, "s"), (F.max, "n"), (F.min, "w"), (F.max, "e"))
    fine = lambda c: F.floor(F.col(c) / CELL_DEG)
    up = lambda c: F.floor(F.col(c) / WIDEN).cast("long")

    def boxes(rows: DataFrame, own: list[str], lat: str, lon: str) -> list[DataFrame]:
        levels = [rows.groupBy(*own, "y", "x").agg(*[f(c).alias(k) for (f, k), c in zip(edges, (lat, lat, lon, lon), strict=True)])]
        for _ in range(LEVELS - 1):
            levels.append(levels[-1].groupBy(*own, up("y").alias("y"), up("x").alias("x")).agg(*[f(k).alias(k) for f, k in edges]))
        return levels

    spots = points.select(*who, "lat", "lon").where("lat is not null and lon is not null").withColumns({"y": fine("lat"), "x": fine("lon")})
    places = cloud.select(*keys, F.col("lat").alias("plat"), F.col("lon").alias("plon")).distinct().withColumns({"y": fine("plat"), "x": fine("plon")})
    ours, theirs = boxes(spots, who, "lat", "lon"), boxes(places, list(keys), "plat", "plon")
    theirs = [b.select(*keys, F.col("y").alias("cy"), F.col("x").alias("cx"), *[F.col(k).alias(f"c{k}") for _, k in edges]) for b in theirs]
    d = local_km(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))
    some = places.groupBy(*keys, "y", "x").agg(F.min(F.struct("plat", "plon")).alias("c")).select(*keys, "y", "x", "c.plat", "c.plon")
    bound = spots.join(some, [*keys, "y", "x"]).groupBy(*who).agg(F.min(d).alias("most"))

    def reach(low: bool) -> Column:
        """The least or the greatest distance of points of two boxes; a degree of longitude is as long as at the point."""
        aside = lambda a, b, a_, b_: F.greatest(F.lit(0.0), F.col(a) - F.col(b_), F.col(a_) - F.col(b)) if low else F.greatest(F.col(b) - F.col(a_), F.col(b_) - F.col(a))
        at = [F.cos(F.radians(k)) for k in ("s", "n")]
        wide = F.least(*at) if low else F.when((F.col("s") <= 0) & (F.col("n") >= 0), 1.0).otherwise(F.greatest(*at))
        wide = F.when((F.col("s") >= -90) & (F.col("n") <= 90), wide).otherwise(0.0 if low else 1.0)
        return F.hypot(aside("w", "e", "cw", "ce") * KM_PER_DEG_LON * wide, aside("s", "n", "cs", "cn") * KM_PER_DEG_LAT)

    def pruned(pairs: DataFrame) -> DataFrame:
        near = lambda df: df.where(F.col("most").isNull() | (F.col("low") <= F.col("most") * (1 + 1e-9) + 1e-9))
        pairs = near(pairs.withColumn("low", reach(True)))  # by the bound so far, before anything is sent
        best = F.min(reach(False)).over(Window.partitionBy(*who))  # the pairs of one vessel's boxes
        return near(pairs.withColumn("most", F.least("most", best))).select(*who, "y", "x", "cy", "cx", "most")

    top = ours[-1].join(bound, who, "left")
    pairs = pruned(top.join(theirs[-1], list(keys)) if keys else top.crossJoin(F.broadcast(theirs[-1])))
    for mine, other in zip(reversed(ours[:-1]), reversed(theirs[:-1]), strict=True):
        parents = pairs.select(*who, F.col("y").alias("py"), F.col("x").alias("px"), F.col("cy").alias("pcy"), F.col("cx").alias("pcx"), "most")
        pairs = parents.join(mine.withColumns({"py": up("y"), "px": up("x")}), [*who, "py", "px"])
        pairs = pruned(pairs.join(other.withColumns({"pcy": up("cy"), "pcx": up("cx")}), [*keys, "pcy", "pcx"]))
    last = spots.withColumns({"s": F.col("lat"), "n": F.col("lat"), "w": F.col("lon"), "e": F.col("lon")}).join(pairs, [*who, "y", "x"]).join(theirs[0], [*keys, "cy", "cx"])
    last = last.where(reach(True) <= F.col("most") * (1 + 1e-9) + 1e-9).select(*who, "lat", "lon", "cy", "cx")
    return last.join(places.withColumnsRenamed({"y": "cy", "x": "cx"}), [*keys, "cy", "cx"]).groupBy(*who).agg(F.min(d).alias("any_km"))


def closest(matched: DataFrame, keys: Keys = ()) -> DataFrame:
    """The nearest step of each vessel; of equal ones, the latest in time."""
    best = F.min_by(F.struct("step", "ts", "km"), F.struct("km", "step")).alias("b")
    return matched.groupBy(*keys, "mmsi").agg(best).select(*keys, "mmsi", F.col("b.step").alias("best_step"), F.col("b.ts").alias("best_ts"), F.col("b.km").alias("best_km"))


def density(points: DataFrame, cloud: DataFrame, radius_km: float) -> DataFrame:
    """Share of the particles of the same step within the radius."""
    own = cloud.select("step", F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    near = local_km(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon")) <= radius_km
    return points.join(_beside(own), "step").groupBy("mmsi", "step").agg(F.avg(near.cast("double")).alias("density"))


def snap(times: DataFrame, snapshots: list[float], step_s: float) -> DataFrame:
    """The nearest snapshot of each time, none if it is over one and a half steps away."""
    near = F.array_min(F.array(*[F.struct(F.abs(F.col("ts") - t).alias("gap"), F.lit(i).alias("step")) for i, t in enumerate(snapshots)]))
    return times.withColumn("_n", near).withColumn("step", F.when(F.col("_n.gap") <= 1.5 * step_s, F.col("_n.step"))).drop("_n")


def gaps(positions: DataFrame) -> DataFrame:
    """Seconds since the fix before, within a vessel."""
    return positions.withColumn("gap", F.col("ts") - F.lag("ts").over(along(positions)))


def gap_stats(positions: DataFrame) -> DataFrame:
    return gaps(positions).groupBy("mmsi").agg(F.count("gap").alias("gaps"), F.max("gap").alias("longest"), F.median("gap").alias("typical"))


def course_deviation(positions: DataFrame) -> DataFrame:
    """Largest change between consecutive known courses; needs three of them."""
    known = positions.where("cog is not null")
    turn = angle_diff(F.col("cog"), F.lag("cog").over(along(known)))
    return known.withColumn("turn", turn).groupBy("mmsi").agg(F.when(F.count("*") >= 3, F.max("turn")).alias("worst"))


def upper_median_speed(positions: DataFrame) -> DataFrame:
    """The middle known speed, the upper one of two: the lower one in descending order, from counts of values."""
    return positions.where("sog is not null").groupBy("mmsi").agg(F.expr("percentile_disc(0.5) within group (order by sog desc)").alias("baseline"))


def stationary(positions: DataFrame, keys: Keys = ()) -> DataFrame:
    """Tracks of three fixes or more that stay within 1.5 km and are slow."""
    sums = positions.groupBy(*keys, "mmsi").agg(F.count("*").alias("n"), haversine_km(F.min("lat"), F.min("lon"), F.max("lat"), F.max("lon")).alias("span_km"), F.coalesce(F.median("sog"), F.lit(0.0)).alias("median_sog"))
    return sums.select(*keys, "mmsi", F.when(F.col("n") >= 3, F.col("span_km")).otherwise(0.0).alias("span_km"), ((F.col("n") >= 3) & (F.col("span_km") < 1.5) & (F.col("median_sog") < 0.6)).alias("stationary"))


def thin(positions: DataFrame, most: int = 120) -> DataFrame:
    """Every k-th fix of each track, for about ``most`` fixes."""
    order, whole = along(positions), Window.partitionBy("mmsi")
    rows = positions.withColumns({"_i": F.row_number().over(order) - 1, "_n": F.count("*").over(whole)})
    return rows.where(F.col("_i") % F.greatest(F.lit(1), F.floor(F.col("_n") / most)) == 0).drop("_i", "_n")
