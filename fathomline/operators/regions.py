"""Regions, land and rings of rasters that are tables of pixels (scene, r, c), one row a pixel.

Scenes may be larger than a task: everything is joins, windows and grouped sums on
pixel keys, so one huge scene is dealt like many small ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Used only where a local session names no checkpoint folder.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/fathomline-rounds"


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder, so that loops have short plans and survive lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or LOCAL_CHECKPOINTS)
    return df.checkpoint()


def connected(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of the nodes of ``edges`` (a, b), by alternating star contraction.

    A large star ties all larger neighbours of a node to the smallest one around it, a
    small star its smaller ones and itself; both keep what is connected.  Edges are stars
    around roots after a number of rounds that grows with the logarithm of the nodes.  A
    round is two grouped minima, combined before they are dealt, and joins that split hot
    nodes; its edges are written, and an unchanged checksum of them ends the loop.
    """

    def star(rows: DataFrame, large: bool) -> DataFrame:
        both = rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b")))
        around = both if large else both.where("b < a")
        low = around.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("m"))
        found = around.join(low, "a")
        if large:
            return found.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        own = low.select("a", F.col("m").alias("b"))
        return found.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own).distinct()

    rows = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
        rows = written(star(star(rows, True), False))
    return rows.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(rows.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def label(pixels: DataFrame) -> DataFrame:
    """The pixels with ``region_r`` and ``region_c``, the first pixel (by row and column) of their 8-connected region.

    Runs of a row are found by a window and meet the runs of the row below through
    the three pixels under each of theirs; the runs' graph is contracted.
    """
    along = Window.partitionBy("scene", "r").orderBy("c")
    start = F.when(F.lag("c").over(along) == F.col("c") - 1, None).otherwise(F.col("c"))
    runs = pixels.withColumn("_s", start).withColumn("_c0", F.last("_s", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")
    node = lambda r, c: F.struct(F.col("scene").alias("scene"), r.cast("long").alias("r"), c.cast("long").alias("c"))
    own = runs.select("scene", "r", "c", node(F.col("r"), F.col("_c0")).alias("b"))
    above = runs.select("scene", (F.col("r") + 1).alias("r"), F.explode(F.array(*[F.col("c") + d for d in (-1, 0, 1)])).alias("c"), node(F.col("r"), F.col("_c0")).alias("a"))
    edges = above.join(own, ["scene", "r", "c"]).select("a", "b").distinct()
    roots = connected(edges)
    named = runs.withColumn("node", node(F.col("r"), F.col("_c0"))).join(roots, "node", "left")
    root = F.coalesce("root", "node")
    return named.select(*pixels.columns, root["r"].alias("region_r"), root["c"].alias("region_c"))


REGION = ("scene", "region_r", "region_c")


def hysteresis(pixels: DataFrame, weak: Column, strong: Column) -> DataFrame:
    """The labelled weak pixels of the regions that hold a strong one."""
    rows = label(pixels.where(weak).withColumn("_strong", strong))
    kept = rows.groupBy(*REGION).agg(F.max("_strong").alias("k")).where("k").drop("k")
    return rows.join(kept, list(REGION), "left_semi").drop("_strong")


def features(labelled: DataFrame, value: str, height: int, width: int, margin: int) -> DataFrame:
    """Size, centre, box, mean value and whether it keeps ``margin`` pixels from the scene's edge, of each region."""
    rows = labelled.groupBy(*REGION).agg(
        F.count("*").alias("pixels"), F.avg("r").alias("mid_r"), F.avg("c").alias("mid_c"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.avg(value).alias("mean")
    )
    inner = (F.col("r0") >= margin) & (F.col("c0") >= margin) & (F.col("r1") < height - margin) & (F.col("c1") < width - margin)
    return rows.withColumn("inner", inner)


def ring(labelled: DataFrame, scene_pixels: DataFrame, value: str, near: int, far: int) -> DataFrame:
    """Mean value of the pixels at chessboard distances ``near`` to ``far`` of each region (``around``, ``around_n``).

    The distance transform is two passes: along the rows each region's pixels reach their
    neighbours in a row as spans, of which the nearest is kept; down the columns the larger
    of both distances counts, and the least of them stays.
    """
    shifts = F.sequence(F.lit(-far), F.lit(far))
    across = labelled.select(*REGION, "r", "c", F.explode(shifts).alias("d")).groupBy(*REGION, "r", (F.col("c") + F.col("d")).alias("c")).agg(F.min(F.abs("d")).alias("d"))
    down = across.select(*REGION, "r", "c", "d", F.explode(shifts).alias("e"))
    apart = down.groupBy(*REGION, (F.col("r") + F.col("e")).alias("r"), "c").agg(F.min(F.greatest("d", F.abs("e"))).alias("apart")).where(F.col("apart").between(near, far))
    return apart.join(scene_pixels.select("scene", "r", "c", value), ["scene", "r", "c"]).groupBy(*REGION).agg(F.avg(value).alias("around"), F.count("*").alias("around_n"))


def filled(rings: DataFrame, cell: float, box: tuple[float, float, float, float] | None = None, id: str = "ring_id") -> DataFrame:
    """r and c of the pixels (``cell`` degrees wide) whose centres lie in each ring ([[lon, lat], ...]), by scan lines.

    Boxes go first.  Each edge meets the rows that it crosses; the crossings of a ring and
    row in order are taken in pairs, even and odd, and each pair is a span of pixels.
    """
    west, south, east, north = box or (-180.0, -90.0, 180.0, 90.0)
    points = rings.where(F.size("ring") >= 3).where(
        (F.array_max(F.transform("ring", lambda p: p[0])) >= west) & (F.array_min(F.transform("ring", lambda p: p[0])) <= east)
        & (F.array_max(F.transform("ring", lambda p: p[1])) >= south) & (F.array_min(F.transform("ring", lambda p: p[1])) <= north)
    )
    following = F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1))
    edges = points.select(id, F.explode(F.arrays_zip(F.col("ring").alias("p"), following.alias("q"))).alias("z")).select(
        id, F.col("z.p")[0].alias("x1"), F.col("z.p")[1].alias("y1"), F.col("z.q")[0].alias("x2"), F.col("z.q")[1].alias("y2")
    ).where("y1 <> y2")
    bound = lambda v, low, high: F.greatest(F.lit(int(low // cell) - 1).cast("long"), F.least(F.lit(int(high // cell) + 1).cast("long"), v))
    row = lambda v, by: bound(F.floor(v / cell) + by, south, north)
    lines = edges.withColumn("r", F.explode(F.sequence(row(F.least("y1", "y2"), -1), row(F.greatest("y1", "y2"), 1)))).withColumn("at", (F.col("r") + 0.5) * cell)
    crossed = lines.where("(y1 > at) <> (y2 > at)").select(id, "r", (F.col("x1") + (F.col("at") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("x"))
    along = Window.partitionBy(id, "r").orderBy("x")
    spans = crossed.withColumns({"k": F.row_number().over(along), "x1": F.lead("x").over(along)}).where("k % 2 = 1")
    column = lambda v, by: bound(F.floor(F.col(v) / cell) + by, west, east)
    found = spans.withColumn("c", F.explode(F.sequence(column("x", -1), column("x1", 1)))).withColumn("lon", (F.col("c") + 0.5) * cell)
    return found.where((F.col("lon") >= F.col("x")) & (F.col("lon") < F.col("x1"))).where(F.col("lon").between(west, east) & ((F.col("r") + 0.5) * cell).between(south, north)).select(id, "r", "c")


#: Sides of a pixel as steps to the neighbour there, then to the start and end of the side that keeps the pixel on its right.
_SIDES = (((-1, 0), (0, 0), (0, 1)), ((0, 1), (0, 1), (1, 1)), ((1, 0), (1, 1), (1, 0)), ((0, -1), (1, 0), (0, 0)))


def outlines(labelled: DataFrame) -> DataFrame:
    """The outlines of regions, edge by edge: ring (its least edge), place in the ring, end (er, ec) and whether it is a corner.

    Sides without a neighbour of the region are edges, and each is followed by one that
    begins where it ends; where two do, the left one keeps diagonal neighbours together.
    So edges make cycles, which pointer doubling numbers (list ranking): in each round an
    edge learns the least edge among twice as many successors, and how far it is.  A round
    without news ends it, after about the logarithm of the longest ring.  Rounds are joins
    on single edges, whatever the size of a ring, and are written.
    """
    sides = F.array(*[
        F.struct(F.lit(d).alias("d"), *[(F.col(a) + k).alias(n) for n, a, k in (("nr", "r", nr), ("nc", "c", nc), ("sr", "r", sr), ("sc", "c", sc), ("er", "r", er), ("ec", "c", ec))])
        for d, ((nr, nc), (sr, sc), (er, ec)) in enumerate(_SIDES)
    ])
    each = labelled.select(*REGION, "r", "c", F.explode(sides).alias("s")).select(*REGION, "r", "c", "s.*")
    taken = labelled.select(*REGION, F.col("r").alias("nr"), F.col("c").alias("nc"))
    edge = F.struct("scene", "r", "c", "d")
    edges = each.join(taken, [*REGION, "nr", "nc"], "left_anti").select(*REGION, edge.alias("edge"), "d", "sr", "sc", "er", "ec")
    begin = edges.select(*REGION, F.col("sr").alias("er"), F.col("sc").alias("ec"), F.col("edge").alias("to"), F.col("d").alias("to_d"))
    turn = F.pmod(F.col("to_d") - F.col("d") + 1, F.lit(4))  # left, straight, right
    linked = edges.join(begin, [*REGION, "er", "ec"]).groupBy("edge").agg(F.min(F.struct(turn.alias("turn"), "to")).alias("n"))
    rows = written(edges.join(linked, "edge").select("edge", *REGION, "er", "ec", (F.col("n.turn") != 1).alias("corner"), F.col("n.to").alias("to")))
    state, step = rows.select("edge", "to", F.col("edge").alias("low"), F.lit(0).cast("long").alias("off")), 1
    while True:
        ahead = state.select(F.col("edge").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"), F.col("off").alias("off2"))
        news = F.col("low2") < F.col("low")
        state = written(state.join(ahead, "to").select("edge", F.col("to2").alias("to"), F.least("low", "low2").alias("low"), F.when(news, F.col("off2") + step).otherwise(F.col("off")).alias("off"), news.alias("news")))
        step *= 2
        if state.where("news").limit(1).count() == 0:
            break
    longest = state.groupBy("low").agg(F.count("*").alias("edges"))
    placed = state.select("edge", "low", "off").join(longest, "low").select("edge", F.col("low").alias("ring"), F.pmod(F.col("edges") - F.col("off"), F.col("edges")).alias("place"))
    return rows.join(placed, "edge").select(*REGION, "ring", "place", "er", "ec", "corner", F.col("edge.d").alias("d"))


def ring_sizes(edges: DataFrame) -> DataFrame:
    """Edges, corners and area of each ring of ``outlines``; holes have negative areas."""
    along = F.when(F.col("d") == 0, -F.col("er")).when(F.col("d") == 1, F.col("ec")).when(F.col("d") == 2, F.col("er")).otherwise(-F.col("ec"))
    return edges.groupBy(*REGION, "ring").agg(F.count("*").alias("edges"), F.count_if("corner").alias("corners"), (F.sum(along) / 2).alias("area"))
