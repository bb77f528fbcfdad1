"""Point sets and pixel regions: hulls, trimming, components, outlines.

Hulls take a first pass on the partitions: only a partition's own hull can
hold vertices of the whole, so few points move, whatever the group's size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fathomline.functions.geo import polygon_area_km2


def _outer(sorted_points: Iterable[tuple[float, float]]) -> list[tuple[float, float]]:
    """Vertices counter-clockwise from the leftmost of points that come sorted; it holds both chains only."""
    low: list[tuple[float, float]] = []
    high: list[tuple[float, float]] = []
    for p in sorted_points:
        if low and low[-1] == p:
            continue
        x, y = p
        while len(low) > 1 and (low[-1][0] - low[-2][0]) * (y - low[-2][1]) - (low[-1][1] - low[-2][1]) * (x - low[-2][0]) <= 0:
            low.pop()
        while len(high) > 1 and (high[-1][0] - x) * (high[-2][1] - y) - (high[-1][1] - y) * (high[-2][0] - x) <= 0:
            high.pop()
        low.append(p)
        high.append(p)
    return low if len(low) < 2 else low[:-1] + high[:0:-1]


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Vertices counter-clockwise from the leftmost, no three in line."""
    pts = np.asarray(points, float).reshape(-1, 2)
    return np.array(_outer(map(tuple, pts[np.lexsort(pts.T[::-1])].tolist()))).reshape(-1, 2)


#: Points of a group in a batch from which on the batch's own hull is taken first, and rings a batch of results.
HULL_FIRST, RINGS = 64, 2_000


def hulls(points: DataFrame, key: str) -> DataFrame:
    """key and ring ([[lon, lat], ...]) of each group of points (lon, lat).

    Rows come sorted, and a task holds the chains of one group at a time.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, _ = pd.factorize(batch.column(0).to_pandas())
            lon, lat = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            order = np.lexsort((lat, lon, code))
            starts = np.flatnonzero(np.diff(code[order], prepend=-1))
            keep = np.ones(len(order), bool)
            for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
                if b - a >= HULL_FIRST:
                    own = list(zip(lon[order[a:b]].tolist(), lat[order[a:b]].tolist(), strict=True))
                    corners = set(_outer(own))
                    keep[a:b] = [p in corners for p in own]
            yield batch.take(pa.array(order[keep]))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        rings = ((k, [list(p) for p in _outer(row[1:] for row in own)]) for k, own in groupby(rows, itemgetter(0)))
        while piece := list(islice(rings, RINGS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*piece, strict=True), types, strict=True)], names=[key, "ring"])

    kind = dict(points.dtypes)[key]
    types = [to_arrow_type(points.schema[key].dataType), pa.list_(pa.list_(pa.float64()))]
    known = points.select(key, F.col("lon").cast("double"), F.col("lat").cast("double")).dropna()
    few = known.mapInArrow(partial, f"`{key}` {kind}, lon double, lat double")
    return few.repartition(key).sortWithinPartitions(key, "lon", "lat").mapInArrow(whole, f"`{key}` {kind}, ring array<array<double>>")


def hull_area(points: DataFrame, key: str) -> DataFrame:
    return hulls(points, key).withColumn("area_km2", polygon_area_km2(F.col("ring")))


def trimmed(cloud: DataFrame, keep: float, key: str = "step") -> DataFrame:
    """Points within a quantile of the distances (in degrees) from their group's centre; small groups whole.

    Distances that differ by less than 1e-9 degrees are equal, whatever the order in which the centre was summed.
    """
    centre = cloud.groupBy(key).agg(F.avg("lon").alias("clon"), F.avg("lat").alias("clat"), F.count("*").alias("n"))
    rows = cloud.join(centre, key).withColumn("d", F.round(F.hypot(F.col("lon") - F.col("clon"), F.col("lat") - F.col("clat")), 9))
    limit = rows.groupBy(key).agg(F.percentile("d", keep).alias("limit"))
    return rows.join(limit, key).where((F.col("n") < 8) | (F.col("d") <= F.col("limit"))).drop("clon", "clat", "n", "d", "limit")


# -- pixel regions -------------------------------------------------------------


def components(mask: np.ndarray) -> np.ndarray:
    """Labels 1..n of 8-connected regions, by runs of rows joined where they touch."""
    h, w = mask.shape
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edges == 1)
    end = np.nonzero(edges == -1)[1]
    up = list(range(len(row)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    first = np.searchsorted(row, np.arange(h + 1))
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if start[i] <= end[j] and start[j] <= end[i]:  # touching, corners included
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    number: dict[int, int] = {}
    out = np.zeros((h, w), np.int32)
    for i in range(len(row)):
        out[row[i], start[i] : end[i]] = number.setdefault(find(i), len(number) + 1)
    return out


_RING = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]  # clockwise, y down


def outline(region: np.ndarray) -> np.ndarray:
    """Boundary pixels (x, y) of one region in order, by tracing its outer edge."""
    padded = np.pad(region.astype(bool), 1)
    ys, xs = np.nonzero(padded)
    if not len(ys):
        return np.zeros((0, 2), int)
    begin = (int(ys[0]), int(xs[0]))
    out, at, heading = [begin], begin, 6
    first_move = None
    while True:
        for turn in range(8):
            k = (heading + turn) % 8
            nxt = (at[0] + _RING[k][0], at[1] + _RING[k][1])
            if padded[nxt]:
                break
        else:
            break
        if at == begin:
            if first_move is None:
                first_move = k
            elif k == first_move:
                break
        at = nxt
        out.append(at)
        heading = (k + 5) % 8  # look back to the left of where it came from
    ring = np.array(out[:-1] if len(out) > 1 and out[-1] == begin else out)
    return ring[:, ::-1] - 1


def simplify(ring: np.ndarray, eps: float) -> np.ndarray:
    """Closed outline with vertices dropped that lie within eps of the chord."""
    if len(ring) < 4:
        return ring
    far = int(((ring - ring[0]) ** 2).sum(1).argmax())
    keep = {0, far}
    stack = [(0, far), (far, len(ring))]
    closed = np.vstack([ring, ring[:1]]).astype(float)
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        p, q = closed[a], closed[b]
        d = q - p
        v = closed[a + 1 : b] - p
        size = np.hypot(*d)
        dist = np.abs(d[0] * v[:, 1] - d[1] * v[:, 0]) / size if size else np.hypot(v[:, 0], v[:, 1])
        i = int(dist.argmax())
        if dist[i] > eps:
            keep.add(a + 1 + i)
            stack += [(a, a + 1 + i), (a + 1 + i, b)]
    return ring[sorted(keep)]


def ring_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0].astype(float), ring[:, 1].astype(float)
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def ring_length(ring: np.ndarray) -> float:
    return float(np.hypot(*(ring - np.roll(ring, -1, axis=0)).T).sum())


def smallest_box(points: np.ndarray) -> tuple[float, float]:
    """Long and short side of the smallest rectangle, one side of which lies on the hull."""
    hull = convex_hull(points)
    if len(hull) < 3:
        return (float(np.hypot(*(hull[-1] - hull[0]))) if len(hull) else 0.0), 0.0
    edge = np.roll(hull, -1, axis=0) - hull
    unit = edge / np.hypot(edge[:, 0], edge[:, 1])[:, None]
    along, across = hull @ unit.T, hull @ np.stack([-unit[:, 1], unit[:, 0]])
    a, b = np.ptp(along, axis=0), np.ptp(across, axis=0)
    i = int((a * b).argmin())
    return float(max(a[i], b[i])), float(min(a[i], b[i]))
