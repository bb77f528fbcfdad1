"""Radar rasters: relational filters on a pixel table, and a detector for whole scenes.

A pixel table has (r, c, v), optionally keyed by scene; box windows are
separable, so each filter is two window passes.  Blurs mirror the image at its
edges without repeating the edge pixel; morphology looks at existing pixels
only.  ``detect`` runs the whole detector on scenes of one row each (a few MB
of float32), in numpy on the executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.constants import KM_PER_DEG_LAT, KM_PER_DEG_LON
from fathomline.functions.geo import clip
from fathomline.operators import shapes

STRONG, WEAK = 3.0, 1.8
LEE = 7
LEAST_DB, LEAST_CONFIDENCE, MOST_CONFIDENCE = 1.8, 0.20, 0.97
# Fixed values of the confidence: the contrast in dB where its gate opens and its width, the gate's own share, and of
# each measure of the shape where its score begins, its width and its weight.
GATE_DB, GATE_SHARE = (1.5, 2.5), 0.55
SHAPE_SCORE = {"complexity": (1.3, 2.5, 0.32), "elongation": (1.4, 3.0, 0.26), "homogeneity": (0.0, 1.0, 0.22), "area_km2": (0.0, 10.0, 0.20)}
#: Pixels of a scene, at most.
MOST_PIXELS = 64_000_000


# -- pixel tables --------------------------------------------------------------


def _mirrored(pixels: DataFrame, axis: str, reach: int, size: int) -> DataFrame:
    at = F.col(axis)
    beyond = F.when(at.between(1, reach), -at), F.when(at.between(size - 1 - reach, size - 2), 2 * (size - 1) - at)
    return pixels.withColumn(axis, F.explode(F.array_compact(F.array(at, *beyond))))  # one pass over the pixels, not three


def box_mean(pixels: DataFrame, k: int, size: tuple[int, int], *values: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean of each value over k x k pixels around, k odd."""
    reach = k // 2
    for axis, other, n in (("c", "r", size[1]), ("r", "c", size[0])):
        around = Window.partitionBy(*keys, other).orderBy(axis).rowsBetween(-reach, reach)
        wide = _mirrored(pixels, axis, reach, n)
        pixels = wide.withColumns({v: F.avg(v).over(around) for v in values}).where(F.col(axis).between(0, n - 1))
    return pixels


def morphology(pixels: DataFrame, k: int, value: str, grow: bool, keys: tuple[str, ...] = ()) -> DataFrame:
    """Dilation (grow) or erosion with a k x k square."""
    for axis, other in (("c", "r"), ("r", "c")):
        around = Window.partitionBy(*keys, other).orderBy(axis).rowsBetween(-(k // 2), k // 2)
        pixels = pixels.withColumn(value, (F.max if grow else F.min)(value).over(around))
    return pixels


def close(pixels: DataFrame, k: int, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    return morphology(morphology(pixels, k, value, True, keys), k, value, False, keys)


def open_(pixels: DataFrame, k: int, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    return morphology(morphology(pixels, k, value, False, keys), k, value, True, keys)


def _with_sums(pixels: DataFrame, keys: tuple[str, ...], **sums: Column) -> DataFrame:
    """Each pixel with aggregates of its scene, which are one row a scene."""
    found = pixels.groupBy(*keys).agg(*[c.alias(k) for k, c in sums.items()])
    return pixels.join(found, list(keys)) if keys else pixels.crossJoin(F.broadcast(found))


def rescale(pixels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Values from 0 to 255 over each scene."""
    rows = _with_sums(pixels, keys, low=F.min("v"), high=F.max("v"))
    return rows.withColumn("v", (F.col("v") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-6)) * 255.0).drop("low", "high")


def lee(pixels: DataFrame, size: tuple[int, int], k: int = LEE, keys: tuple[str, ...] = ()) -> DataFrame:
    """Speckle filter: the local mean, more of the pixel where the local variance is large."""
    rows = _with_sums(pixels, keys, overall=F.var_pop("v")).withColumns({"m": F.col("v"), "q": F.col("v") * F.col("v")})
    local = F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0))
    return box_mean(rows, k, size, "m", "q", keys=keys).withColumn("v", F.col("m") + local / (local + F.col("overall") + 1e-9) * (F.col("v") - F.col("m"))).drop("m", "q", "overall")


def band_pass(pixels: DataFrame, size: tuple[int, int], small: int, large: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Background minus local mean: large-scale darkness."""
    both = pixels.withColumns({"near": F.col("v"), "far": F.col("v")})
    both = box_mean(box_mean(both, small, size, "near", keys=keys), large, size, "far", keys=keys)
    return both.select(*keys, "r", "c", (F.col("far") - F.col("near")).alias("contrast"))


def thresholds(contrast: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Median and robust deviation of the contrast, and the pixels above each limit.

    The contrast (four window passes) is read three times, so it is kept.
    """
    rows = _with_sums(contrast.persist(StorageLevel.MEMORY_AND_DISK), keys, med=F.median("contrast"))
    rows = _with_sums(rows, keys, sigma=1.4826 * F.median(F.abs(F.col("contrast") - F.col("med"))) + 1e-6)
    above = lambda n: (F.col("contrast") > F.col("med") + n * F.col("sigma")).cast("int")
    return rows.select(*keys, "r", "c", "contrast", "med", "sigma", above(STRONG).alias("strong"), above(WEAK).alias("weak"))


def confidence(contrast_db: Column, complexity: Column, elongation: Column, homogeneity: Column, area_km2: Column) -> Column:
    """Null for a look-alike; else the contrast's gate times the shape's score."""
    given = {"complexity": complexity, "elongation": elongation, "homogeneity": homogeneity, "area_km2": area_km2}
    shape = sum((weight * clip((given[k] - low) / span, 0, 1) for k, (low, span, weight) in SHAPE_SCORE.items()), F.lit(0.0))
    value = clip((contrast_db - GATE_DB[0]) / GATE_DB[1], 0, 1) * (GATE_SHARE + (1 - GATE_SHARE) * shape)
    return F.when((contrast_db >= LEAST_DB) & (value >= LEAST_CONFIDENCE), F.bround(F.least(value, F.lit(MOST_CONFIDENCE)), 3))


def fill_missing(pixels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Zero means no data; what is missing takes its scene's median."""
    known = pixels.withColumn("v", F.when((F.col("v") != 0) & ~F.isnan("v"), F.col("v")))
    return _with_sums(known, keys, m=F.median("v")).withColumn("v", F.coalesce("v", "m")).drop("m")


def land_fraction(mask: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Share of the pixels (column land, 0 or 1) of each scene that are land."""
    return mask.groupBy(*keys).agg(F.avg(F.col("land").cast("double")).alias("land_fraction"))


# -- whole scenes ---------------------------------------------------------------


def _blur(a: np.ndarray, k: int) -> np.ndarray:
    for axis in (0, 1):
        m = min(k // 2, a.shape[axis] - 1)
        s = np.cumsum(np.pad(a, [(m, m) if i == axis else (0, 0) for i in (0, 1)], mode="reflect"), axis=axis, dtype=np.float64)
        s = np.insert(s, 0, 0, axis=axis)
        n = 2 * m + 1
        a = (np.take(s, range(n, s.shape[axis]), axis) - np.take(s, range(s.shape[axis] - n), axis)) / n
    return a


def _spread(mask: np.ndarray, k: int) -> np.ndarray:
    """Dilation of a boolean mask with a k x k square."""
    out = mask
    for axis in (0, 1):
        m = k // 2
        s = np.insert(np.cumsum(np.pad(out, [(m, m) if i == axis else (0, 0) for i in (0, 1)]), axis=axis), 0, 0, axis=axis)
        n = 2 * m + 1
        out = np.take(s, range(n, s.shape[axis]), axis) > np.take(s, range(s.shape[axis] - n), axis)
    return out


def _shrink(mask: np.ndarray, k: int) -> np.ndarray:
    return ~_spread(~mask, k)


def window_px(km: float, km_per_px: float, low: int = 3, high: int = 401) -> int:
    """An odd window size in pixels."""
    return int(np.clip(round(km / max(km_per_px, 1e-6)), low, high)) | 1


def _sure(db: float, **shape: float) -> tuple[float, float]:
    """The contrast's gate, and the gated score of a shape: numbers as in ``confidence``."""
    unit = lambda x: min(max(x, 0.0), 1.0)
    gate = unit((db - GATE_DB[0]) / GATE_DB[1])
    score = sum(weight * unit((shape[k] - low) / span) for k, (low, span, weight) in SHAPE_SCORE.items())
    return gate, gate * (GATE_SHARE + (1 - GATE_SHARE) * score)


class Scene:
    """One image on its place on the earth, and the size of its pixels in km."""

    def __init__(self, image: np.ndarray, bounds: tuple[float, float, float, float]):
        self.west, self.south, self.east, self.north = bounds
        self.h, self.w = image.shape
        self.px = (self.east - self.west) * KM_PER_DEG_LON * math.cos(math.radians((self.south + self.north) / 2)) / max(self.w, 1)
        self.py = (self.north - self.south) * KM_PER_DEG_LAT / max(self.h, 1)
        raw = image.astype(np.float64)
        raw = (raw - raw.min()) / max(float(np.ptp(raw)), 1e-6) * 255.0
        mean = _blur(raw, LEE)
        local = np.maximum(_blur(raw * raw, LEE) - mean * mean, 0)
        self.filtered = mean + local / (local + raw.var() + 1e-9) * (raw - mean)

    def window(self, km: float) -> int:
        return window_px(km, self.px)

    def dark(self, land: np.ndarray | None) -> np.ndarray:
        """Pixels of dark regions: grown from strong ones, smoothed, off the coast and the image's edge."""
        contrast = _blur(self.filtered, self.window(10.0)) - _blur(self.filtered, self.window(1.5))
        middle = np.median(contrast)
        deviation = 1.4826 * np.median(np.abs(contrast - middle)) + 1e-6
        labels = shapes.components(_shrink(_spread(contrast > middle + WEAK * deviation, self.window(0.6)), self.window(0.6)))
        mask = np.isin(labels, np.setdiff1d(labels[contrast > middle + STRONG * deviation], [0]))
        mask = _spread(_shrink(_shrink(_spread(mask, 7), 7), 5), 5)
        if land is not None:
            mask &= ~_spread(land > 0, self.window(1.0))
        edge = max(self.window(10.0) // 2, 8)
        mask[:edge] = mask[self.h - edge :] = False
        mask[:, :edge] = mask[:, self.w - edge :] = False
        return mask

    def brightness(self, region: np.ndarray, mask: np.ndarray) -> tuple[float, float] | None:
        """Contrast in dB with the water around and homogeneity, if both sides have enough pixels."""
        around = _spread(region, self.window(3.0)) & ~_spread(region, self.window(0.6)) & ~mask
        inside, outside = self.filtered[region], self.filtered[around]
        if min(inside.size, outside.size) < 20:
            return None
        db = 10 * math.log10(max(float(np.median(outside)), 1e-6) / max(float(np.percentile(inside, 25)), 1e-6))
        core = inside[inside <= np.percentile(inside, 60)]
        return db, 1 / (1 + float((core if core.size > 10 else inside).std()) / 10)

    def place(self, x: float, y: float) -> list[float]:
        """Longitude and latitude of a pixel's centre."""
        return [self.west + x / max(self.w - 1, 1) * (self.east - self.west), self.north - y / max(self.h - 1, 1) * (self.north - self.south)]

    def measured(self, region: np.ndarray, mask: np.ndarray, min_area_km2: float) -> dict | None:
        """The detection of one region, or None for a look-alike."""
        ring = shapes.outline(region)
        pixels, perimeter = shapes.ring_area(ring), shapes.ring_length(ring)
        area = pixels * self.px * self.py
        light = self.brightness(region, mask) if area >= min_area_km2 else None
        if light is None:
            return None
        db, homogeneity = light
        long, short = shapes.smallest_box(ring)
        complexity, elongation = perimeter**2 / (4 * math.pi * max(pixels, 1)), long / max(short, 1.0)
        gate, sure = _sure(db, complexity=complexity, elongation=elongation, homogeneity=homogeneity, area_km2=area)
        small = shapes.simplify(ring, 0.004 * perimeter)
        if db < LEAST_DB or sure < LEAST_CONFIDENCE or len(small) < 3:
            return None
        corners = [self.place(x, y) for x, y in small]
        middle = [sum(p[k] for p in corners) / len(corners) for k in (0, 1)]
        return {
            "ring": [[round(a, 6), round(b, 6)] for a, b in corners], "lat": round(middle[1], 5), "lon": round(middle[0], 5),
            "area_km2": round(area, 2), "length_km": round(long * self.px, 2), "width_km": round(max(short, 1.0) * self.py, 2), "confidence": round(min(sure, MOST_CONFIDENCE), 3),
            "contrast_db": round(db, 2), "shape_complexity": round(complexity, 2), "elongation": round(elongation, 2), "homogeneity": round(homogeneity, 3), "contrast_gate": round(gate, 3),
        }


def detect_scene(image: np.ndarray, bounds: tuple[float, float, float, float], min_area_km2: float = 0.8, most: int = 5, land: np.ndarray | None = None, classify: Callable[[np.ndarray], float] | None = None) -> list[dict]:
    """Dark, slick-like regions of one scene, the surest first.

    ``classify`` gets the patch of the image around a region.
    """
    scene = Scene(image, bounds)
    mask = scene.dark(land)
    labels, out = shapes.components(mask), []
    for label in range(1, labels.max() + 1):
        region = labels == label
        found = scene.measured(region, mask, min_area_km2)
        if found and classify is not None:
            r, c = np.nonzero(region)
            found["confidence"] = float(classify(image[r.min() : r.max() + 1, c.min() : c.max() + 1]))
        if found:
            out.append(found)
    return sorted(out, key=lambda d: -d["confidence"])[:most]


DETECTION = (
    "scene_id string, ring array<array<double>>, lat double, lon double, area_km2 double, length_km double, width_km double, confidence double, "
    "contrast_db double, shape_complexity double, elongation double, homogeneity double, contrast_gate double"
)


def detect(scenes: DataFrame, min_area_km2: float = 0.8, most: int = 5, classify: Callable[[np.ndarray], float] | None = None, coast: list[np.ndarray] | None = None) -> DataFrame:
    """Detections of scenes (scene_id, h, w, west, south, east, north, pixels as float32 bytes).

    ``classify`` may be a trained model's score of a region's patch of the
    image; it replaces the confidence where given.  ``coast`` are rings of land
    (longitude, latitude), on and near which nothing is detected; they are shipped
    with the tasks, so they must be of bounded size.  Scenes of over
    ``MOST_PIXELS`` pixels are refused.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for s in pdf.itertuples():
                if s.h * s.w > MOST_PIXELS:
                    raise ValueError(f"scene {s.scene_id} has {s.h * s.w} pixels, over {MOST_PIXELS}")
                image, bounds = np.frombuffer(s.pixels, "<f4").reshape(s.h, s.w), (s.west, s.south, s.east, s.north)
                land = land_mask(coast, bounds, image.shape) if coast else None
                found = detect_scene(image, bounds, min_area_km2, most, land, classify)
                if found:
                    yield pd.DataFrame([{"scene_id": s.scene_id} | d for d in found])

    return scenes.mapInPandas(run, DETECTION)


def land_mask(rings: list[np.ndarray], bounds: tuple[float, float, float, float], shape: tuple[int, int], buffer_km: float = 1.5) -> np.ndarray:
    """1 over land: pixel centres inside a ring by the even-odd rule, the coast grown a little."""
    west, south, east, north = bounds
    h, w = shape
    mask = np.zeros(shape, bool)
    lon, lat = np.linspace(west, east, w), np.linspace(north, south, h)
    for ring in rings:
        if ring[:, 0].max() < west or ring[:, 0].min() > east or ring[:, 1].max() < south or ring[:, 1].min() > north:
            continue
        x1, y1 = ring[:, 0], ring[:, 1]
        x2, y2 = np.roll(x1, -1), np.roll(y1, -1)
        for i, y in enumerate(lat):
            on = (y1 > y) != (y2 > y)
            cuts = np.sort(x1[on] + (y - y1[on]) * (x2[on] - x1[on]) / (y2[on] - y1[on]))
            mask[i] ^= (np.searchsorted(cuts, lon, side="right") % 2).astype(bool)
    if mask.any() and buffer_km > 0:
        px = (east - west) * KM_PER_DEG_LON * math.cos(math.radians((south + north) / 2)) / max(w, 1)
        mask = _spread(mask, window_px(buffer_km, px, 1, 61))
    return mask.astype(np.uint8)
