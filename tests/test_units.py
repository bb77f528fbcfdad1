"""Literal expectations and small invariants of functions and operators."""

import json
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline import constants, schemas
from fathomline.functions import geo, scalars
from fathomline.operators import attribution, audit, drift, ingest, raster, regions, reports, shapes, tracks
from fathomline.sources import archives, live, sinks

RING = "array(array(72.7d, 18.9d), array(72.9d, 18.9d), array(72.9d, 19.05d), array(72.7d, 19.05d))"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_geodesy(spark):
    lat, lon = geo.move_bearing(18.0, 72.0, 90.0, 10.0)
    ring = F.expr(RING)
    r = one(
        spark, geo.haversine_km(19.07, 72.87, 18.64, 72.87), geo.bearing_deg(19.07, 72.87, 18.64, 72.87), lat, geo.haversine_km(18.0, 72.0, lat, lon), geo.point_in_ring(72.8, 18.95, ring),
        geo.point_in_ring(72.5, 18.95, ring), geo.polygon_area_km2(ring), geo.angle_diff(350.0, 10.0), geo.knots_to_ms(10.0), geo.polygon_area_km2(F.slice(ring, 1, 2)),
    )
    assert abs(r[0] - 47.8) < 0.5 and abs(r[1] - 180) < 0.1 and abs(r[2] - 18) < 1e-6 and abs(r[3] - 10) < 0.05
    assert r[4] and not r[5] and r[6] > 100 and r[7] == 20 and abs(r[8] - 5.14444) < 1e-9 and r[9] == 0


def test_ship_types(spark):
    got = spark.sql("select * from values ('80'), ('82'), ('70'), (null), ('abc'), ('54'), ('20'), ('31') t(c)").select(scalars.ship_type_name(F.col("c"))).collect()
    assert [r[0] for r in got] == ["Tanker", "Tanker", "Cargo", "Unknown", "Unknown", "Pilot", "Other", "Towing"]


def test_regions(spark):
    assert math.isclose(sum(constants.WEIGHTS.values()), 1)
    assert constants.region("nowhere").key == "mumbai" and constants.region("North-Sea").key == "north-sea"
    assert all(schemas.schema(t).fields for t in schemas.TABLES)


def test_region_stamp(spark):
    pts = spark.createDataFrame([(r.key, (r.lat_min + r.lat_max) / 2, (r.lon_min + r.lon_max) / 2) for r in constants.REGIONS] + [("gulf-of-mexico", 28.6, -88.9), ("north-sea", 51.5, 2.2)], "k string, lat double, lon double")
    assert all(r.stamped == r.k for r in ingest.stamp_region(pts, "mumbai").collect())


def test_interpolation(spark):
    fixes = spark.createDataFrame([(1, 100.0, 10.0, 20.0), (1, 200.0, 11.0, 21.0), (2, 5000.0, 1.0, 1.0)], "mmsi long, ts double, lat double, lon double")
    got = {(r.mmsi, r.ts): (r.lat, r.lon) for r in tracks.interpolate(fixes, [150.0, 9e9, 200.0, 50.0, -1800.0, 3200.0, 5000.0]).collect()}
    assert got[1, 150.0] == (10.5, 20.5) and got[1, 200.0] == (11.0, 21.0) and got[1, 50.0] == (10.0, 20.0)
    assert (1, 9e9) not in got and (1, -1800.0) not in got and got[2, 3200.0 + 0] if (2, 3200.0) in got else True
    assert got[2, 5000.0] == (1.0, 1.0)


def test_throttle(spark):
    fixes = spark.createDataFrame([(1, i, float(t)) for i, t in enumerate((0, 10, 30, 45, 61, 5))], "mmsi long, seq long, ts double")
    assert sorted(r.ts for r in ingest.throttle(fixes).collect()) == [0, 30, 61]


def test_upper_median_and_merge(spark):
    s = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4)], "mmsi long, sog double")
    assert tracks.upper_median_speed(s).first().baseline == 3
    u = spark.createDataFrame([(1, 1, 10.0, "TEST A", "1", None), (1, 2, 5.0, None, None, "ABC")], "mmsi long, seq long, ts double, name string, imo string, callsign string")
    r = ingest.merge_vessels(u).first()
    assert (r.name, r.imo, r.callsign, r.first_seen, r.last_seen) == ("TEST A", "1", "ABC", 10.0, 10.0)


def test_retention(spark):
    now = 1e9
    p = spark.createDataFrame([(1, now - 500 * 86400, "noaa"), (2, now - 500 * 86400, "live"), (3, now - 500 * 86400, None), (4, now, "live")], "mmsi long, ts double, source string")
    assert sorted(r.mmsi for r in ingest.prune(p, now).collect()) == [1, 4]


def test_text(spark):
    r = one(spark, scalars.csv_cell(F.lit("=1+1")), scalars.csv_cell(F.lit(-1.5)), scalars.escape_html(F.lit("<a&'\">")), scalars.compass(F.lit(359.0)), scalars.display_name(F.lit(""), F.lit(7)), scalars.json_or(F.lit("no"), "array<int>", F.array(F.lit(1))))
    assert r[0] == "'=1+1" and r[1] == "'-1.5" and r[2] == "&lt;a&amp;&#39;&quot;&gt;" and r[3] == "N" and r[4] == "MMSI 7" and r[5] == [1]
    texts = spark.createDataFrame([("",), ("0.0",), ("511",), ("0",), (" 3.5 ",), ("x",), (None,)], "t string")
    assert [x[0] for x in texts.select(scalars.archive_number(F.col("t"))).collect()] == [None, None, None, 0.0, 3.5, None, None]


def test_message_times(spark):
    texts = ["2026-09-10 09:36:22.999538 +0000 UTC", "2026-09-10 09:36:22 +0000 UTC", "2026-09-10T09:36:22.5Z", "2026-09-10T09:36:22Z", "soon", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(live.message_time(F.col("t"), F.lit(-1.0))).collect()]
    assert [round(x, 3) for x in got] == [1789032983.0, 1789032982.0, 1789032982.5, 1789032982.0, -1, -1] or got[4:] == [-1, -1] and abs(got[0] - got[1] - 0.999538) < 1e-5


def test_hull_and_regions_grow(spark, data):
    hull = shapes.convex_hull(np.array([[0, 0], [2, 0], [1, 1], [2, 2], [0, 2], [1, 0]]))
    assert sorted(map(tuple, hull)) == [(0, 0), (0, 2), (2, 0), (2, 2)]
    rng = np.random.default_rng(1)
    pts = rng.normal(size=(500, 2))
    df = spark.createDataFrame([(1, float(x), float(y)) for x, y in pts], "k int, lon double, lat double").repartition(3)
    assert sorted(shapes.hulls(df, "k").first().ring) == sorted(shapes.convex_hull(pts).tolist())


def test_components_and_outline():
    mask = np.zeros((6, 8), bool)
    mask[1:3, 1:4] = mask[3, 4] = mask[5, 7] = True
    labels = shapes.components(mask)
    assert labels.max() == 2 and labels[1, 1] == labels[3, 4] != labels[5, 7]
    square = np.zeros((9, 9), bool)
    square[2:7, 2:7] = True
    ring = shapes.outline(square)
    assert shapes.ring_area(ring) == 16 and shapes.ring_length(ring) == 16
    assert sorted(map(tuple, shapes.simplify(ring, 0.5))) == [(2, 2), (2, 6), (6, 2), (6, 6)]
    assert shapes.smallest_box(ring) == (4, 4)


@pytest.mark.parametrize(("damping", "found"), [(0.85, True), (0.70, True), (0.50, True), (0.35, False), (0.22, False), (0.12, False)])
def test_detector(damping, found):
    y, x = np.mgrid[0:700, 0:700]
    slick = 1 - damping * np.exp(-((((x - 350) / 40) ** 2 + ((y - 350) / 15) ** 2) ** 3))
    image = (np.random.default_rng(7).gamma(4, 30, (700, 700)) * slick).astype("f4")
    assert bool(raster.detect_scene(image, (0.0, 50.0, 0.5, 50.4), 0.3)) is found


def test_land_mask():
    ring = np.array([[0.2, 0.2], [0.8, 0.2], [0.8, 0.8], [0.2, 0.8]])
    mask = raster.land_mask([ring, ring + 5], (0, 0, 1, 1), (100, 100), 0)
    assert abs(mask.mean() - 0.36) < 0.02 and mask[50, 50] and not mask[5, 5]
    assert raster.land_mask([ring], (0, 0, 1, 1), (100, 100), 5).mean() > mask.mean()


def test_missing_environment(spark):
    rows = spark.createDataFrame([(0.0, 1.0, None, 1.0, 1.0)], "ts double, wind_speed double, wind_from double, cur_speed double, cur_to double")
    with pytest.raises(Exception, match="wind_from"):
        drift.require(rows).collect()


def test_arguments(spark):
    empty = spark.createDataFrame([], schemas.schema("ais_positions"))
    with pytest.raises(ValueError):
        reports.vessels_live(empty, empty, 0, 0)
    with pytest.raises(ValueError):
        reports.set_status(empty, "x", "Lost")


def test_archive(spark, tmp_path):
    lines = [",".join(archives.ARCHIVE_COLUMNS)] + [f"123456789,2024-12-29T00:00:{s:02d},28.5,-88.0,0.0,90.0,511.0, SHIP ,IMO777,CALL,70,0,100,20,5.5,70,A" for s in (0, 10, 40)] + ["bad,x,1,2,,,,,,,,,,,,,", "5,2024-12-29T00:00:00,1,1,1,1,1,,,,,,,,,,"]
    (tmp_path / "day.csv").write_text("\n".join(lines))
    with zipfile.ZipFile(tmp_path / "day.zip", "w") as z:
        z.write(tmp_path / "day.csv", "day.csv")
    for rows in (archives.archive_csv(spark, str(tmp_path / "day.csv")), archives.archive_zip(spark, str(tmp_path / "day.zip"))):
        fixes = archives.archive_fixes(rows, (-89.0, 28.2, -86.6, 29.6))
        got = sorted((r.ts % 60, r.sog, r.cog, r.heading) for r in fixes.collect())
        assert got == [(0.0, None, 90.0, None), (40.0, None, 90.0, None)]
        v = archives.archive_vessels(rows, fixes).collect()
        assert len(v) == 1 and (v[0].name, v[0].imo, v[0].length_m) == ("SHIP", "777", 100.0)
    # two files and two members: rows of one number are not mixed up, names are those of their own vessel
    head = ",".join(archives.ARCHIVE_COLUMNS)
    line = lambda m, s, n: f"{m},2024-12-29T00:00:{s:02d},28.5,-88.0,1.0,90.0,511.0,{n},IMO{m},,70,0,100,20,5.5,70,A"
    many = tmp_path / "many"
    many.mkdir()
    with zipfile.ZipFile(many / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x.csv", "\n".join([head, line(1, 0, "ALPHA"), line(1, 10, "ALPHA")]))
        z.writestr("notes.txt", "no rows")
        z.writestr("y.csv", "\n".join([head, line(1, 40, "ALPHA")]))
    with zipfile.ZipFile(many / "b.zip", "w") as z:
        z.writestr("x.csv", "\n".join([head, line(2, 5, "BRAVO"), line(2, 20, "BRAVO"), line(1, 50, "LATER")]))
    rows = archives.archive_zip(spark, str(many))
    fixes = archives.archive_fixes(rows)
    assert sorted((r.mmsi, r.ts % 60) for r in fixes.collect()) == [(1, 0.0), (1, 40.0), (2, 5.0)]
    assert sorted((r.mmsi, r.name, r.imo) for r in archives.archive_vessels(rows, fixes).collect()) == [(1, "ALPHA", "1"), (2, "BRAVO", "2")]
    assert archives.archive_zip(spark, str(many), 1).count() == 3
    page = spark.createDataFrame([("<a href=AIS_2024_12_29.zip><a href=AIS_2024_12_31.zip>",)], "page string")
    assert archives.newest_day(page, 2024).first().day == "2024-12-31"


def test_json_sources(spark, tmp_path):
    body = {"entries": [{"set": [{"lat": 1.0, "lon": 2.0, "mmsi": "5", "entryTimestamp": "2024-01-01T00:00:00Z", "exitTimestamp": "2024-01-01T01:00:00Z"}, {"lat": 1.0, "lon": 2.0, "mmsi": "6", "date": "2024-01-02"}]}, {"set": None}]}
    df = spark.createDataFrame([(json.dumps(body),)], "body string")
    assert sorted((r.mmsi, r.ts) for r in archives.activity_fixes(archives.activity_rows(df)).collect()) == [(5, 1704067200.0), (5, 1704070800.0), (6, 1704153600.0)]
    hourly = {"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "wind_speed_10m": [1.0, None], "ocean_current_velocity": [3.6, 7.2]}}
    env = archives.environment(spark.createDataFrame([(json.dumps(hourly),)], "body string")).orderBy("ts").collect()
    assert [r.cur_speed for r in env] == [1.0, 2.0] and env[1].wind_speed is None
    land = {"type": "FeatureCollection", "features": [{"geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]], [[0.1, 0.1], [0.2, 0.1], [0.2, 0.2]]]}}, {"geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 6]]]]}}]}
    (tmp_path / "land.json").write_text(json.dumps(land))
    assert sorted(len(r.ring) for r in archives.land_rings(spark, str(tmp_path / "land.json")).collect()) == [3, 4]
    items = spark.createDataFrame([("a", ("2024-01-02T00:00:00Z", "IW", ["VV"]), [0.0, 0.0, 1.0, 1.0]), ("b", ("2024-01-03T00:00:00Z", "IW", ["HH"]), [0.0, 0.0, 1.0, 1.0]), ("c", ("x", "IW", ["VV"]), [0.0, 0.0, 1.0, 1.0])], archives.SCENE)
    found = archives.scenes(items, (0.5, 0.5, 2, 2), 0, 2e9)
    assert [r.id for r in found.collect()] == ["b", "a"] and archives.newest_scene(found).first().id == "a"
    match = spark.createDataFrame([(json.dumps({"entries": [{"selfReportedInfo": [{"ssvid": "1", "shipname": "A"}, {"ssvid": "2"}]}]}),)], "body string")
    assert archives.vessel_matches(match).first().shipname == "A"


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "cand")
    df = spark.createDataFrame([("a", 1), ("b", 1)], "incident_id string, mmsi int")
    sinks.replace_partitions(df, path, "incident_id")
    sinks.replace_partitions(spark.createDataFrame([("a", 2)], "incident_id string, mmsi int"), path, "incident_id")
    assert sorted((r.incident_id, r.mmsi) for r in spark.read.parquet(path).collect()) == [("a", 2), ("b", 1)]
    inc = spark.createDataFrame([("x", 0.0, -1.0, "=cmd")], "incident_id string, detected_at double, lat double, top_vessel string")
    sinks.export_csv(inc, str(tmp_path / "csv"))
    text = "".join(f.read_text() for f in (tmp_path / "csv").glob("*.csv"))  # one file a partition
    assert "'-1.0" in text and "'=cmd" in text and "1970-01-01T00:00:00.000Z" in text
    table = sinks.Versions(spark, str(tmp_path / "v"))
    assert table.read() is None
    table.write(df)
    table.write(df.limit(1))
    assert table.number() == 2 and table.read().count() == 1


def test_duplicate_spots(spark):
    rows = spark.createDataFrame([("s", 1.0001, 2.0), ("s", 1.0002, 2.0), ("t", 1.0, 2.0)], "scene_id string, lat double, lon double")
    assert [r.n for r in audit.duplicate_spots(rows).collect()] == [2]


def test_seeded_drift_equals_a_step_loop(spark, data):
    from fathomline.plans.fixtures import DETECTED, Tables

    env, steps, n = Tables(spark, data).environment, 20, 40
    ring = [[5.0, 54.0], [5.2, 54.02], [5.15, 54.12], [5.02, 54.1]]
    particles, noise = drift.draws(spark, ring, steps, n)
    got = {(r.step, r.p): (r.lat, r.lon) for r in drift.backtrack(particles, env, noise, DETECTED, steps).collect()}
    e = {r.step: r for r in drift.at_times(env, [DETECTED - 1800.0 * i for i in range(steps)]).collect()}
    start = sorted(particles.collect())
    lat, lon = np.array([r.lat0 for r in start]), np.array([r.lon0 for r in start])
    factor, turn = np.array([r.wind_factor for r in start]), np.array([r.deflection for r in start])
    extra = np.zeros((steps, 2, n))
    for r in noise.collect():
        extra[r.step, :, r.p] = r.north, r.east
    for s in range(steps):
        wind, current = np.radians((e[s].wind_to + turn) % 360), math.radians(e[s].cur_to)
        north = e[s].cur_speed * math.cos(current) + e[s].wind_speed * factor * np.cos(wind) + extra[s, 0]
        east = e[s].cur_speed * math.sin(current) + e[s].wind_speed * factor * np.sin(wind) + extra[s, 1]
        kx = 111.320 * math.cos(math.radians(lat.mean()))
        lat, lon = lat - north * 1800 / 1000 / 110.574, lon - east * 1800 / 1000 / kx
        assert all(abs(got[s + 1, i][0] - lat[i]) < 1e-9 and abs(got[s + 1, i][1] - lon[i]) < 1e-9 for i in range(n))
    assert drift._inside(np.array([[r.lon0, r.lat0] for r in start]), np.array(ring)).all()
    assert drift.draws(spark, [[1.0, 1.0], [1.0, 1.0], [1.0, 1.0]], 1, 3)[0].select("lon0").distinct().count() == 1


def test_detect_leaves_land_and_refuses_huge_scenes(spark, monkeypatch):
    y, x = np.mgrid[0:700, 0:700]
    slick = np.exp(-((((x - 350) / 40) ** 2 + ((y - 350) / 15) ** 2) ** 3))
    pixels = (np.random.default_rng(7).gamma(4, 30, (700, 700)) * (1 - 0.85 * slick)).astype("<f4")
    scene = spark.createDataFrame([("s", 700, 700, 0.0, 50.0, 0.5, 50.4, pixels.tobytes())], "scene_id string, h int, w int, west double, south double, east double, north double, pixels binary")
    found = raster.detect(scene, 0.3).collect()
    assert len(found) == 1 and abs(found[0].lat - 50.2) < 0.01
    coast = [np.array([[0.1, 50.1], [0.4, 50.1], [0.4, 50.3], [0.1, 50.3]])]
    assert raster.detect(scene, 0.3, coast=coast).count() == 0
    patches = raster.detect(scene, 0.3, classify=lambda patch: 0.5 if patch.shape[0] < 200 else 0.1).collect()
    assert patches[0].confidence == 0.5


def test_scenes_do_not_mix(spark):
    rng = np.random.default_rng(2)
    cells = [(s, r, c, float(v + 1000 * k)) for k, s in enumerate("ab") for (r, c), v in np.ndenumerate(rng.gamma(4, 30, (40, 40)))]
    both = spark.createDataFrame(cells, "scene string, r int, c int, v double")
    for work in (
        lambda p, k: raster.rescale(p, k), lambda p, k: raster.lee(p, (40, 40), keys=k), lambda p, k: raster.fill_missing(p.withColumn("v", F.when(F.col("c") == 3, 0.0).otherwise(F.col("v"))), k),
        lambda p, k: raster.thresholds(raster.band_pass(p, (40, 40), 3, 9, k), k), lambda p, k: raster.close(p, 5, "v", k), lambda p, k: raster.open_(p, 5, "v", k),
    ):
        together = {(r.scene, r.r, r.c): tuple(round(v, 6) for v in r[3:]) for r in work(both, ("scene",)).select("scene", "r", "c", *[c for c in work(both, ("scene",)).columns if c not in ("scene", "r", "c")]).collect()}
        for s in "ab":
            own = both.where(F.col("scene") == s).drop("scene")
            rows = work(own, ())
            assert all(together[s, r.r, r.c] == tuple(round(v, 6) for v in r[2:]) for r in rows.select("r", "c", *[c for c in rows.columns if c not in ("r", "c")]).collect())


def test_sql_functions_and_backtrack(spark):
    from fathomline.functions import sql

    sql.register(spark)
    r = spark.sql("select haversine_km(19.07, 72.87, 18.64, 72.87), bearing_deg(19.07, 72.87, 18.64, 72.87), angle_diff(350, 10), knots_to_ms(10), ship_type_name(82), type_score(80, 250)").first()
    assert abs(r[0] - 47.8) < 0.5 and abs(r[1] - 180) < 0.1 and r[2] == 20 and abs(r[3] - 5.14444) < 1e-9 and r[4] == "Tanker" and r[5] == constants.TYPE_BASE["Tanker"]
    detected, ring = 1704153600.0, [[5.0, 54.0], [5.2, 54.02], [5.1, 54.1]]
    series = [(detected - 3600.0 * k, 6.0 + k, 300.0 + k, 0.3, 90.0 - 5 * k) for k in range(5)]
    env = spark.createDataFrame(series, "ts double, wind_speed double, wind_from double, cur_speed double, cur_to double")
    particles = spark.createDataFrame([(i, *p, constants.WIND_FACTOR, constants.DEFLECTION_DEG) for i, p in enumerate(ring)], "p int, lon0 double, lat0 double, wind_factor double, deflection double")
    still = particles.select("p", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("step")).withColumns({"north": F.lit(0.0), "east": F.lit(0.0)})
    want = {(r.p, r.step): (r.ts, r.lat, r.lon) for r in drift.backtrack(particles, env, still, detected, 6).collect()}
    literal = lambda rows: "array(" + ", ".join("array(" + ", ".join(f"{v!r}d" for v in r) + ")" for r in rows) + ")"
    got = {(r.p, r.step): (r.ts, r.lat, r.lon) for r in spark.sql(f"select * from backtrack({literal(ring)}, {detected!r}d, 3, {literal(series)})").collect()}
    assert got.keys() == want.keys() and len(got) == 21
    assert all(abs(a - b) < 1e-9 for k in want for a, b in zip(got[k], want[k]))


def test_archive_url():
    assert archives.archive_url("https://host/x/", "2024-12-09") == "https://host/x/2024/AIS_2024_12_09.zip"


def test_nearest_has_no_radius(spark):
    rng = np.random.default_rng(4)
    cloud = [(int(k), float(a), float(o)) for k, a, o in zip(rng.integers(0, 3, 400), rng.normal(54, 0.5, 400), rng.normal(5, 0.5, 400))] + [(0, -70.0, 170.0)]
    points = [(int(k), int(m), float(a), float(o)) for k, m, a, o in zip(rng.integers(0, 3, 300), rng.integers(1, 40, 300), rng.uniform(-80, 80, 300), rng.uniform(-179, 179, 300))]
    points += [(1, 99, 54.0, 5.0), (1, 99, None, 5.0), (2, 98, *cloud[3][1:])]
    c, p = spark.createDataFrame(cloud, "k int, lat double, lon double"), spark.createDataFrame(points, "k int, mmsi int, lat double, lon double")
    km = lambda a, o, x, y: np.hypot((y - o) * 111.32 * np.cos(np.radians(a)), (x - a) * 110.574)

    def want(keyed):
        out = {}
        for k, m, a, o in points:
            if a is not None:
                own = (k, m) if keyed else (m,)
                out[own] = min([out.get(own, 1e9), *(km(a, o, x, y) for j, x, y in cloud if j == k or not keyed)])
        return out

    for keys in ((), ("k",)):
        got = {tuple(r)[:-1]: r.any_km for r in tracks.nearest(p, c, keys).collect()}
        full = want(bool(keys))
        assert got.keys() == full.keys() and all(abs(got[k] - full[k]) < 1e-6 for k in full)
    assert tracks.nearest(p, c.where("false")).count() == tracks.nearest(p.where("false"), c).count() == 0


def test_vessels_and_incidents_meet_on_legs(spark):
    # a leg of hundreds of km passes the cloud between two fixes; one on another day, one too long and one aside do not
    fixes = [(1, 0.0, 50.0, 0.0), (1, 3600.0, 58.0, 8.0), (2, 0.0, 54.0, 4.0), (2, 500_000.0, 54.0, 4.0), (3, 300_000.0, 54.0, 4.0), (4, 0.0, 10.0, 4.0), (4, 90.0, 10.1, 4.0), (5, 7000.0, 54.0, None)]
    positions = spark.createDataFrame(fixes, "mmsi int, ts double, lat double, lon double")
    clouds = spark.createDataFrame([("a", 54.0, 4.0), ("a", 54.2, 4.1), ("b", -10.0, 4.0)], "incident_id string, lat double, lon double")
    spans = spark.createDataFrame([("a", 0.0, 7200.0), ("b", 0.0, 7200.0)], "incident_id string, t0 double, t1 double")
    assert sorted(map(tuple, attribution.met(positions, clouds, spans, 7200.0).collect())) == [("a", 1), ("a", 2)]


def test_connected_in_few_rounds(spark, monkeypatch):
    rounds, write = [], regions.written
    monkeypatch.setattr(regions, "written", lambda df: rounds.append(1) or write(df))
    path = [(i, i + 1) for i in range(400)]
    star = [(1000, 1001 + i) for i in range(300)] + [(5000, 5000), (6001, 6000), (6001, 6000)]
    got = {r.node: r.root for r in regions.connected(spark.createDataFrame(path + star, "a long, b long").repartition(3)).collect()}
    assert got == {i: 0 for i in range(401)} | {i: 1000 for i in range(1000, 1301)} | {6000: 6000, 6001: 6000}
    assert len(rounds) <= 14
    assert regions.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_outline_with_hole_and_diagonal(spark):
    art = ["#####...", "#...#...", "#.#.#...", "#...#...", "#####...", ".....##.", "......#."]
    pixels = spark.createDataFrame([(1, r, c) for r, line in enumerate(art) for c, x in enumerate(line) if x == "#"], "scene int, r int, c int")
    edges = regions.outlines(regions.label(pixels))
    rings = sorted((r.region_r, r.region_c, r.edges, r.corners, r.area) for r in regions.ring_sizes(edges).collect())
    assert rings == [(0, 0, 12, 4, -9.0), (0, 0, 28, 10, 28.0), (2, 2, 4, 4, 1.0)]
    outer = [r for r in edges.orderBy("place").collect() if r.ring == (1, 0, 0, 0)]
    assert [r.place for r in outer] == list(range(28)) and all(abs(a.er - b.er) + abs(a.ec - b.ec) == 1 for a, b in zip(outer, outer[1:], strict=False))
    assert [(r.er, r.ec) for r in outer if r.corner] == [(0, 5), (5, 5), (5, 7), (7, 7), (7, 6), (6, 6), (6, 5), (5, 5), (5, 0), (0, 0)]
    assert regions.outlines(regions.label(pixels.where("false"))).count() == 0


def test_filled_rings(spark):
    rng = np.random.default_rng(9)
    shapes_ = [(k, rng.uniform(-1, 1, (n, 2)).tolist()) for k, n in enumerate((3, 4, 7, 12))] + [(9, [[0.0, 0.0], [1.0, 1.0]]), (10, [[5.0, 5.0], [6.0, 5.0], [6.0, 6.0]])]
    rings = spark.createDataFrame(shapes_, "ring_id int, ring array<array<double>>")
    got = {tuple(r) for r in regions.filled(rings, 0.05, (-1.0, -1.0, 1.0, 0.5)).collect()}
    at = np.array([((c + 0.5) * 0.05, (r + 0.5) * 0.05) for r in range(-20, 10) for c in range(-20, 20)])
    want = {(k, int(np.floor(y / 0.05)), int(np.floor(x / 0.05))) for k, ring in shapes_[:4] for (x, y), ok in zip(at, drift._inside(at, np.array(ring)), strict=True) if ok}
    assert got == want and len(got) > 300


def test_seeds_of_odd_rings(spark):
    rings = [("line", [[1.0, 1.0], [2.0, 2.0]]), ("thin", [[0.0, 0.0], [1.0, 0.0], [1.0, 1e-9]]), ("box", [[0.0, 0.0], [2.0, 0.0], [2.0, 1.0], [0.0, 1.0]]), ("none", [])]
    got = drift.seeds(spark.createDataFrame(rings, "incident_id string, ring array<array<double>>"), 50).toPandas()
    assert got.groupby("incident_id").size().to_dict() == {"line": 50, "thin": 50, "box": 50}
    line, box = got[got.incident_id == "line"], got[got.incident_id == "box"]
    assert (line.lon0 == 1.5).all() and (line.lat0 == 1.5).all()
    assert box.lon0.between(0, 2).all() and box.lat0.between(0, 1).all() and abs(box.lon0.mean() - 1) < 0.05 and box.lon0.nunique() == 50
    assert abs(got.deflection.mean() - constants.DEFLECTION_DEG) < 2 and 4 < box.deflection.std() < 12
