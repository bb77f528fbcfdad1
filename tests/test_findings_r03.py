"""Faults found in round 3: each test failed before its mend."""

import math

from pyspark.sql import functions as F

from fathomline.operators import drift, shapes


def _hull(points):
    """The corners by brute force: ends of edges with no point to their right."""
    points = sorted(set(points))
    turn = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    inside = lambda a, b, p: turn(a, b, p) == 0 and (p[0] - a[0]) * (p[0] - b[0]) + (p[1] - a[1]) * (p[1] - b[1]) > 0
    return {x for a in points for b in points if a != b and not any(turn(a, b, p) < 0 or inside(a, b, p) for p in points) for x in (a, b)} or set(points)


def test_hulls_of_many_groups(spark):
    """No frame a group: rows are sorted, and one group's chains are held at a time; places not known are left out."""
    rows = [(f"g{i % 40}", float(i * 37 % 101 % 17), float(i * 53 % 103 % 13)) for i in range(3000)]
    rows += [("big", math.sin(i * i), math.cos(i * 7)) for i in range(200)] + [("one", 1.0, 2.0)] * 3 + [("line", float(i), float(i)) for i in range(5)] + [("big", None, 0.0), (None, 1.0, 1.0)]
    found = shapes.hulls(spark.createDataFrame(rows, "g string, lon double, lat double").repartition(5), "g")
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    rings = {r.g: [tuple(p) for p in r.ring] for r in found.collect()}
    want = {g: _hull([(x, y) for k, x, y in rows if k == g and x is not None]) for g in {r[0] for r in rows} - {None}}
    assert {g: set(r) for g, r in rings.items()} == want
    assert all(len(r) == len(set(r)) and r[0] == min(r) for r in rings.values())
    assert rings["line"] == [(0.0, 0.0), (4.0, 4.0)]


def test_passed_without_exchange_of_pairs(spark):
    """Incidents stay at home, and pairs are summed up where they are made; equal to all pairs tried."""
    from pyspark.sql import functions as F

    from fathomline.operators import attribution

    fixes = [(i % 7, 1000.0 * (i * 37 % 50), [-60.01, 0.0, 53.5, 88.5][i % 4] + (i * 13 % 29) / 200, 5 + (i * 17 % 31) / 150) for i in range(600)]
    seen = [(f"i{i}", 1800.0 * (i % 40), [-60.0, 0.02, 53.53, 88.55][i % 4] + (i % 11) / 150, 5 + (i * 7 % 23) / 120) for i in range(200)]
    far = lambda p, q: math.hypot((q[3] - p[3]) * 111.32 * math.cos(math.radians(p[2])), (q[2] - p[2]) * 110.574)
    want = {}
    for q in seen:
        near = [(far(p, q), p) for p in fixes if q[1] - 3 * 3600 <= p[1] <= q[1]]
        if near := [(d, p) for d, p in near if d <= 5]:
            want[q[0]] = (len({p[0] for _, p in near}), round(min(d for d, _ in near), 6))
    positions, incidents = spark.createDataFrame(fixes, "mmsi long, ts double, lat double, lon double"), spark.createDataFrame(seen, "incident_id string, detected_at double, lat double, lon double")
    found = attribution.passed(positions, incidents, 3.0, 5.0)
    assert {r.incident_id: (r.vessels, round(r.closest_km, 6)) for r in found.collect()} == want
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 2
    each = attribution.passers(positions, incidents, 3.0, 5.0).groupBy("incident_id").agg(F.count("*").alias("n"), F.min("km").alias("km"))
    assert {r.incident_id: (r.n, round(r.km, 6)) for r in each.collect()} == want


def test_one_decimal_by_exact_value(spark):
    from fathomline.operators import ingest

    areas = [0.25, 0.35, 15.25, 15.35, 0.15, 0.45, 12.05, 1234567.85, 0.0, 99.95, 7.0] + [k / 20 for k in range(1, 400)]
    rows = spark.createDataFrame([(str(i), a, "s", "Open", 0.0, 0.0, 0.5) for i, a in enumerate(areas)], "incident_id string, area_km2 double, scene_id string, status string, detected_at double, created_at double, confidence double")
    texts = {r.incident_id: r.text.split()[3] for r in ingest.detection_stages(rows).where("stage = 'detected'").collect()}
    assert texts == {str(i): f"{a:.1f}" for i, a in enumerate(areas)}


def test_archived_zero_speeds(spark, tmp_path):
    """A known speed of 0 stays known in the archive's text."""
    from fathomline.plans.queries import QUERIES

    spark.sql("select 5L as event_id, timestamp_ntz'2024-01-05 00:00:00' as ts, 7L as user_id, 'view' as event_type, 0d as value, '' as props").write.parquet(f"{tmp_path}/events.parquet")
    assert [r.sog for r in QUERIES["archive_positions"](spark, str(tmp_path)).collect()] == [0.0]


def test_fixes_of_equal_times_in_any_order(spark):
    """Fixes that tie in time give the same results, however the rows come."""
    from fathomline.operators import reports, tracks

    rows = [(9, 1000.0 * (i // 3), 53.0 + (i * 7 % 10) / 10, 4.0 + (i * 3 % 10) / 10, 5.0, 37.0 * i % 360, 90.0, 0, "live") for i in range(12)]
    vessels = spark.createDataFrame([(9, "A", 70, 100.0)], "mmsi long, name string, ship_type int, length_m double")
    found = []
    for given in (rows, rows[::-1]):
        fixes = spark.createDataFrame(given, "mmsi long, ts double, lat double, lon double, sog double, cog double, heading double, nav_status int, source string").coalesce(1)
        results = tracks.interpolate(fixes, [500.0, 1500.0, 2500.0]), tracks.course_deviation(fixes), tracks.thin(fixes, 4), reports.vessels_live(fixes, vessels, 3600.0)
        found.append([sorted(map(tuple, df.collect())) for df in results])
    assert found[0] == found[1]


def test_drift_of_many_slicks_in_one_pass(spark, data):
    """seeds need no window, a small file of rings is spread, and each slick moves as it does alone."""
    from fathomline.plans.fixtures import DETECTED, Tables

    t = Tables(spark, data)
    rings = spark.createDataFrame([(k, [[5.0 + k, 54.0], [5.2 + k, 54.02], [5.15 + k, 54.12]]) for k in range(7)], "ring_id long, ring array<array<double>>").coalesce(1)
    seeds = drift.seeds(rings, 30, "ring_id")
    plan = seeds._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and seeds.rdd.getNumPartitions() == 3
    seeds = seeds.where("not (ring_id = 3 and p > 4)")  # slicks of unequal sizes
    noise = t.noise_of(spark.range(30).selectExpr("cast(id as int) as p"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")  # slicks cross batches
    try:
        shared = {tuple(r)[:3]: tuple(r)[3:] for r in drift.backtrack(seeds, t.environment, noise, DETECTED, 48, ("ring_id",)).collect()}
        own = {tuple(r)[:3]: tuple(r)[3:] for r in drift.backtrack(seeds, t.environment, t.noise_of(seeds, "ring_id"), DETECTED, 48, ("ring_id",)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert shared == own and len(shared) == 49 * (6 * 30 + 5)
    for k in (0, 3):
        alone = drift.backtrack(seeds.where(F.col("ring_id") == k).drop("ring_id"), t.environment, noise, DETECTED, 48).collect()
        assert all(max(abs(x - y) for x, y in zip(shared[k, r.p, r.step], (r.ts, r.lat, r.lon), strict=True)) < 1e-9 for r in alone)


def test_messages_are_parsed_once(spark, data):
    """conditions on a message's fields do not parse it (nor write it) again."""
    from fathomline.plans.queries import QUERIES

    plan = QUERIES["live_positions"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") <= 2 * 3  # in each of the three kinds of lines, once and in a check of its generator


def test_nearest_is_bounded_by_vessel(spark):
    """F16: boxes of a vessel's fixes go down together under its own bound; no window a fix.  Equal to all pairs tried."""
    from fathomline.operators import tracks

    fixes = [(i % 4, 53 + i * 37 % 101 / 90, 4 + i * 53 % 103 / 90) for i in range(800)] + [(7, 28.5 + i / 400, -89.0) for i in range(200)] + [(8, 0.1, 179.0), (8, -0.1, 5.0)]
    places = [(50 + i * 7 % 61 / 9, 2 + i * 11 % 67 / 9) for i in range(500)]
    found = tracks.nearest(spark.createDataFrame(fixes, "mmsi int, lat double, lon double"), spark.createDataFrame(places, "lat double, lon double"))
    specs = [line.split("windowspecdefinition(")[1:] for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    specs = [s.split("specifiedwindowframe")[0] for line in specs for s in line]
    assert specs and not any("lat#" in s for s in specs)
    km = lambda a, o, x, y: math.hypot((y - o) * 111.32 * math.cos(math.radians(a)), (x - a) * 110.574)
    want = {m: min(km(a, o, x, y) for k, a, o in fixes if k == m for x, y in places) for m in {f[0] for f in fixes}}
    got = {r.mmsi: r.any_km for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[m] - want[m]) < 1e-9 for m in want)


def test_candidates_in_one_exchange(spark, data, monkeypatch):
    """grouping, ranks and repeated ranks share one exchange, whose parts grow in number, not in rows."""
    from fathomline.plans import fixtures
    from fathomline.plans.queries import QUERIES

    monkeypatch.setattr(fixtures, "PART_ROWS", 500)
    plan = QUERIES["duplicate_ranks"](spark, data)._jdf.queryExecution().executedPlan().toString()
    lines = spark.read.parquet(f"{data}/lineitem.parquet").count()
    assert plan.count("Exchange hashpartitioning") == 1 and f", {-(-lines // 500)})" in plan.replace(", REPARTITION_BY_NUM", ")")
