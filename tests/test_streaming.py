"""The stateful throttle and the sinks against their batch forms."""

import json
import time

import pytest
from pyspark.sql import functions as F

from fathomline.constants import region
from fathomline.operators import ingest
from fathomline.plans.fixtures import Tables
from fathomline.sources import live
from fathomline.sources.sinks import Versions, drop_old_days
from fathomline.streaming import ingest as streaming
from fathomline.streaming import supervise


def test_stream_equals_batch(spark, data, tmp_path):
    fixes = Tables(spark, data).ais_raw.select("mmsi", "seq", "ts")
    for i in range(3):
        fixes.where((F.col("seq") >= i * 400) & (F.col("seq") < (i + 1) * 400 if i < 2 else F.lit(True))).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    batch = {(r.mmsi, r.seq) for r in ingest.throttle(fixes, interval=1800.0).collect()}
    # one file a trigger, in order of their names: arrival is by seq
    got = set()
    stream = spark.readStream.schema(fixes.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))

    def collect(df, epoch):
        got.update((r.mmsi, r.seq) for r in df.collect())

    q = streaming.throttle(stream, 1800.0).writeStream.foreachBatch(collect).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert got == batch


def message(mmsi, second, lat, sog=5.0, kind="PositionReport", **more):
    body = {"UserID": mmsi, "Latitude": lat, "Longitude": 5.0, "Sog": sog, "Cog": 360.0, "TrueHeading": 511} if kind == "PositionReport" else {"UserID": mmsi, **more}
    return json.dumps({"MessageType": kind, "MetaData": {"MMSI": mmsi, "time_utc": f"2026-09-10 09:36:{second:02d}.5 +0000 UTC"}, "Message": {kind: body}})


def test_live_messages(spark, tmp_path):
    lines = [message(1, 0, 54.0), message(1, 10, 54.0), message(1, 31, 54.0, 102.3), message(2, 0, 10.0), message(1, 40, 0.0, kind="ShipStaticData", Name=" A ", Type=80, Dimension={"A": 100, "B": 50, "C": 0, "D": 0}), "{broken"]
    df = spark.createDataFrame([(t, i, 0.0) for i, t in enumerate(lines)], "value string, seq long, ingest_ts double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streaming.run(stream, str(tmp_path / "out"), str(tmp_path / "cp"), region("north-sea"), once=True)
    assert q.awaitTermination(120)
    got = sorted((r.mmsi, r.ts % 60, r.sog, r.cog, r.heading) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [(m, round(t, 1), s, c, h) for m, t, s, c, h in got] == [(1, 22.5 - 22.5 + 0.5, 5.0, None, None), (1, 31.5, None, None, None)]
    vessels = live.vessels(live.parse(df, F.col("ingest_ts"))).drop("ingest_ts")
    write = streaming.vessel_sink(str(tmp_path / "vessels"))
    write(vessels, 0)
    write(vessels.where("mmsi = 2").withColumn("name", F.lit("B")), 1)
    rows = {r.mmsi: r for r in Versions(spark, str(tmp_path / "vessels")).read().collect()}
    assert rows[1].name == "A" and rows[1].ship_type == 80 and rows[1].length_m == 150 and rows[1].width_m is None and rows[2].name == "B"


def test_replayed_batches_add_nothing(spark, tmp_path):
    path = str(tmp_path / "stored")
    fixes = lambda *rows: spark.createDataFrame([(m, s, float(t), "live") for m, s, t in rows], "mmsi long, seq long, ts double, source string")
    write = streaming.sink(path)
    first = fixes((1, 0, 10), (1, 1, 10), (2, 2, 10), (1, 3, 90_000))
    write(first, 0)
    write(first, 0)
    write(fixes((1, 9, 10), (3, 10, 11), (None, 11, 5)), 1)
    assert sorted((r.mmsi, r.ts) for r in spark.read.parquet(path).collect()) == [(1, 10.0), (1, 90_000.0), (2, 10.0), (3, 11.0)]
    write(fixes(), 2)
    gone = drop_old_days(spark, path, 3 * 86400.0, 2.0)
    assert len(gone) == 1 and "day=1970-01-01" in gone[0]
    assert [(r.mmsi, r.ts) for r in spark.read.parquet(path).collect()] == [(1, 90_000.0)]
    assert drop_old_days(spark, str(tmp_path / "none"), 0.0, 1.0) == []


def test_landing_folder_to_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("\n".join([message(1, 0, 54.0), message(1, 10, 54.0), message(2, 0, 10.0), message(3, 0, 0.0, kind="ShipStaticData", Name="C", Type=70)]))
    lines = live.stream(spark, str(tmp_path / "in"))
    assert lines.columns == ["value", "seq", "ingest_ts"]
    q = streaming.run(lines, str(tmp_path / "fixes"), str(tmp_path / "cp1"), region("north-sea"), once=True)
    assert q.awaitTermination(120)
    assert [r.mmsi for r in spark.read.parquet(str(tmp_path / "fixes")).collect()] == [1]
    told = {k: v.asDict() for p in q.recentProgress for k, v in p["observedMetrics"].items()} if q.recentProgress else {}
    assert told["messages"] == {"positions": 3, "static": 1} and told["fixes"] == {"received": 3, "out_of_area": 1} and told["kept"] == {"fixes": 1}
    v = streaming.run_vessels(lines, str(tmp_path / "vessels"), str(tmp_path / "cp2"), once=True)
    assert v.awaitTermination(120)
    rows = {r.mmsi: r.name for r in Versions(spark, str(tmp_path / "vessels")).read().collect()}
    assert rows == {1: None, 2: None, 3: "C"}


def test_distinct_fixes(spark, tmp_path):
    for i, rows in enumerate(([(1, 10.0), (1, 10.0), (2, 10.0)], [(1, 10.0), (1, 20.0)])):
        spark.createDataFrame(rows, "mmsi long, ts double").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("mmsi long, ts double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = []
    q = streaming.distinct_fixes(stream).writeStream.foreachBatch(lambda df, _: got.extend((r.mmsi, r.ts) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(got) == [(1, 10.0), (1, 20.0), (2, 10.0)]


def test_counters_over_a_restart(spark, tmp_path):
    for i, second in enumerate((0, 10, 50)):
        rows = [(message(1, second, 54.0), 2 * i, 0.0), (message(2, second, 10.0), 2 * i + 1, 0.0)]
        spark.createDataFrame(rows, "value string, seq long, ingest_ts double").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("value string, seq long, ingest_ts double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    counters, out, starts = supervise.Counters(spark, str(tmp_path / "counts")), str(tmp_path / "out"), []
    write = streaming.sink(out)

    def failing(batch, epoch):
        if epoch == 1 and len(starts) == 1:
            raise RuntimeError("the store is away")
        write(batch, epoch)

    def start():
        starts.append(1)
        fixes = live.positions(live.parse(stream, F.col("ingest_ts"))).drop("ingest_ts")
        inside = F.col("lat") > 50
        fixes = fixes.observe("fixes", F.count(F.lit(1)).alias("received"), F.count_if(~inside).alias("out_of_area")).where(inside)
        return streaming._started(streaming.throttle(fixes).observe("kept", F.count(F.lit(1)).alias("stored")), failing, str(tmp_path / "cp"), True)

    spark.streams.addListener(counters)
    try:
        causes = supervise.supervised(start, 0.01)
        for _ in range(100):
            totals = {r.name: r.total for r in supervise.counted(spark, str(tmp_path / "counts")).collect()} if (tmp_path / "counts").exists() else {}
            if totals.get("fixes.received") == 6:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(counters)
    assert len(starts) == 2 and len(causes) == 1
    assert totals == {"fixes.received": 6, "fixes.out_of_area": 3, "kept.stored": 2} and spark.read.parquet(out).count() == 2  # one was throttled

    def broken():
        return stream.writeStream.foreachBatch(lambda *_: 1 / 0).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()

    with pytest.raises(Exception, match="ZeroDivision|division by zero|failed|FOREACH"):
        supervise.supervised(broken, 0.01, most_restarts=1)


def test_versions_keep_a_few(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "v"))
    assert table.number() == 0 and table.read() is None
    for i in range(12):
        assert table.write(spark.range(i)) == i + 1
    (tmp_path / "v/v=13").mkdir()  # a merge that did not end
    assert table.number() == 12 and table.read().count() == 11
    assert sorted(p.name for p in (tmp_path / "v").iterdir()) == ["v=10", "v=11", "v=12", "v=13"]
    assert table.write(spark.range(5)) == 13 and table.read().count() == 5
