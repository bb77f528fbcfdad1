"""Streaming ingest: the stateful throttle and the sink of its micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fathomline.constants import FLUSH_S, THROTTLE_S, Region
from fathomline.functions.geo import in_box
from fathomline.operators.ingest import first_wins, merge_vessels
from fathomline.sources import live
from fathomline.sources.sinks import Versions, stored_positions, write_positions


def throttle(fixes: DataFrame, interval: float = THROTTLE_S, seq: str = "seq") -> DataFrame:
    """The stream's fixes at least ``interval`` after the vessel's last one kept.

    One number of state a vessel.  Within a micro-batch, fixes are taken in
    order of arrival; an older fix that arrives late is dropped.
    """

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(seq, kind="stable")
        kept = []
        for i, ts in enumerate(rows["ts"].to_numpy()):
            if last is None or ts - last >= interval:
                kept.append(i)
                last = float(ts)
        if last is not None:
            state.update((last,))
        yield rows.iloc[kept]

    return fixes.groupBy("mmsi").applyInPandasWithState(keep, fixes.schema, "last double", "append", GroupStateTimeout.NoTimeout)


def distinct_fixes(fixes: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream's fixes without those whose (mmsi, ts) came before, as long as they come no later than ``late``.

    The state is bounded by the watermark; the sink keeps out whatever comes later.
    """
    timed = fixes.withColumn("_at", F.timestamp_seconds("ts")).withWatermark("_at", late)
    return timed.dropDuplicatesWithinWatermark(["mmsi", "ts"]).drop("_at")


def sink(path: str):
    """A ``foreachBatch`` function: append the fixes of a batch whose (mmsi, ts) is not stored yet.

    Only the days that the batch touches are read again.  A batch that is
    replayed, or whose first attempt was cut off, adds what is missing and
    nothing twice.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.where("mmsi is not null and ts is not null").persist()  # used twice; its state is to be stepped once
        days = [r.day for r in batch.select(F.to_date(F.timestamp_seconds("ts")).alias("day")).distinct().collect()]  # a row a day
        write_positions(first_wins(batch, stored_positions(batch.sparkSession, path, days)).drop("seq"), path)
        batch.unpersist()

    return write


def vessel_sink(path: str):
    """A ``foreachBatch`` function: merge descriptions into the next version of the table."""

    def write(batch: DataFrame, epoch: int) -> None:
        table = Versions(batch.sparkSession, path)
        known = table.read()
        if known is None:
            table.write(merge_vessels(batch))
            return
        fresh = merge_vessels(batch)
        columns = [c for c in fresh.columns if c not in ("mmsi", "first_seen", "last_seen")]
        old = known.select("mmsi", *[F.col(c).alias(f"_{c}") for c in known.columns if c != "mmsi"])
        both = old.join(fresh, "mmsi", "full")
        table.write(both.select("mmsi", *[F.coalesce(c, f"_{c}").alias(c) for c in columns], F.coalesce("_first_seen", "first_seen").alias("first_seen"), F.greatest("_last_seen", "last_seen").alias("last_seen")))

    return write


def run(lines: DataFrame, positions_path: str, checkpoint: str, area: Region | None = None, once: bool = False) -> StreamingQuery:
    """Parse, clean, throttle and store a stream of live messages (columns value, seq, ingest_ts).

    The query's progress tells how many messages came by kind, how many fixes
    lay out of the area, and how many were kept; the rest was throttled.
    """
    kind = F.col("m.MessageType")
    messages = live.parse(lines, F.col("ingest_ts")).observe("messages", F.count_if(kind == live.TYPES[0]).alias("positions"), F.count_if(kind == live.TYPES[1]).alias("static"))
    fixes = live.positions(messages).drop("ingest_ts")
    inside = F.lit(True) if area is None else in_box(F.col("lat"), F.col("lon"), area)
    fixes = fixes.observe("fixes", F.count(F.lit(1)).alias("received"), F.count_if(~inside).alias("out_of_area")).where(inside)
    kept = throttle(fixes).observe("kept", F.count(F.lit(1)).alias("fixes"))
    return _started(kept, sink(positions_path), checkpoint, once)


def run_vessels(lines: DataFrame, vessels_path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep the merged vessel table of a stream of live messages."""
    found = live.vessels(live.parse(lines, F.col("ingest_ts"))).drop("ingest_ts")
    return _started(found, vessel_sink(vessels_path), checkpoint, once)


def _started(rows: DataFrame, write, checkpoint: str, once: bool) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{FLUSH_S} seconds")).start()
