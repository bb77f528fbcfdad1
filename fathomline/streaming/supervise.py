"""Counters of streams that outlive their queries, and restarts with back-off."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

COUNTED = "query string, batch long, ts string, counts map<string, long>"


class Counters(StreamingQueryListener):
    """Appends what each micro-batch observed to a table: a row a query and batch.

    A query keeps its id over restarts, and a batch that is run again keeps its number,
    so ``counted`` takes one row of each and nothing counts twice.  Batches without
    observed rows are not written.
    """

    def __init__(self, spark: SparkSession, path: str):
        super().__init__()
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        counts = {f"{name}.{k}": int(v) for name, row in p.observedMetrics.items() for k, v in row.asDict().items() if v}
        if counts:
            self.spark.createDataFrame([(str(p.id), p.batchId, p.timestamp, counts)], COUNTED).coalesce(1).write.mode("append").json(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def counted(spark: SparkSession, path: str) -> DataFrame:
    """query, name and total of each counter over all batches."""
    rows = spark.read.schema(COUNTED).json(path)
    once = rows.groupBy("query", "batch").agg(F.max_by("counts", "ts").alias("counts"))
    return once.select("query", F.explode("counts").alias("name", "n")).groupBy("query", "name").agg(F.sum("n").alias("total"))


def supervised(start: Callable[[], StreamingQuery], first_wait: float = 1.0, most_wait: float = 60.0, most_restarts: int | None = None) -> list[str]:
    """Keep a query running: after a failure it starts again from its checkpoint, later each time in a row.

    A start that brings a batch to its end sets the wait back.  Returns the causes of the
    restarts when the query ends by itself; raises after ``most_restarts`` in a row.
    """
    causes, row = [], 0
    while True:
        query = start()
        try:
            query.awaitTermination()
            return causes
        except StreamingQueryException as e:
            row = 0 if query.lastProgress else row
            causes.append(str(e).splitlines()[0])
            if most_restarts is not None and row >= most_restarts:
                raise
            time.sleep(min(most_wait, first_wait * 2**row))
            row += 1
