"""Writers of results: partitions replaced by key, versions of a table, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.scalars import csv_cell, iso_text

# The columns of the incident export, in their order.
EXPORT = (
    "incident_id", "region", "detected_at", "lat", "lon", "area_km2", "length_km", "width_km", "confidence", "status", "scene_id",
    "candidate_count", "top_vessel", "top_score",
)


def replace_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Write rows so that each key's former rows go (candidates of an incident)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_positions(df: DataFrame, path: str) -> None:
    """Append fixes by day and source, each file sorted as tracks are read."""
    day = F.to_date(F.timestamp_seconds("ts"))
    df.withColumn("day", day).repartition("day", "source").sortWithinPartitions("mmsi", "ts").write.mode("append").partitionBy("day", "source").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def stored_positions(spark: SparkSession, path: str, days: list[object] | None = None) -> DataFrame | None:
    """The fixes stored below ``path``, of some days only if given; None if there are none yet."""
    if not exists(spark, path):
        return None
    rows = spark.read.parquet(path)
    return rows if days is None else rows.where(F.col("day").isin(days))


def drop_old_days(spark: SparkSession, path: str, now: float, days: float) -> list[str]:
    """Delete the folders of live fixes of whole days before the retention's last one; those dropped."""
    stored = stored_positions(spark, path)
    if stored is None:
        return []
    last = F.to_date(F.timestamp_seconds(F.lit(now - days * 86400.0)))
    old = stored.where((F.col("source") == "live") & (F.col("day") < last)).select("day").distinct().collect()  # a row a day
    jvm = spark.sparkContext._jvm
    gone = sorted(f"{path.rstrip('/')}/day={r.day}/source=live" for r in old)
    for folder in gone:
        at = jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return gone


#: Versions of a merged table that stay for readers of older ones.
KEPT_VERSIONS = 3


class Versions:
    """A table kept as numbered folders: a merge writes the next one.

    A version counts when Spark has marked it whole, so readers never see half a
    merge.  One listing finds the last one; versions before the last three go.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _numbers(self) -> list[int]:
        """All numbers in use, the largest first."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(at):
            return []
        names = [s.getPath().getName() for s in files.listStatus(at)]
        return sorted((int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit()), reverse=True)

    def number(self) -> int:
        """The version last completed, 0 if none."""
        return next((n for n in self._numbers() if exists(self.spark, f"{self.path}/v={n}/_SUCCESS")), 0)

    def read(self) -> DataFrame | None:
        n = self.number()
        return self.spark.read.parquet(f"{self.path}/v={n}") if n else None

    def write(self, df: DataFrame) -> int:
        n = self.number() + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v={n}")
        jvm = self.spark.sparkContext._jvm
        for old in self._numbers():
            if old <= n - KEPT_VERSIONS:
                at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={old}")
                at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        return n


def export_csv(incidents: DataFrame, path: str) -> None:
    """Quoted cells, times in ISO form, nothing that a spreadsheet would run."""
    rows = incidents.withColumn("detected_at", iso_text(F.col("detected_at")))
    cells = [(F.coalesce(csv_cell(F.col(c)), F.lit("")) if c in rows.columns else F.lit("")).alias(c) for c in EXPORT]
    rows.select(*cells).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def export_json(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)
