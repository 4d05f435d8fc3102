"""Keyed updates of a stream as a tiered log: small runs are merged by key, readers see live runs only.

Layout below one folder: ``runs/level=L/…`` holds rows with the batch they come from, ``manifest`` one row
for each commit with the live runs. When a level has ``fan_in`` runs they become one run of the next
level that holds the newest row of each key, so a reader meets at most ``fan_in`` runs a level and each
row is rewritten once a level, however long the history.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN_IN = 8
MANIFEST = "version long, runs array<struct<path:string,level:int,last:long>>"


def _head(spark: SparkSession, folder: str):
    try:
        return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").orderBy(F.desc("version")).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def live_runs(spark: SparkSession, folder: str) -> list[tuple[str, int, int]]:
    """Path, level and last batch of the runs that a reader meets."""
    head = _head(spark, folder)
    return [tuple(r) for r in head.runs] if head else []


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    fields = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), "batch_id").alias("r")).select(*keys, "r.*")


def append(batch: DataFrame, folder: str, batch_id: int, keys: list[str], fan_in: int = FAN_IN) -> None:
    """Add the updates of one micro-batch; a batch that was added before changes nothing."""
    spark = batch.sparkSession
    head = _head(spark, folder)
    runs = [tuple(r) for r in head.runs] if head else []
    if runs and batch_id <= max(last for _, _, last in runs):
        return
    path = f"{folder}/runs/level=0/batch={batch_id}"
    batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(path)
    runs.append((path, 0, batch_id))
    level = 0
    while len(due := [r for r in runs if r[1] == level]) >= fan_in:
        merged = f"{folder}/runs/level={level + 1}/batch={batch_id}"
        rows = spark.read.schema(spark.read.parquet(due[0][0]).schema).parquet(*(p for p, _, _ in due))
        _newest(rows, keys).write.mode("overwrite").parquet(merged)
        runs = [r for r in runs if r[1] != level] + [(merged, level + 1, batch_id)]
        level += 1
    row = spark.createDataFrame([(head.version + 1 if head else 1, runs)], MANIFEST)
    row.coalesce(1).write.mode("append").parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Newest row of each key."""
    runs = live_runs(spark, folder)
    if not runs:
        raise FileNotFoundError(f"no updates below {folder}")
    schema = spark.read.parquet(runs[0][0]).schema
    return _newest(spark.read.schema(schema).parquet(*(p for p, _, _ in runs)), keys).drop("batch_id")
