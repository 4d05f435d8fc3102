"""JSON-lines sources and sinks for changes and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathmere.operators.changes import CHANGE_SCHEMA

METRIC_SCHEMA = (
    "id string, operation string, started_at timestamp, total_ms double, outcome string, "
    "result_count long, stages map<string,double>, counters map<string,long>"
)


def read_changes(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Typed changes with a fixed schema, as a batch or a stream of files."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(CHANGE_SCHEMA).json(path)


def write_changes(changes: DataFrame, path: str) -> None:
    changes.write.mode("append").json(path)


def read_metrics(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(METRIC_SCHEMA).json(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("append").json(path)
