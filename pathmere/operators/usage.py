"""Usage counts per path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathmere.functions.paths import norm_path, path_key


def roll_up(opens: DataFrame) -> DataFrame:
    """Open events (full_path, used_at) to one row per path: count, latest use, latest spelling.

    Events of a table are first counted by the path as it is written, a hash aggregate over fixed-width
    values where the rows lie; only its few rows are brought to normal form and ranked by spelling. A
    stream has one aggregation.
    """
    if opens.isStreaming:
        counted, n = opens.select("full_path", "used_at"), F.count("*")
    else:
        counted = opens.groupBy("full_path").agg(F.count("*").alias("n"), F.max("used_at").alias("used_at"))
        n = F.sum("n")
    path = norm_path(F.col("full_path"))
    return (
        counted.select(path.alias("full_path"), path_key(path).alias("path_key"), *counted.columns[1:])
        .where("full_path is not null")
        .groupBy("path_key")
        .agg(
            F.max_by("full_path", F.struct("used_at", "full_path")).alias("full_path"),
            n.alias("open_count"),
            F.max("used_at").alias("last_used_at"),
        )
    )


def merge_usage(current: DataFrame, imported: DataFrame) -> DataFrame:
    """Merge two usage tables; importing twice changes nothing. Unusable rows are skipped."""
    ok = "full_path is not null and path_key is not null and open_count >= 0 and last_used_at is not null"
    fields = ["path_key", "full_path", "open_count", "last_used_at"]
    both = (
        current.select(*fields).withColumn("_newer", F.lit(0))
        .unionByName(imported.where(ok).select(*fields).withColumn("_newer", F.lit(1)))
    )
    return both.groupBy("path_key").agg(
        F.max_by("full_path", F.struct("_newer", "full_path")).alias("full_path"),
        F.max("open_count").alias("open_count"),
        F.max("last_used_at").alias("last_used_at"),
    )


def best_usage(usage: DataFrame) -> DataFrame:
    """One row per key: the most opened, then the latest used."""
    fields = [c for c in usage.columns if c != "path_key"]
    best = usage.groupBy("path_key").agg(
        F.max_by(F.struct(*fields), F.struct("open_count", "last_used_at", "full_path")).alias("r")
    )
    return best.select("path_key", "r.*")
