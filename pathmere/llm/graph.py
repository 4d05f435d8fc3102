"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathmere.session import scratch_path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: the plan ends here and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)``, component = least node reachable.

    Each step replaces edges by edges to the least neighbour, which never grows their number:
    the minimum is a map-side aggregate, so a hub with a third of all edges costs one partial row
    per task before its join, and adaptive execution splits that join. Edges with a null or with
    equal ends are ignored; an empty table gives an empty result.
    """
    spark: SparkSession = edges.sparkSession
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = stored(now, "edges"), None
    for _ in range(rounds):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if not state["n"] or state == before:
            break
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        now = stored(small, "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    del spark
    member = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return member.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
