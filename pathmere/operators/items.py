"""Lists of named items (such as processes) and folder candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathmere.functions.paths import norm_path, path_key
from pathmere.functions.scoring import item_score


def search_items(items: DataFrame, query: str, limit: int) -> DataFrame:
    """Best items by score, then name; id is the final key."""
    score = item_score(F.col("name"), F.col("details"), F.col("aliases"), F.lit(query))
    return (
        items.withColumn("score", score)
        .where("score is not null")
        .orderBy(F.col("score").desc(), F.lower("name"), F.col("id"))
        .limit(limit)
    )


def collapse_items(items: DataFrame) -> DataFrame:
    """One item per identity, ignoring case; items with an icon first, then input order."""
    identity = F.lower(F.when(F.trim("identity") != "", F.col("identity")).otherwise(F.col("name")))
    no_icon = F.trim(F.coalesce("icon_path", F.lit(""))) == ""
    best = items.groupBy(identity.alias("identity_key")).agg(
        F.min_by(F.struct(*items.columns), F.struct(no_icon, "id")).alias("r"), F.count("*").alias("merged")
    )
    return best.select("identity_key", "r.*", "merged")


def merge_candidates(candidates: DataFrame) -> DataFrame:
    """One row per folder: the first candidate, or the first foreground one; keeps its first place."""
    path = norm_path(F.col("folder_path"))
    rows = candidates.withColumn("folder_path", path).where("folder_path is not null")
    fields = [c for c in rows.columns if c != "seq"]
    best = rows.groupBy(path_key(F.col("folder_path")).alias("path_key")).agg(
        F.min_by(F.struct(*fields), F.struct(~F.col("is_foreground"), "seq")).alias("r"),
        F.min("seq").alias("seq"),
    )
    return best.select("path_key", "seq", "r.*")


def order_candidates(candidates: DataFrame, last_source: str | None = None) -> DataFrame:
    """Foreground rows first; without any, the source last seen in front leads."""
    front = candidates.where("is_foreground").select(F.lit(1).alias("_one")).limit(1).withColumn("_front", F.lit(True))
    flagged = candidates.withColumn("_one", F.lit(1)).join(front, "_one", "left")
    led = F.col("_front").isNull() & F.coalesce(F.col("source") == F.lit(last_source), F.lit(False))
    return flagged.withColumn("leads", led).drop("_one", "_front").orderBy(
        F.col("is_foreground").desc(), F.col("leads").desc(), F.col("seq")
    )


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of the second source only when the first one is empty."""
    any_row = first.select(F.lit(1).alias("_one")).limit(1)
    spare = second.withColumn("_one", F.lit(1)).join(any_row, "_one", "left_anti").drop("_one")
    return first.unionByName(spare.select(*first.columns))
