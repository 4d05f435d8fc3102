"""Merging, comparing and pruning catalog generations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathmere.functions import paths as P

FIELDS = ("full_path", "is_directory", "size_bytes", "mtime")


def _changed(fields: Sequence[str]) -> Column:
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f"o.{f}").eqNullSafe(F.col(f"i.{f}"))
    new_ref = (F.col("i.file_reference") > 0) & ~F.col("o.file_reference").eqNullSafe(F.col("i.file_reference"))
    return differs | new_ref


def upsert_merge(current: DataFrame, incoming: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Merge a batch into the catalog by path key; adds ``merge_action``.

    Unchanged rows keep everything. A changed or new row takes the incoming fields; an incoming
    generation or reference of 0 keeps the stored one. Both sides hold one row per path key.
    """
    if "search_text" in current.columns and "search_text" in incoming.columns:  # another alias mode is a change
        fields = [*fields, *({"search_text"} - {*fields})]
    joined = current.alias("o").join(
        incoming.alias("i"), F.col("o.path_key") == F.col("i.path_key"), "full"
    )
    has_old, has_new = F.col("o.path_key").isNotNull(), F.col("i.path_key").isNotNull()
    action = (
        F.when(~has_old, "inserted").when(~has_new, "kept")
        .when(_changed(fields), "updated").otherwise("unchanged")
    )
    take_new = F.col("merge_action").isin("inserted", "updated")

    def positive(name: str) -> Column:
        new, old = F.col(f"i.{name}"), F.coalesce(F.col(f"o.{name}"), F.lit(0))
        return F.when(take_new & (new > 0), new).otherwise(old).alias(name)

    return joined.withColumn("merge_action", action).select(
        F.coalesce("o.path_key", "i.path_key").alias("path_key"),
        *[F.when(take_new, F.col(f"i.{f}")).otherwise(F.col(f"o.{f}")).alias(f) for f in fields],
        positive("generation"),
        positive("file_reference"),
        "merge_action",
    )


def reconcile_rows(current: DataFrame, scanned: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Class of each scanned row: 'by_reference', 'by_path' (unchanged) or 'upsert'.

    A row with a reference counts as unchanged only when the stored row of the same path has the
    same reference and fields; one without reference is compared by path alone.
    """
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"s.{f}").eqNullSafe(F.col(f"o.{f}"))
    same = F.coalesce(F.col("o.path_key").isNotNull() & same, F.lit(False))
    same_ref = F.coalesce(F.col("o.file_reference") == F.col("s.file_reference"), F.lit(False))
    label = (
        F.when(F.col("s.file_reference") > 0, F.when(same & same_ref, "by_reference").otherwise("upsert"))
        .otherwise(F.when(same, "by_path").otherwise("upsert"))
    )
    joined = scanned.alias("s").join(current.alias("o"), F.col("s.path_key") == F.col("o.path_key"), "left")
    return joined.select("s.*", label.alias("reconcile_class"))


def reconcile_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("reconcile_class").agg(F.count("*").alias("n"))


def touch_and_merge(current: DataFrame, scanned: DataFrame, generation: int) -> DataFrame:
    """One full-scan pass: unchanged rows only get the new generation, the rest is merged."""
    merged = upsert_merge(current, scanned.withColumn("generation", F.lit(generation).cast("long")))
    touched = F.when(F.col("merge_action") == "unchanged", F.lit(generation)).otherwise(F.col("generation"))
    return merged.withColumn("generation", touched.cast("long"))


def topmost(keys: DataFrame) -> DataFrame:
    """Distinct path keys (column ``path_key``) not below another listed key."""
    distinct = keys.select("path_key").distinct()
    above = distinct.select("path_key", F.explode(P.ancestors(F.col("path_key"))).alias("above"))
    nested = above.join(distinct.withColumnRenamed("path_key", "above"), "above", "left_semi")
    return distinct.join(nested.select("path_key").distinct(), "path_key", "left_anti")


def delete_subtrees(catalog: DataFrame, deleted: DataFrame) -> DataFrame:
    """Remove paths (column ``path_key``) with everything below them; equi-joins only."""
    roots = topmost(deleted).withColumnRenamed("path_key", "above")
    lineage = catalog.select("path_key", F.explode(P.self_and_ancestors(F.col("path_key"))).alias("above"))
    hit = lineage.join(roots, "above", "left_semi").select("path_key").distinct()
    return catalog.join(hit, "path_key", "left_anti")


def diff_snapshots(old: DataFrame, new: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Per key: 'added', 'removed', 'changed' or 'unchanged', and one flag per changed field."""
    joined = old.alias("o").join(new.alias("n"), F.col("o.path_key") == F.col("n.path_key"), "full")
    both = F.col("o.path_key").isNotNull() & F.col("n.path_key").isNotNull()
    flags = {f: both & ~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")) for f in fields}
    any_flag = F.lit(False)
    for flag in flags.values():
        any_flag = any_flag | flag
    status = (
        F.when(F.col("o.path_key").isNull(), "added").when(F.col("n.path_key").isNull(), "removed")
        .when(any_flag, "changed").otherwise("unchanged")
    )
    return joined.select(
        F.coalesce("n.path_key", "o.path_key").alias("path_key"),
        status.alias("status"),
        *[flag.alias(f"{f}_changed") for f, flag in flags.items()],
    )


def diff_summary(diff: DataFrame) -> DataFrame:
    """One row of counts over a diff."""
    flags = [c for c in diff.columns if c.endswith("_changed")]
    return diff.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "changed", "unchanged")],
        *[F.count_if(F.col(c)).alias(c) for c in flags],
    )


def diff_samples(diff: DataFrame, n: int) -> DataFrame:
    """First differing keys in key order, for a report."""
    return diff.where("status <> 'unchanged'").orderBy("path_key").limit(n)


def replace_root(catalog: DataFrame, root: str, staged: DataFrame) -> DataFrame:
    """Swap the rows of a root for staged ones; a staged row outside the root is an error."""
    return catalog.where(~P.under_root(F.col("path_key"), F.lit(root))).unionByName(
        _checked(staged, root).select(*catalog.columns)
    )


def merge_root(catalog: DataFrame, root: str, staged: DataFrame) -> DataFrame:
    """Upsert staged rows and delete nothing (used when a scan could not be proved complete)."""
    return upsert_merge(catalog, _checked(staged, root)).drop("merge_action")


def _checked(staged: DataFrame, root: str) -> DataFrame:
    inside = P.under_root(F.col("path_key"), F.lit(root))
    message = F.concat(F.lit("staged row outside the root: "), F.col("path_key"))
    guarded = F.when(inside, F.col("path_key")).otherwise(F.raise_error(message))
    return staged.withColumn("path_key", guarded)


def prune_stale(catalog: DataFrame, root: str, generation: int) -> DataFrame:
    """Drop rows under a root that the current scan did not touch."""
    if generation <= 0:
        raise ValueError("generation must be positive")
    stale = P.under_root(F.col("path_key"), F.lit(root)) & (F.col("generation") != generation)
    return catalog.where(~stale)


def catalog_stats(states: DataFrame) -> DataFrame:
    """Live rows, tombstones and their ratio per volume, from (path_key, is_live)."""
    return (
        states.groupBy(P.volume_of(F.col("path_key")).alias("volume"))
        .agg(F.count_if("is_live").alias("live"), F.count_if(~F.col("is_live")).alias("tombstones"))
        .withColumn("tombstone_ratio", F.col("tombstones") / (F.col("live") + F.col("tombstones")))
    )


def checksum(df: DataFrame, column: str = "size_bytes") -> DataFrame:
    """Order-independent content guard: count, sum, minimum, maximum."""
    return df.agg(
        F.count("*").alias("n"), F.sum(column).alias("total"),
        F.min(column).alias("lowest"), F.max(column).alias("highest"),
    )


def checksums_agree(left: DataFrame, right: DataFrame, column: str = "size_bytes") -> DataFrame:
    """Both checksums side by side with an ``agree`` flag."""
    pick = lambda df, side: checksum(df, column).select(
        F.struct("n", "total", "lowest", "highest").alias("c"), F.lit(side).alias("side")
    )
    sides = pick(left, "left").unionByName(pick(right, "right"))
    agg = sides.agg(
        F.max_by("c", F.col("side") == "left").alias("l"), F.max_by("c", F.col("side") == "right").alias("r")
    )
    return agg.select(
        F.col("l.n").alias("left_n"), F.col("r.n").alias("right_n"),
        F.col("l.total").alias("left_total"), F.col("r.total").alias("right_total"),
        (F.col("l") == F.col("r")).alias("agree"),
    )
