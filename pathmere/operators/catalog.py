"""Build catalogs of path-like records from any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathmere.functions import paths as P
from pathmere.operators.aliases import with_alias_forms
from pathmere.session import scratch_path

CATALOG_COLUMNS = [
    "full_path", "path_key", "name", "parent_path", "parent_key", "ext", "is_directory",
    "size_bytes", "mtime", "file_reference", "structural", "reading", "initials", "search_text",
]
RECORD_COLUMNS = ["full_path", "is_directory", "size_bytes", "mtime", "file_reference", "structural"]
#: Rows that one task sorts, about.
PART_ROWS = 200_000


def catalog_from(
    df: DataFrame,
    path: Column,
    is_directory: Column,
    size_bytes: Column,
    mtime: Column,
    file_reference: Column | None = None,
) -> DataFrame:
    """Plain records from a table: normal path, kind, size, time, reference."""
    reference = F.lit(0) if file_reference is None else file_reference
    return df.select(
        P.norm_path(path).alias("full_path"),
        is_directory.cast("boolean").alias("is_directory"),
        size_bytes.cast("long").alias("size_bytes"),
        mtime.cast("timestamp").alias("mtime"),
        P.segment_ref(reference.cast("long")).alias("file_reference"),
    )


def with_path_columns(df: DataFrame) -> DataFrame:
    """Derived columns every search and merge reads; stored once at build time."""
    path = F.col("full_path")
    named = df.withColumns(
        {"path_key": P.path_key(path), "name": P.name_of(path), "parent_path": P.parent_path(path)}
    )
    return named.withColumns(
        {"parent_key": F.lower("parent_path"), "ext": P.extension(F.col("name"))}
    )


def missing_ancestors(records: DataFrame) -> DataFrame:
    """Directory prefixes of all paths as structural placeholder rows."""
    prefixes = records.select(F.explode(P.ancestors(F.col("full_path"))).alias("full_path")).distinct()
    return prefixes.select(
        "full_path",
        F.lit(True).alias("is_directory"),
        F.lit(0).cast("long").alias("size_bytes"),
        F.lit("1970-01-01 00:00:00").cast("timestamp").alias("mtime"),
        F.lit(0).cast("long").alias("file_reference"),
    )


def parts_for(rows: int, spark: SparkSession) -> int:
    """Partitions that grow with the rows, so that what one task sorts does not."""
    return max(spark.sparkContext.defaultParallelism, rows // PART_ROWS + 1)


def best_records(records: DataFrame, parts: int | None = None) -> DataFrame:
    """One plain row per path key (lowest reference wins) and placeholders for missing ancestors.

    Ancestors are made distinct where they lie, before the shuffle; records meet them in ``parts``
    partitions by path key (default: by their number), each of which is sorted once.
    """
    kept = records.where("full_path is not null")
    own = kept.withColumn("structural", F.lit(False)).select(*RECORD_COLUMNS)
    above = missing_ancestors(kept).withColumn("structural", F.lit(True)).select(*RECORD_COLUMNS)
    rows = own.unionByName(above).withColumn("path_key", P.path_key(F.col("full_path")))
    parts = parts or parts_for(kept.count(), records.sparkSession)
    return (
        rows.repartition(parts, "path_key")
        .groupBy("path_key")
        .agg(F.min_by(F.struct(*RECORD_COLUMNS), F.struct("structural", "file_reference", "full_path")).alias("r"))
        .select("r.*")
    )


def build_catalog(records: DataFrame, readings: DataFrame | None = None, mode: str = "multilingual", parts: int | None = None) -> DataFrame:
    """Complete catalog: the best records with their derived columns."""
    best = best_records(records, parts)
    return with_alias_forms(with_path_columns(best), readings, mode).select(*CATALOG_COLUMNS)


def write_records(records: DataFrame, path: str, files: int, mode: str = "multilingual") -> None:
    """Store plain records with the layout of ``write_catalog``.

    Alias forms and the keys of the layout are derived once and staged with the plain columns, so that
    the sampling of the ranges reads keys only; path columns are derived in order, while they are written.
    """
    keys = ["has_alias", "name_lower", "path_key"]
    keyed = with_alias_forms(with_path_columns(records), None, mode).select(
        *RECORD_COLUMNS, "reading", "search_text", (F.col("search_text") != "").alias("has_alias"), F.lower("name").alias("name_lower"), "path_key"
    )
    staged = scratch_path(records.sparkSession, "records")
    keyed.write.parquet(staged)
    placed = records.sparkSession.read.schema(keyed.schema).parquet(staged).repartitionByRange(files, *keys).sortWithinPartitions(*keys)
    # without a table of readings the initials are the reading
    out = with_path_columns(placed).withColumn("initials", F.col("reading"))
    out.select(*CATALOG_COLUMNS, "has_alias", "name_lower").write.mode("errorifexists").partitionBy("has_alias").parquet(path)


def write_catalog(df: DataFrame, path: str, files: int | None = None) -> None:
    """Store a catalog laid out for search: alias rows apart, files sorted by name.

    ``files`` is the number of name ranges (default: the shuffle partitions of the session), so
    that scans stay parallel; choose it for files of a few hundred megabytes.
    """
    ranges = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        df.withColumn("has_alias", F.col("search_text") != "")
        .withColumn("name_lower", F.lower("name"))
        .repartitionByRange(ranges, "has_alias", "name_lower", "path_key")
        .sortWithinPartitions("has_alias", "name_lower", "path_key")
        .write.mode("errorifexists")
        .partitionBy("has_alias")
        .parquet(path)
    )


def top_roots(roots: DataFrame) -> DataFrame:
    """Distinct roots that are not below another root (the shortest one is kept)."""
    distinct = (
        roots.select(P.norm_path(F.col("path")).alias("path"))
        .where("path is not null")
        .groupBy(P.path_key(F.col("path")).alias("root_key"))
        .agg(F.min("path").alias("path"))
    )
    above = distinct.select("root_key", F.explode(P.ancestors(F.col("root_key"))).alias("above"))
    nested = above.join(
        distinct.select(F.col("root_key").alias("above")), "above", "left_semi"
    ).select("root_key").distinct()
    return distinct.join(nested, "root_key", "left_anti")


def within_roots(df: DataFrame, roots: DataFrame, path_col: str = "full_path") -> DataFrame:
    """Rows equal to or below one of the roots; an equi-join on ancestors, no prefix join."""
    key = F.lower(F.col(path_col))
    keys = df.select(F.col(path_col).alias("_path"), F.explode(P.self_and_ancestors(key)).alias("root_key"))
    kept = keys.join(top_roots(roots).select("root_key"), "root_key", "left_semi").select("_path").distinct()
    return df.join(kept, df[path_col] == kept["_path"], "left_semi")
