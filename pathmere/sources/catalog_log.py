"""A catalog as a log: base files by buckets of the path key, appended deltas, and one manifest row for each commit.

Layout below one folder: ``base/run=…/bucket=…`` holds rows (sorted by name, alias rows apart, where the
catalog has these columns), ``delta/version=…`` what one batch changed, ``manifest`` an append-only table
that names the live files of each version. A batch writes its own delta only; readers merge the newest
row of each path over the base; ``compact`` rewrites the buckets that deltas touch and no other. The
position in the change feed is part of the manifest row, so data and position commit together. One writer.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathmere.operators.changes import changed_rows, with_delta

BUCKETS = 64
CHECKPOINT = "struct<journal_id:bigint,position:bigint,rules_version:bigint>"
MANIFEST = (
    "version long, base array<struct<bucket:int,path:string>>, deltas array<struct<path:string,buckets:array<int>>>, "
    f"buckets int, schema string, checkpoint {CHECKPOINT}, stale boolean"
)
#: Columns that a search catalog is laid out by.
LAYOUT = [("name_lower", "string"), ("has_alias", "boolean")]


class StaleCatalog(RuntimeError):
    """The catalog waits for a full generation; changes cannot be applied to it."""


def bucket_of(buckets: int, key: Column | None = None) -> Column:
    return F.pmod(F.xxhash64(F.col("path_key") if key is None else key), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, folder: str) -> Row | None:
    """The newest commit, or None."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").orderBy(F.desc("version")).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _current(spark: SparkSession, folder: str) -> Row:
    found = manifest(spark, folder)
    if found is None:
        raise FileNotFoundError(f"publish a full catalog below {folder} first")
    return found


def _commit(spark: SparkSession, folder: str, **fields) -> None:
    names = [f.name for f in T._parse_datatype_string(MANIFEST).fields]
    row = spark.createDataFrame([tuple(fields[n] for n in names)], MANIFEST)
    row.coalesce(1).write.mode("append").parquet(f"{folder}/manifest")


def _point(journal_id: int, position: int, rules_version: int) -> tuple[int, int, int]:
    return (journal_id, position, rules_version)


def _laid_out(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"name_lower": F.lower("name"), "has_alias": F.col("search_text") != ""}) if "search_text" in rows.columns else rows


def _write_base(rows: DataFrame, folder: str, buckets: int) -> list[tuple[int, str]]:
    """Write rows by bucket; where they lie, for each bucket that has any."""
    path = f"{folder}/base/run={uuid.uuid4().hex}"
    wide = "search_text" in rows.columns
    order = ["bucket", "has_alias", "name_lower", "path_key"] if wide else ["bucket", "path_key"]
    placed = _laid_out(rows).withColumn("bucket", bucket_of(buckets))
    placed.repartition("bucket").sortWithinPartitions(*order).write.partitionBy(*(["bucket", "has_alias"] if wide else ["bucket"])).parquet(path)
    try:
        found = rows.sparkSession.read.parquet(path).select("bucket").distinct().collect()  # at most one row for each bucket
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        found = []
    return sorted((r["bucket"], f"{path}/bucket={r['bucket']}") for r in found)


def publish(rows: DataFrame, folder: str, journal_id: int = 0, position: int = -1, rules_version: int = 0, buckets: int = BUCKETS) -> None:
    """A full generation: the base of the log, with the position in the feed it stands for."""
    spark = rows.sparkSession
    before = manifest(spark, folder)
    base = _write_base(rows, folder, buckets)
    _commit(spark, folder, version=before.version + 1 if before else 1, base=base, deltas=[], buckets=buckets, schema=rows.schema.json(),
            checkpoint=_point(journal_id, position, rules_version), stale=False)


def _base(spark: SparkSession, folder: str, head: Row, only: set[int] | None) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(head.schema))
    wide = "search_text" in schema.names
    for name, kind in LAYOUT if wide else []:
        schema = schema.add(name, kind)
    paths = [b.path for b in head.base if only is None or b.bucket in only]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{folder}/base").parquet(*paths).select(*schema.names)


def newest_rows(spark: SparkSession, folder: str, head: Row, only: set[int] | None = None) -> DataFrame | None:
    """The last row of each path in the deltas, with ``removed``; None without deltas."""
    schema = T.StructType.fromJson(json.loads(head.schema)).add("removed", "boolean").add("version", "long").add("bucket", "integer")
    paths = [f"{d.path}/bucket={b}" for d in head.deltas for b in d.buckets if only is None or b in only]
    if not paths:
        return None
    rows = spark.read.schema(schema).option("basePath", f"{folder}/delta").parquet(*paths)
    fields = [c for c in schema.names if c not in ("path_key", "version", "bucket")]
    last = rows.groupBy("path_key").agg(F.max_by(F.struct(*fields), "version").alias("r")).select("path_key", "r.*")
    return last.select(*[c for c in schema.names if c not in ("version", "bucket")])


def read(spark: SparkSession, folder: str, only: Iterable[int] | None = None, layout: bool = False, head: Row | None = None) -> DataFrame:
    """The catalog as of the newest commit, or some buckets of it.

    With ``layout`` the columns that files are laid out by are kept, so that filters on them reach the scan.
    """
    head = head or _current(spark, folder)
    some = None if only is None else set(only)
    rows, last = _base(spark, folder, head, some), newest_rows(spark, folder, head, some)
    merged = rows if last is None else with_delta(rows, _laid_out(last).select(*rows.columns, "removed"))
    return merged if layout else merged.drop(*(n for n, _ in LAYOUT))


def apply(ops: DataFrame, folder: str, generation: int = 0, journal_id: int | None = None, position: int | None = None) -> None:
    """Append what a batch of operations changes as one delta, and commit it with the position reached.

    A batch that names paths only reads the buckets of these; references and subtrees are looked up in
    all buckets, by two columns.
    """
    spark = ops.sparkSession
    head = _current(spark, folder)
    if head.stale:
        raise StaleCatalog(folder)
    wider = ops.where("op = 'purge' or subtree").limit(1).count() > 0
    near = None if wider else {r["b"] for r in ops.select(bucket_of(head.buckets).alias("b")).distinct().collect()}
    version, point = head.version + 1, head.checkpoint
    path = f"{folder}/delta/version={version}"
    delta = changed_rows(read(spark, folder, near, head=head), ops, generation).withColumn("bucket", bucket_of(head.buckets))
    delta.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    try:
        touched = sorted(r["bucket"] for r in spark.read.parquet(path).select("bucket").distinct().collect())
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":  # nothing was written: the batch changes nothing
            raise
        touched = []
    deltas = [(d.path, list(d.buckets)) for d in head.deltas] + ([(path, touched)] if touched else [])
    _commit(spark, folder, version=version, base=list(head.base), deltas=deltas, buckets=head.buckets, schema=head.schema, stale=False,
            checkpoint=_point(point.journal_id if journal_id is None else journal_id, point.position if position is None else position, point.rules_version))


def mark_stale(spark: SparkSession, folder: str) -> None:
    """Changes are refused from now on until a full generation is published."""
    head = _current(spark, folder)
    _commit(spark, folder, **(head.asDict() | {"version": head.version + 1, "stale": True}))


def compact(spark: SparkSession, folder: str, at_least: int = 1) -> set[int]:
    """Merge the buckets that at least so many deltas touch into new base files; the others stay as they are."""
    head = _current(spark, folder)
    counts: dict[int, int] = {}
    for d in head.deltas:
        for b in d.buckets:
            counts[b] = counts.get(b, 0) + 1
    due = {b for b, n in counts.items() if n >= at_least}
    if due:
        merged = read(spark, folder, due, head=head)
        written = dict(_write_base(merged, folder, head.buckets))
        base = sorted([(b.bucket, b.path) for b in head.base if b.bucket not in due] + list(written.items()))
        left = [(d.path, [b for b in d.buckets if b not in due]) for d in head.deltas]
        _commit(spark, folder, **(head.asDict() | {"version": head.version + 1, "base": base, "deltas": [d for d in left if d[1]]}))
    return due


def checkpoints(spark: SparkSession, folder: str, root: str) -> DataFrame:
    """The position of the catalog as a checkpoint row of ``catch_up_plan``; none while it is stale."""
    head = manifest(spark, folder)
    rows = [(root, head.checkpoint.journal_id, head.checkpoint.position + 1, head.checkpoint.rules_version)] if head and not head.stale else []
    return spark.createDataFrame(rows, "root string, journal_id long, next_usn long, rules_version long")


def expire(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Delete files that none of the newest ``keep`` commits names, and return their folders."""
    commits = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").orderBy(F.desc("version")).limit(keep).collect()
    live = {b.path for c in commits for b in c.base} | {f"{d.path}/bucket={b}" for c in commits for d in c.deltas for b in d.buckets}
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for part in ("base", "delta"):
        for status in store.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}/*/bucket=*")) or []:
            path = status.getPath()
            name = f"{folder}/{part}/{path.getParent().getName()}/{path.getName()}"
            if name not in live:
                store.delete(path, True)
                gone.append(name)
    return gone
