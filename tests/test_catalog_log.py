"""The catalog log: deltas, merge on read, compaction, layout, retention."""

from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pathmere.operators.catalog import build_catalog
from pathmere.operators.changes import CHANGE_SCHEMA, apply_operations, catch_up_plan, lower_changes
from pathmere.sources import catalog_log

AT = datetime(2024, 1, 1)


def catalog(spark, n):
    rows = spark.range(n).select(
        F.concat(F.lit("/v/d"), F.col("id") % 7, F.lit("/"), F.when(F.col("id") % 3 == 0, "\u00e9t\u00e9 ").otherwise("file "), "id").alias("full_path"),
        F.lit(False).alias("is_directory"), F.col("id").alias("size_bytes"), F.lit(AT).alias("mtime"), (F.col("id") + 1).alias("file_reference"),
    )
    return build_catalog(rows)


def ops(spark, *rows):
    full = [(u, kind, path, old, False, size, AT, ref, None) for u, kind, path, old, size, ref in rows]
    return lower_changes(spark.createDataFrame(full, CHANGE_SCHEMA))


def size(folder):
    return {p: p.stat().st_size for p in Path(folder).rglob("*.parquet")}


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()))


BATCHES = [
    [(1, "upsert", "/v/new a", None, 5, 9001), (2, "delete", "/v/d1/file 1", None, 1, 2)],
    [(3, "rename", "/v/new b", "/v/new a", 6, 9001)],
    [(4, "upsert", "/v/d2/file 2", None, 77, 3), (5, "delete", "/v/d4/file 4", None, 1, 5)],
]


@pytest.mark.parametrize("after", [0, 1, 2])
def test_log_equals_applying_the_batches(spark, tmp_path, after):
    folder, plain = str(tmp_path / "log"), catalog(spark, 60).cache()
    want = plain
    catalog_log.publish(plain, folder, buckets=8)
    for batch in BATCHES:
        catalog_log.apply(ops(spark, *batch), folder)
        want = apply_operations(want, ops(spark, *batch))
        if after:
            catalog_log.compact(spark, folder, after)
    got = catalog_log.read(spark, folder)
    assert got.columns == plain.columns and rows(got) == rows(want)
    head = catalog_log.manifest(spark, folder)
    assert (not head.deltas) == (after == 1)


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    folder = str(tmp_path / "log")
    catalog_log.publish(catalog(spark, 20_000), folder, buckets=16)
    before = size(folder)
    catalog_log.apply(ops(spark, *BATCHES[0]), folder)
    new = {p: n for p, n in size(folder).items() if p not in before}
    assert all(size(folder)[p] == n for p, n in before.items())
    assert sum(new.values()) < 0.1 * sum(before.values()) and all("delta" in str(p) or "manifest" in str(p) for p in new)
    due = catalog_log.compact(spark, folder)
    written = {p for p in size(folder) if p not in before and p not in new and "/base/" in str(p)}
    assert 0 < len(due) < 16 and {int(str(p).split("bucket=")[1].split("/")[0]) for p in written} == due


def test_a_batch_of_paths_reads_their_buckets_only(spark, tmp_path):
    folder = str(tmp_path / "log")
    catalog_log.publish(catalog(spark, 500), folder, buckets=16)
    head = catalog_log.manifest(spark, folder)
    files = catalog_log.read(spark, folder, only=[3]).inputFiles()
    assert files and all("bucket=3/" in f for f in files) and len(head.base) == 16


def test_filters_on_the_layout_reach_the_scan(spark, tmp_path):
    folder = str(tmp_path / "log")
    catalog_log.publish(catalog(spark, 500), folder, buckets=4)
    catalog_log.apply(ops(spark, *BATCHES[0]), folder)
    found = catalog_log.read(spark, folder, layout=True).where(F.col("name_lower").startswith("file 1") & ~F.col("has_alias"))
    plan = found._jdf.queryExecution().toString()
    assert "StartsWith(name_lower,file 1)" in plan and "PartitionFilters: [isnotnull(has_alias" in plan
    assert found.where("name = 'file 1'").count() == 0 and found.where("name = 'file 10'").count() == 1


def test_batch_without_effect_and_empty_catalog(spark, tmp_path):
    folder = str(tmp_path / "log")
    catalog_log.publish(catalog(spark, 10).limit(0), folder, position=4)
    assert catalog_log.read(spark, folder).count() == 0
    catalog_log.apply(ops(spark, (5, "delete", "/v/none", None, 1, 1)), folder, position=5)
    head = catalog_log.manifest(spark, folder)
    assert not head.deltas and head.checkpoint.position == 5
    catalog_log.apply(ops(spark, (6, "upsert", "/v/one", None, 1, 1)), folder, position=6)
    assert [r.path_key for r in catalog_log.read(spark, folder).collect()] == ["/v/one"]


def test_stale_catalog_refuses_and_checkpoints_feed_the_plan(spark, tmp_path):
    folder = str(tmp_path / "log")
    catalog_log.publish(catalog(spark, 10), folder, journal_id=3, position=40, rules_version=2)
    journals = spark.createDataFrame([("/v", 3, 0, 90)], "root string, journal_id long, lowest_valid_usn long, next_usn long")
    plan = lambda version: tuple(catch_up_plan(journals, catalog_log.checkpoints(spark, folder, "/v"), version).first())
    assert plan(2) == ("/v", "read", 41, 90) and plan(3) == ("/v", "rescan", 0, 90)
    catalog_log.mark_stale(spark, folder)
    assert plan(2) == ("/v", "rescan", 0, 90)
    with pytest.raises(catalog_log.StaleCatalog):
        catalog_log.apply(ops(spark, *BATCHES[0]), folder)


def test_expire_deletes_only_what_no_commit_names(spark, tmp_path):
    folder = str(tmp_path / "log")
    catalog_log.publish(catalog(spark, 60), folder, buckets=4)
    for batch in BATCHES:
        catalog_log.apply(ops(spark, *batch), folder)
        catalog_log.compact(spark, folder)
    want = rows(catalog_log.read(spark, folder))
    before = set(size(folder))
    gone = catalog_log.expire(spark, folder, keep=1)
    assert gone and set(size(folder)) < before and rows(catalog_log.read(spark, folder)) == want
    assert catalog_log.expire(spark, folder, keep=1) == []
