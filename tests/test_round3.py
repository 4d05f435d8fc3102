"""One test for each finding of round 3 that was right."""

import shutil
from pathlib import Path

from pyspark.sql import functions as F

from pathmere.operators import catalog as K
from pathmere.operators import census
from pathmere.plans import summaries
from pathmere.sources import files


def test_hard_links_are_counted_by_volume(spark):
    rows = [("/a/x", "x", False, 5), ("/b/x", "x", False, 5), ("/b/y", "y", False, 5), ("c:/z", "z", False, 5), ("/b", "b", True, 0)]
    found = census.corpus_profile(spark.createDataFrame(rows, "full_path string, name string, is_directory boolean, file_reference long"))
    got = {r.metric: r.value for r in found.collect()}
    assert got["extra_hard_links"] == 1 and got["extra_hard_link_rate"] == 0.25 and got["nonzero_references"] == 4


def test_one_zero_byte_in_two_pairs_is_no_wide_text(spark):
    rows = [(b"A.\x00A.",), (b"\x00aAbA",), (b"a\x00b\x00",), (b"a\x00b\x00c\x00\xac\x20",), (b"a\x00b\x00\xac\x20\xad\x20",)]
    got = [r[0] for r in spark.createDataFrame(rows, "b binary").select(files.decode_text("b")).collect()]
    assert got == [None, None, "ab", "abc\u20ac", None]


def test_decoded_text_of_short_and_null_texts(spark, tmp_path):
    texts = [(0, None), (1, ""), (2, "A"), (3, "A."), (4, "\u00e9"), (5, "abc")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.encoding): (r.text, r.is_binary) for r in summaries.decoded_text(spark, str(tmp_path)).collect()}
    kinds = ["utf-8", "utf-8-mark", "utf-16-le-mark", "utf-16-be-mark"]
    want = {(i, k): (t, False) for i, t in texts for k in kinds} | {(i, "binary"): (None, True) for i, _ in texts}
    assert got == want


def test_row_counts_of_tables_in_several_files(spark, sf_dir, tmp_path):
    want = {}
    for table in Path(sf_dir).glob("*.parquet"):
        shutil.copy(table, tmp_path / table.name)
        want[table.name] = spark.read.parquet(str(table)).count()
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    (tmp_path / "pages.parquet").unlink()
    pages.repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    (tmp_path / "labels.parquet").unlink()
    spark.read.parquet(f"{sf_dir}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.file: r.row_count for r in summaries.parquet_row_counts(spark, str(tmp_path)).collect()}
    assert got == want | {"labels.parquet": 0}


def _records(spark):
    path = F.concat(F.lit("/d"), F.col("id") % 7, F.lit("/Gr\u00fcn "), F.col("id") % 50, F.lit(".txt"))
    return K.catalog_from(spark.range(300), path, F.lit(False), F.col("id"), F.lit("2024-01-01"), 300 - F.col("id"))


def test_catalog_rows_are_sorted_behind_the_shuffle_only(spark):
    """Before, every task sorted all paths and ancestors of its input split for a partial aggregate."""
    best = K.best_records(_records(spark), 6)
    plan = best._jdf.queryExecution().sparkPlan().toString()
    below = plan[plan.rindex("RepartitionByExpression") if "RepartitionByExpression" in plan else plan.rindex("REPARTITION_BY_NUM"):]
    assert "SortAggregate" not in below and "min_by" not in below
    assert best.rdd.getNumPartitions() == 6
    assert K.parts_for(100 * K.PART_ROWS, spark) == 101
    rows = {r.full_path: (r.structural, r.file_reference) for r in best.collect()}
    folders = {f"/d{k}" for k in range(7)}
    assert {k for k, v in rows.items() if v[0]} == folders
    want = {}
    for i in range(300):
        key = f"/d{i % 7}/Gr\u00fcn {i % 50}.txt"
        want[key] = min(want.get(key, 999), 300 - i)
    assert {k: v[1] for k, v in rows.items() if not v[0]} == want


def test_records_are_stored_as_a_catalog_is(spark, tmp_path):
    records = _records(spark)
    K.write_records(K.best_records(records, 3), f"{tmp_path}/a", 3)
    K.write_catalog(K.build_catalog(records), f"{tmp_path}/b", 3)
    one, other = [spark.read.parquet(f"{tmp_path}/{k}") for k in "ab"]
    assert one.schema == other.schema and sorted(one.collect()) == sorted(other.select(one.columns).collect())
    for file in (tmp_path / "a").glob("has_alias=*/*.parquet"):
        names = [(r.name_lower, r.path_key) for r in spark.read.parquet(str(file)).collect()]
        assert names == sorted(names)
