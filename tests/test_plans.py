"""Plans stay the ones a large cluster needs."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pathmere.operators import filters as flt
from pathmere.operators import search as R
from pathmere.plans import views as V


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "condition, pushed",
    [
        (lambda: flt.kind("files"), "Not(EqualTo(is_directory,true))"),
        (lambda: F.col("ext").isin("pdf"), "EqualTo(ext,pdf)"),
        (lambda: flt.modified_since(F.lit("2023-12-15").cast("timestamp")), "GreaterThanOrEqual(mtime"),
    ],
)
def test_catalog_filters_reach_the_scan(spark, sf_dir, condition, pushed):
    plan = plan_of(V.catalog(spark, sf_dir).where(condition()).select("path_key"))
    assert pushed in plan and "search_text" not in plan and "size_bytes" not in plan


def test_stored_layout_reaches_the_scan(spark, sf_dir):
    catalog = V.stored_catalog(spark, sf_dir)
    assert "StringStartsWith(name_lower,doc-1)" in plan_of(catalog.where(flt.stored_prefix(catalog, "Doc-1")).select("path_key"))
    assert "StringStartsWith(name_lower,doc-1)" in plan_of(R.prefix_lane(catalog, "Doc-1", 5))
    plan = plan_of(catalog.where(flt.stored_alias(catalog)).select("path_key"))
    assert "PartitionFilters: [isnotnull(has_alias" in plan and "has_alias" in plan.split("PartitionFilters")[1][:80]


def test_stored_files_are_in_order(spark, sf_dir):
    rows = V.stored_catalog(spark, sf_dir).select("_metadata.file_path", "_metadata.row_index", "name_lower", "path_key").orderBy("file_path", "row_index").collect()
    pairs = list(zip(rows, rows[1:]))
    assert all(a.file_path != b.file_path or (a.name_lower, a.path_key) <= (b.name_lower, b.path_key) for a, b in pairs)


def test_batch_search_meets_few_pairs(spark, sf_dir):
    """Requests with text meet only rows that hold all their letters."""
    catalog = V.catalog(spark, sf_dir)
    requests = V.requests(spark, sf_dir).where("size(terms) + size(phrases) > 0")
    rows = R.S.with_match_columns(catalog).select(R.letter_mask(R.name_text()).alias("has"))
    plain = F.filter(F.concat("phrases", "terms"), lambda t: ~t.rlike(r"[\\/]"))
    needs = [r[0] for r in requests.where(F.size(plain) > 0).select(R.letter_mask(F.array_join(plain, ""))).collect()]
    masks = [r[0] for r in rows.collect()]
    met = sum((m & n) == n for m in masks for n in needs)
    assert met < 0.2 * len(masks) * len(needs)


def test_single_search_is_a_top_k(spark, sf_dir):
    plan = plan_of(R.search(V.catalog(spark, sf_dir), R.SearchRequest(terms=["bolt"], kind="files")))
    assert "TakeOrderedAndProject" in plan and "EqualTo(is_directory,true)" in plan


def test_batch_search_cuts_each_partition(spark, sf_dir):
    plan = plan_of(R.search_many(V.catalog(spark, sf_dir), V.requests(spark, sf_dir)))
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize(
    "name",
    ["search_batch", "gram_search", "delete_subtrees", "filter_exclusion_table", "rows_within_roots", "top_level_roots",
     "applied_changes", "snapshot_diff", "superseded_queries", "latency_summary", "hard_link_changes"],
)
def test_no_cross_product(spark, sf_dir, name):
    plan = plan_of(entry.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_changes_meet_the_catalog_by_key_only(spark, sf_dir):
    """The catalog is scanned for keys and references; ancestors are not taken without a subtree delete."""
    from pathmere.operators import changes as C

    catalog = V.catalog(spark, sf_dir)
    ops = C.lower_changes(V.changes(spark, sf_dir))
    plan = plan_of(C.touched_rows(catalog, ops))
    assert "Generate" not in plan.split("Scan parquet")[0] and "FullOuter" not in plan
