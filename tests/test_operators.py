import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pathmere.operators import catalog as K
from pathmere.operators import filters as flt
from pathmere.operators import hierarchy as H
from pathmere.operators import items, metrics
from pathmere.operators import reconcile as M
from pathmere.operators import search as R

AT = datetime(2024, 1, 1)


def make_catalog(spark, *paths, readings=None):
    """Paths ending in '/' are folders."""
    rows = [(p, p.endswith("/"), 1, AT, i + 1) for i, p in enumerate(paths)]
    df = spark.createDataFrame(rows, "p string, d boolean, s long, t timestamp, r long")
    records = K.catalog_from(df, F.col("p"), F.col("d"), F.col("s"), F.col("t"), F.col("r"))
    return K.build_catalog(records, readings)


def names(df):
    return [r.name for r in df.orderBy("rank").collect()]


def test_exact_prefix_substring_order(spark):
    cat = make_catalog(spark, "/d/OldInvoice.txt", "/d/InvoiceArchive.txt", "/d/Invoice/", "/x/Invoices.old/unrelated.txt")
    got = names(R.search(cat, R.SearchRequest(terms=["invoice"], kind="any")))
    assert got == ["Invoice", "Invoices.old", "InvoiceArchive.txt", "OldInvoice.txt"]


def test_plain_term_ignores_ancestors(spark):
    cat = make_catalog(spark, "/project/readme.md", "/project/src/main.c")
    assert names(R.search(cat, R.SearchRequest(terms=["project"], kind="files"))) == []
    assert names(R.search(cat, R.SearchRequest(terms=["project/src"], kind="files"))) == ["main.c"]


def test_usage_pins_and_applications_break_ties(spark):
    cat = make_catalog(spark, "/a/tool.txt", "/b/tool.txt", "/c/tool.txt", "/d/tool.lnk")
    usage = spark.createDataFrame(
        [("/b/tool.txt", 3, AT), ("/c/tool.txt", 3, datetime(2024, 1, 20))], "path_key string, open_count long, last_used_at timestamp"
    )
    as_of = F.lit(datetime(2024, 2, 1))
    found = R.search(cat, R.SearchRequest(terms=["tool"]), usage, None, as_of).orderBy("rank").collect()
    assert [r.full_path for r in found] == ["/d/tool.lnk", "/c/tool.txt", "/b/tool.txt", "/a/tool.txt"]
    assert [round(r.recency, 3) for r in found] == [0.0, 8.0, 0.0, 0.0]


def test_pins_apply_to_folders_with_text_and_to_all_without(spark):
    cat = make_catalog(spark, "/a/one/", "/b/one/", "/b/one.txt")
    pins = spark.createDataFrame([("/b/one/",), ("/b/one.txt",)], "path string")
    with_text = R.search(cat, R.SearchRequest(terms=["one"]), None, pins).collect()
    assert {r.full_path: r.is_pinned for r in with_text} == {"/a/one": False, "/b/one": True, "/b/one.txt": False}
    without = R.search(cat, R.SearchRequest(kind="files"), None, pins).collect()
    assert [r.is_pinned for r in without] == [True]


def test_preferred_root_comes_first(spark):
    cat = make_catalog(spark, "/z/note.txt", "/a/my-note.txt")
    assert names(R.search(cat, R.SearchRequest(terms=["note"], preferred_root="/A"))) == ["my-note.txt", "note.txt"]


def test_han_names_through_reading_table(spark):
    readings = spark.createDataFrame([("星", "XING"), ("空", "KONG"), ("合", "HE"), ("同", "TONG")], "char string, reading string")
    cat = make_catalog(spark, "/d/星空.jpg", "/d/合同.docx", "/d/whitelist.txt", "/d/звезда.txt", readings=readings)
    assert names(R.search(cat, R.SearchRequest(terms=["xk"], kind="files"))) == ["星空.jpg"]
    assert names(R.search(cat, R.SearchRequest(terms=["xingkong"], kind="files"))) == ["星空.jpg"]
    assert names(R.search(cat, R.SearchRequest(terms=["zvezda"], kind="files"))) == ["звезда.txt"]
    # initials beat a name that only holds the letters somewhere
    assert names(R.search(cat, R.SearchRequest(terms=["ht"], kind="files")))[0] == "合同.docx"
    stored = {r.name: r.search_text for r in cat.where("not is_directory").collect()}
    assert stored["星空.jpg"] == "xingkong.jpg xk.jpg" and stored["whitelist.txt"] == ""


def test_limit_rules():
    assert R.SearchRequest(terms=["x"], limit=9999).limit == 9999
    with pytest.raises(ValueError):
        R.SearchRequest(terms=["x"], limit=0)


def test_batch_search_equals_single_search(spark):
    paths = [f"/data/{a}{b}/{c}-{i}.{e}" for i, (a, b, c, e) in enumerate(
        (a, b, c, e) for a in ("red", "blue") for b in ("Box", "_bin") for c in ("part", "pärt", "a%20b", "C%3A%5Cpart") for e in ("txt", "tar.gz")
    )]
    cat = make_catalog(spark, *paths).cache()
    requests = {
        1: R.SearchRequest(terms=["part"]), 2: R.SearchRequest(terms=["pt"]), 3: R.SearchRequest(terms=["redbox/part"]),
        4: R.SearchRequest(include_ext=["tar.gz"], limit=5), 5: R.SearchRequest(phrases=["part-1"], exclude_ext=["gz"]),
        6: R.SearchRequest(terms=["a b-4.txt"]), 7: R.SearchRequest(path_terms=["blue_bin"]), 8: R.SearchRequest(terms=["part", "txt"], excluded_terms=["red"]),
    }
    batch = R.search_many(cat, R.request_table(spark, requests)).collect()
    for qid, request in requests.items():
        want = [(r.rank, r.path_key, r.score, r.match_reason) for r in R.search(cat, request).orderBy("rank").collect()]
        got = sorted((r.rank, r.path_key, r.score, r.match_reason) for r in batch if r.query_id == qid)
        assert got == want, qid
    assert all(R.search(cat, r).limit(1).count() for r in requests.values())


def test_pure_filter_requests_are_keyed_once(spark):
    cat = make_catalog(spark, "/a/x.txt", "/a/.txt", "/a/d.txt/", "/a/b.tar.gz", "/a/c.md", "/a/run.lnk", "/a/e/")
    requests = {
        1: R.SearchRequest(include_ext=["txt", "tar.gz", "gz"]), 2: R.SearchRequest(required_ext=["md", "txt"]), 3: R.SearchRequest(kind="folders"),
        4: R.SearchRequest(apps_only=True), 5: R.SearchRequest(kind="files", exclude_ext=["md"]), 6: R.SearchRequest(),
    }
    keys = R.request_join_key(R.request_table(spark, requests)).groupBy("query_id").agg(F.sort_array(F.collect_list("_key_char")).alias("k"))
    assert {r.query_id: r.k for r in keys.collect()} == {1: ["x:gz", "x:txt"], 2: ["x:md", "x:txt"], 3: ["k:folders"], 4: ["app"], 5: ["k:files"], 6: ["*"]}
    batch = R.search_many(cat, R.request_table(spark, requests)).collect()
    for i, request in requests.items():
        want = [(r.rank, r.path_key) for r in R.search(cat, request).orderBy("rank").collect()]
        assert want and sorted((r.rank, r.path_key) for r in batch if r.query_id == i) == want


def test_usage_meets_only_contenders(spark):
    """Many ties in the fixed keys over several partitions: the cut before usage changes nothing."""
    rng = random.Random(5)
    paths = [f"/r/{'ab'[i % 2]}{i}/tool{rng.choice(['', '', 's', '-x'])}{i % 3}.txt" for i in range(400)]
    cat = make_catalog(spark, *paths).repartition(7)
    usage = spark.createDataFrame([(p.lower(), rng.randrange(4), datetime(2024, 1, 1 + rng.randrange(25))) for p in rng.sample(paths, 150)], "path_key string, open_count int, last_used_at timestamp")
    as_of = F.lit(datetime(2024, 2, 1))
    request = R.SearchRequest(terms=["tool"], limit=9)
    found = R.search(cat, request, usage, None, as_of)
    whole = R.with_tie_breakers(R.matches(cat, request), F.lit(True), F.lit(None).cast("string"), usage, None, as_of)
    want = [r.path_key for r in whole.orderBy(*R.rank_order()).limit(9).collect()]
    assert [r.path_key for r in found.orderBy("rank").collect()] == want
    many = R.search_many(cat, R.request_table(spark, {1: request, 2: R.SearchRequest(terms=["tools"], limit=4)}), usage, None, as_of)
    assert [r.path_key for r in many.where("query_id = 1").orderBy("rank").collect()] == want
    for result in (found, many):
        plan = result._jdf.queryExecution().sparkPlan().toString().splitlines()
        at = lambda mark: [i for i, line in enumerate(plan) if mark in line]
        assert max(at("WindowGroupLimit")) > max(i for i in at("Join") if "path_key" in plan[i])


def test_placeholders_and_duplicates(spark):
    cat = make_catalog(spark, "/a/b/c.txt", "/A/B/C.TXT", "/a/b/").collect()
    rows = {r.path_key: (r.full_path, r.file_reference, r.structural, r.is_directory) for r in cat}
    assert rows == {
        "/a/b/c.txt": ("/a/b/c.txt", 1, False, False), "/a/b": ("/a/b", 3, False, True), "/a": ("/A", 0, True, True),
    }


def test_exclusion_table_equals_list(spark):
    values = ["*.mp4", "Building", "/docs/de", "*.tar.gz", "C:\\Temp"]
    paths = ["/x/a.mp4", "/x/a.tar.gz", "/x/tar.gz", "/building/x", "/x/building.txt", "/docs/de", "/docs/de/x", "/docs/dex", "c:/temp/x", "c:/temper"]
    df = spark.createDataFrame([(p,) for p in paths], "full_path string")
    rules = spark.createDataFrame([(v,) for v in values], "value string")
    by_table = sorted(r.full_path for r in flt.drop_excluded(df, rules).collect())
    by_list = sorted(r.full_path for r in df.where(flt.not_excluded(values)).collect())
    assert by_table == by_list == ["/docs/dex", "/x/building.txt", "/x/tar.gz", "c:/temper"]


# --- hierarchy --------------------------------------------------------------------------

def entries(spark, *rows):
    return spark.createDataFrame(rows, "id long, parent_id long, name string, is_directory boolean")


def test_resolve_out_of_order_cycles_and_orphans(spark):
    df = entries(
        spark, (30, 20, "c.txt", False), (20, 10, "b", True), (10, 5, "a", True), (5, 5, ".", True),
        (41, 42, "x", True), (42, 41, "y", True), (43, 41, "z.txt", False), (50, 99, "lost", True), (60, 10, " ", True), (61, 60, "under-blank", True),
    )
    got = {r.id: r.full_path for r in H.resolve_paths(df).collect()}
    assert got == {5: "", 10: "/a", 20: "/a/b", 30: "/a/b/c.txt"}


def test_resolve_known_root_and_sequence_bits(spark):
    high = 3 << 48
    df = entries(spark, (10 + high, 5 + high, "a", True), (11, 10, "f", False), (12, 5, "top.txt", False))
    got = {r.id: r.full_path for r in H.resolve_paths(df, root_id=5, root_path="C:").collect()}
    assert got == {10: "C:/a", 11: "C:/a/f", 12: "C:/top.txt"}


def test_resolve_deep_chain(spark):
    df = entries(spark, *[(i, max(i - 1, 0), f"d{i}", True) for i in range(200)])
    got = {r.id: r.full_path.count("/") for r in H.resolve_paths(df).collect()}
    assert got == {i: i for i in range(200)}


def test_strict_mode(spark):
    with pytest.raises(ValueError, match="unresolved"):
        H.resolve_paths(entries(spark, (1, 1, "r", True), (2, 9, "lost", False)), strict=True)
    ok = H.resolve_paths(entries(spark, (1, 1, "r", True), (2, 9, "$Meta", False)), strict=True)
    assert ok.count() == 1


def test_link_names(spark):
    rows = [
        (1, [(5, "long.txt", "win32"), (5, "LONG~1.TXT", "dos"), (5, "posix", "posix")], []),
        (2, [(5, "only-posix", "posix"), (5, "S~1", "dos")], [3, 2]),
        (3, [(6, "from-extension", "win32_and_dos")], []),
    ]
    df = spark.createDataFrame(rows, "ref long, names array<struct<parent:long,name:string,namespace:string>>, ext_refs array<long>")
    got = sorted((r.ref, r.name) for r in H.indexable_names(H.collect_names(df)).collect())
    assert got == [(1, "long.txt"), (2, "from-extension"), (3, "from-extension")]


# --- merges -----------------------------------------------------------------------------

def stored(spark, *rows):
    full = [(p, p, False, s, AT, r, g) for p, s, r, g in rows]
    return spark.createDataFrame(
        full, "path_key string, full_path string, is_directory boolean, size_bytes long, mtime timestamp, file_reference long, generation long"
    )


def test_upsert_merge_rules(spark):
    old = stored(spark, ("/a", 1, 7, 3), ("/b", 1, 7, 3), ("/c", 1, 7, 3), ("/d", 1, 7, 3))
    new = stored(spark, ("/a", 1, 0, 9), ("/b", 2, 0, 0), ("/c", 1, 8, 9), ("/e", 1, 0, 9))
    got = {r.path_key: (r.merge_action, r.size_bytes, r.file_reference, r.generation) for r in M.upsert_merge(old, new).collect()}
    assert got == {
        "/a": ("unchanged", 1, 7, 3), "/b": ("updated", 2, 7, 3), "/c": ("updated", 1, 8, 9),
        "/d": ("kept", 1, 7, 3), "/e": ("inserted", 1, 0, 9),
    }


def test_subtree_delete_keeps_sibling_prefix(spark):
    cat = spark.createDataFrame([(p,) for p in ("/a", "/a/b", "/ab", "/a/b/c", "/z")], "path_key string")
    gone = spark.createDataFrame([("/a",), ("/a/b",)], "path_key string")
    assert sorted(r.path_key for r in M.delete_subtrees(cat, gone).collect()) == ["/ab", "/z"]


def test_root_replacement_rejects_outside_rows(spark):
    old = stored(spark, ("/r/a", 1, 0, 1), ("/s/a", 1, 0, 1))
    swapped = M.replace_root(old, "/r", stored(spark, ("/r/b", 1, 0, 2)))
    assert sorted(r.path_key for r in swapped.collect()) == ["/r/b", "/s/a"]
    for merge in (M.replace_root, M.merge_root):
        with pytest.raises(Exception, match="outside the root"):
            merge(old, "/r", stored(spark, ("/rx/b", 1, 0, 2))).collect()


# --- summaries --------------------------------------------------------------------------

def test_exact_percentiles_on_large_group(spark):
    """Above the small-group limit the approximate bracket is used; results stay exact."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise((F.col("id") * 7919 % 30_011) / 7.0).alias("v"), F.lit("g").alias("g")
    )
    ranks = {"p50": metrics.nearest_rank(0.5), "p95": metrics.nearest_rank(0.95), "p01": metrics.nearest_rank(0.01)}
    got = metrics.values_at_ranks(df, ["g"], "v", ranks, few=10_000).first()
    values = sorted(r.v for r in df.collect())
    at = lambda p: values[-(-int(p * 100) * len(values) // 100) - 1]
    assert (got.n, got.p50, got.p95, got.p01) == (30_000, at(0.5), at(0.95), at(0.01))


def test_three_medians(spark):
    df = spark.createDataFrame([("g", float(v)) for v in (1, 2, 10, 20)], "g string, value double")
    assert metrics.upper_median(df, ["g"], "value").first().median == 10.0
    assert metrics.middle_two_median(df, ["g"], "value").first().median == 6.0
    assert metrics.values_at_ranks(df, ["g"], "value", {"m": metrics.nearest_rank(0.5)}).first().m == 2.0


def test_candidates(spark):
    rows = [(0, "/A/", "x", False), (1, "/b", "y", False), (2, "/a", "y", True), (3, "/a", "z", True), (4, "rel", "x", True)]
    df = spark.createDataFrame(rows, "seq int, folder_path string, source string, is_foreground boolean")
    merged = items.merge_candidates(df)
    assert [(r.path_key, r.seq, r.source) for r in items.order_candidates(merged).collect()] == [("/a", 0, "y"), ("/b", 1, "y")]
    calm = merged.withColumn("is_foreground", F.lit(False)).withColumn("source", F.when(F.col("seq") == 1, "y").otherwise("x"))
    assert [r.path_key for r in items.order_candidates(calm, "y").collect()] == ["/b", "/a"]


def test_ranks_are_proved_in_skewed_groups(spark):
    """Order statistics of groups of all sizes, with ties, one value in most rows, and a null key."""
    from pathmere.operators import metrics as M

    rng = random.Random(7)
    rows = [("big", float(rng.choice([1, 1, 1, 1, rng.random() * 100]))) for _ in range(6000)] + [("two", 5.0), ("two", 1.0), (None, 3.0), ("ties", 2.0)]
    rows += [(f"g{i}", float(rng.randrange(9))) for i in range(20) for _ in range(rng.randrange(1, 9))]
    got = {r.k: r for r in M.values_at_ranks(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"p95": M.nearest_rank(0.95), "p10": M.nearest_rank(0.1)}).collect()}
    for key in {k for k, _ in rows}:
        values = sorted(v for k, v in rows if k == key)
        at = lambda f: values[max(-(-int(f * 1000) * len(values) // 1000), 1) - 1]  # noqa: B023, E731
        assert (got[key].n, got[key].p95, got[key].p10) == (len(values), at(0.95), at(0.1)), key


@pytest.mark.parametrize("few, cells", [(1, 16), (50, 32)])
def test_ranks_by_many_rounds(spark, few, cells):
    """Small histograms force many rounds; ties, heavy tails, integers beyond 53 bits, empty groups."""
    rng = random.Random(few)
    rows = [("tail", 10.0 ** rng.randrange(-300, 300)) for _ in range(400)] + [("ties", float(rng.choice([1, 1, 1, 2, 2, 3]))) for _ in range(300)]
    rows += [("even", float(i)) for i in range(500)] + [("nan", rng.choice([float("nan"), 1.0, 2.0])) for _ in range(60)] + [("none", None), ("one", -1.0)]
    ranks = {f"p{k}": metrics.nearest_rank(k / 100) for k in (1, 50, 99)}
    got = {r.k: r for r in metrics.values_at_ranks(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", ranks, few, cells).collect()}
    assert set(got) == {"tail", "ties", "even", "nan", "one"}
    for key, row in got.items():
        values = sorted((v for k, v in rows if k == key), key=lambda v: (v != v, v))
        assert [repr(row[f"p{k}"]) for k in (1, 50, 99)] == [repr(values[max(-(-k * len(values) // 100), 1) - 1]) for k in (1, 50, 99)], key
    large = spark.range(200).select(F.lit("g").alias("k"), (F.col("id") * 3 + 2**61).alias("v"))
    assert metrics.values_at_ranks(large, ["k"], "v", {"m": metrics.nearest_rank(0.5)}, few, cells).first().m == 2**61 + 99 * 3


@pytest.mark.parametrize("n", [5_000, 100_000])
def test_brackets_end_small(spark, n):
    """What meets in the window of a rank does not grow with the group."""
    rows = spark.range(n).select(F.lit("g").alias("k"), F.hash("id").alias("_v"))
    ranks = {"p50": metrics.nearest_rank(0.5), "p95": metrics.nearest_rank(0.95)}
    state = metrics.rank_brackets(rows, ["k"], ranks, few=100, cells=32).first()
    values = sorted(r._v for r in rows.collect())
    for name, share in (("p50", 50), ("p95", 95)):
        bracket = state[name]
        assert bracket.inside <= 100 and not bracket.stuck
        assert bracket.lo <= values[-(-share * n // 100) - 1] <= bracket.hi
