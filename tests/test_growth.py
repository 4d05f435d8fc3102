"""Steps whose work or memory grew faster than the input, or was done in one task."""

import shutil
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from pathmere.functions.paths import is_application
from pathmere.operators import search as R
from pathmere.operators import usage
from pathmere.plans import maintenance as M
from pathmere.sources import gram_index
from pathmere.streaming import jobs


def test_portions_of_a_stream_have_several_files_in_order(spark, monkeypatch):
    """Before, each portion was computed and written by one task, and rows without an order value were left out."""
    monkeypatch.setattr(M, "FILE_ROWS", 2000)
    rows = spark.range(20_000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), "id")
    stream, folder = M._stream(spark, rows, "portions", "k", 2)
    seen = []
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(
        lambda batch, _: seen.append((batch.rdd.getNumPartitions(), *batch.agg(F.count("*"), F.min("id"), F.max("id")).first()))
    ).start()
    query.awaitTermination()
    assert len(seen) == 2 and sum(n for _, n, _, _ in seen) == 20_000 and seen[0][3] < seen[1][2] and seen[0][2] == 0
    assert M._files_each([10_000, 10_001], 2000) == 5 and M._files_each([10**6, 0], 2000) == 1 and M._files_each([10**6, 3000], 2000) == 3


def test_hints_put_off_a_timer_once_it_fires(spark, tmp_path):
    """A path whose later hints come before its first timer fires ends in one action, after the last of them."""
    source, folder = str(tmp_path / "h"), str(tmp_path / "out")
    schema = "seq long, ts timestamp, full_path string, kind string, old_full_path string"
    at = datetime(2024, 1, 1)
    for minutes in ([(0, "/v/a", "created"), (0, "/v/b", "deleted")], [(20, "/v/a", "deleted")], [(45, "/v/c", "changed")], [(200, "/v/end", "changed")]):
        rows = [(m, at + timedelta(minutes=m), p, k, None) for m, p, k in minutes]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    jobs.coalesce_hint_stream(stream, folder, 30 * 60_000, "event", "0 seconds").awaitTermination()
    found = spark.read.schema("full_path string, hints long, action string").parquet(f"{folder}/pending").drop("batch_id").collect()
    assert sorted(map(tuple, found)) == [("/v/a", 2, "delete"), ("/v/b", 1, "delete"), ("/v/c", 1, "refresh")]


def test_usage_is_counted_by_written_path_first(spark):
    """Before, every event was normalised and ranked by spelling in a sort."""
    at = lambda m: datetime(2024, 1, 1, 0, m)
    rows = [("/A/x/", at(1)), ("/a/X", at(3)), ("/a/X", at(2)), ("/a/x", at(3)), (None, at(9)), ("/b", None), ("/b", None), ("rel", at(1)), ("/c", None), ("/C", at(1))]
    found = usage.roll_up(spark.createDataFrame(rows, "full_path string, used_at timestamp"))
    assert sorted(map(tuple, found.select("path_key", "full_path", "open_count", "last_used_at").collect())) == [
        ("/a/x", "/a/x", 4, at(3)), ("/b", "/b", 2, None), ("/c", "/C", 2, at(1)),
    ]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate(keys=[full_path" in plan


def test_gram_index_is_written_without_a_join(spark, tmp_path, monkeypatch):
    """Before, the grams of all names were joined with the names again."""
    names = spark.createDataFrame([("red bolt",), ("bolt",), ("xy",)], "name string")
    monkeypatch.setattr(type(names), "join", lambda *a, **k: (_ for _ in ()).throw(AssertionError("join")))
    gram_index.build_index(names, str(tmp_path / "g"), 2)
    monkeypatch.undo()
    rows = spark.read.parquet(f"{tmp_path}/g/postings")
    assert sorted(r.gram for r in rows.where("name_lower = 'bolt'").collect()) == ["bol", "olt"]
    assert dict(map(tuple, spark.read.parquet(f"{tmp_path}/g/counts").select("gram", "names").collect()))["olt"] == 2


def test_alias_forms_are_computed_once_and_staged(spark, tmp_path):
    """Before, a reading was spelled twice for each row, and once more for the ranges of the layout."""
    from pathmere.functions.alias import latin_reading
    from pathmere.operators import catalog as K

    names = spark.createDataFrame([("Élève",), ("plain",), ("ъъ",), (None,)], "name string")
    read = names.select(latin_reading(F.col("name")).alias("r"))
    assert [r.r for r in read.collect()] == ["eleve", "plain", "ъъ", None]
    assert read._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1
    records = K.catalog_from(names.where("name is not null"), F.concat(F.lit("/d/"), "name"), F.lit(False), F.lit(1), F.lit("2024-01-01"), F.lit(7))
    K.write_records(records.withColumn("structural", F.lit(False)), f"{tmp_path}/c", 2)
    got = {r.name: (r.reading, r.initials, r.search_text, str(r.has_alias).lower()) for r in spark.read.parquet(f"{tmp_path}/c").collect()}
    assert got == {"Élève": ("eleve", "eleve", "eleve", "true"), "plain": ("plain", "plain", "", "false"), "ъъ": ("ъъ", "ъъ", "", "false")}


def test_batch_search_looks_up_many_letters(spark):
    """Letters beyond the bits of a mask and many join keys lose no row; before, every row listed all its letters."""
    from pathmere.operators import catalog as K
    from pathmere.operators import search as R

    marks = [chr(0x4E00 + k) for k in range(90)]
    names = [(f"/d/{m}{marks[k - 1]}x.txt",) for k, m in enumerate(marks)]
    catalog = K.build_catalog(K.catalog_from(spark.createDataFrame(names, "p string"), F.col("p"), F.lit(False), F.lit(1), F.lit("2024-01-01"), F.lit(7)), parts=2)
    requests = R.request_table(spark, {k: R.SearchRequest(terms=[m + marks[k - 1]]) for k, m in enumerate(marks)} | {100: R.SearchRequest(path_terms=["d"], kind="files", limit=99)})
    found = R.search_many(catalog, requests)
    got = {(r.query_id, r.full_path) for r in found.collect()}
    assert got == {(k, n) for k, (n,) in enumerate(names)} | {(100, n) for n, in names}
    text, letters = F.lit("bolt a"), F.array(F.lit("a"), F.lit("b"), F.lit("z"))
    assert spark.range(1).select(R.letter_mask(text, letters)).first()[0] == 0b011


def _lines_folder(spark, sf_dir, folder):
    texts = [
        (0, "en", "Élève a/b\\c\n\n  \nplain line.txt\nplain line.txt\n / \\ \n50% off\t"), (1, "fr", None), (2, "de", ""), (3, None, "gros"),
        (4, "de", "über der Straße\nfür größe\nGROSS eleve\r\nder Uber"), (4, "de", "über der Straße\nfür größe"), (5, "zh", "漢字 fur en"), (None, "en", "fur"),
    ]
    for table in Path(sf_dir).glob("*.parquet"):
        if table.name != "documents.parquet":
            shutil.copy(table, folder / table.name)
    docs = spark.createDataFrame(texts, "doc_id long, lang string, text string")
    docs.withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")}).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_batch_search_of_lines_stores_no_copies_of_them(spark, sf_dir, tmp_path):
    """Before, each line was staged, shuffled and stored in seven columns, then shuffled again for each of its join keys."""
    from pathmere.plans import searching
    from pathmere.plans import views as V

    sf = _lines_folder(spark, sf_dir, tmp_path)
    plan = (found := searching.search_batch_aliases(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [_key_char" in plan and "SortMergeJoin [_key_char" not in plan
    got = sorted((r.query_id, r.rank, r.path_key) for r in found.collect())
    assert not any(key[1:] == (sf, "lines") for key in V._STORED)
    assert sorted(map(str, V.line_rows(spark, sf).collect())) == sorted(map(str, V.line_catalog(spark, sf).collect()))
    with_store = [R.search(V.line_catalog(spark, sf), q, V.usage(spark, sf), V.pinned(spark, sf), V.as_of()).select(F.lit(k), "rank", "path_key") for k, q in V.ALIAS_REQUESTS.items()]
    assert got == sorted(tuple(r) for one in with_store for r in one.collect()) and {k for k, _, _ in got} == set(V.ALIAS_REQUESTS)


def test_batch_search_ranks_what_a_narrow_pass_leaves(spark, monkeypatch):
    """Usage and pins decide among all ties, rows and path keys that come twice stay; before, all pairs were sorted as a whole."""
    from pathmere.operators import catalog as K

    names = [(f"/d/bolt {k:03}.txt", k) for k in range(200)] + [("/d/bolt 005.txt", 5), ("/d/BOLT 007.txt", 7), ("/d/bolt", 300), ("/e/long bolt.txt", 301), (None, 302)]
    rows = spark.createDataFrame(names, "p string, n long").repartition(4)
    records = K.catalog_from(rows, F.col("p"), F.lit(False), F.col("n"), F.lit("2024-01-01"), F.col("n")).withColumn("structural", F.lit(False))
    catalog = K.with_alias_forms(K.with_path_columns(records)).select(*K.CATALOG_COLUMNS)
    asked = {
        1: R.SearchRequest(terms=["bolt"], limit=4), 2: R.SearchRequest(terms=["bolt 00"], limit=7), 3: R.SearchRequest(kind="files", limit=3),
        4: R.SearchRequest(terms=["blt"], preferred_root="/e", limit=2), 5: R.SearchRequest(phrases=["bolt 005"], limit=9), 6: R.SearchRequest(terms=["zz"]),
        7: R.SearchRequest(path_terms=["e"], limit=2),
    }
    at = datetime(2024, 1, 1)
    usage_rows = spark.createDataFrame([("/d/bolt 150.txt", 9, at), ("/d/bolt 199.txt", 1, at)], "path_key string, open_count long, last_used_at timestamp")
    pinned = spark.createDataFrame([("/d/bolt 120.txt",)], "path string")
    seen = []
    plain = R.matching_pairs
    monkeypatch.setattr(R, "matching_pairs", lambda c, *a: seen.append(c.count()) or plain(c, *a))
    found = R.search_many(catalog, R.request_table(spark, asked), usage_rows, pinned, F.lit(at)).select("query_id", "rank", "path_key", "full_path", "tier", "open_count").collect()
    assert seen[0] == seen[2] == 205 and seen[1] == 204  # ties of the last place stay
    want = [R.search(catalog, q, usage_rows, pinned, F.lit(at)).select(F.lit(k), "rank", "path_key", "full_path", "tier", "open_count") for k, q in asked.items()]
    assert sorted(map(tuple, found)) == sorted(tuple(r) for one in want for r in one.collect())
    assert [r.path_key for r in sorted(found, key=lambda r: r.rank) if r.query_id == 1] == ["/d/bolt", "/d/bolt 150.txt", "/d/bolt 199.txt", "/d/bolt 000.txt"]
    seen.clear()
    only = {1: R.SearchRequest(terms=["bolt"], limit=1), 2: R.SearchRequest(terms=["long"], limit=5), 3: R.SearchRequest(phrases=["bolt 005"], limit=1)}
    assert len(R.search_many(catalog, R.request_table(spark, only)).collect()) == 3 and seen == [205, 4]


def test_applications_by_the_end_of_their_path(spark):
    paths = ["/a/x.LNK", "/a/x.lnk\n", "/a/x.exe", "c:\\Desktop\\x.exe", "/program files/a/X.EXE", "/programs/x.msc", "/programs/x.appref-ms", "/programs/xexe", "/programs/.exe/x", "/a.lnk/b", ".lnk", None]
    rows = spark.createDataFrame([(p, d) for p in paths for d in (False, True)], "p string, d boolean")
    got = [r[0] for r in rows.select(is_application(F.col("p"), F.col("d"))).collect()]
    assert got[1::2] == [False] * len(paths)
    assert got[::2] == [True, False, False, True, True, True, True, False, False, False, True, None]
