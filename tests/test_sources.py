import pytest
from pyspark.sql import functions as F

from pathmere.functions.markup import html_to_text, mailbox_headers, markdown_to_text
from pathmere.sources import files, records, snapshots


def test_listing_and_text_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a b+c%.txt").write_bytes("Größe".encode())
    (tmp_path / "sub" / "gbk.txt").write_bytes("中文文本".encode("gbk"))
    (tmp_path / "sub" / "bin.dat").write_bytes(b"abcdefgh\x00ijklmnopq")
    (tmp_path / "u16.txt").write_bytes("plain text".encode("utf-16-le"))
    (tmp_path / "be.txt").write_bytes(b"\xfe\xff" + "ß".encode("utf-16-be"))
    listed = {r.full_path: r.size_bytes for r in files.read_listing(spark, str(tmp_path)).collect()}
    assert listed[f"{tmp_path}/a b+c%.txt"] == 7 and len(listed) == 5
    texts = {r.full_path.rsplit("/", 1)[1]: r.text for r in files.read_text_files(spark, str(tmp_path)).collect()}
    assert texts == {"a b+c%.txt": "Größe", "gbk.txt": "中文文本", "bin.dat": None, "u16.txt": "plain text", "be.txt": "ß"}


def test_binary_rule(spark):
    rows = [(b"plain\ttext\n",), (b"\x01" * 2 + b"a" * 18,), (b"\x01" + b"a" * 19,), (b"a\x00",), (b"",)]
    got = [r[0] for r in spark.createDataFrame(rows, "b binary").select(files.is_binary("b")).collect()]
    assert got == [False, True, False, True, False]


def test_decoding(spark):
    rows = [
        (b"plain \xc3\xbc", "plain ü"), (b"\xef\xbb\xbfmark", "mark"), (b"\xef\xbb\xbfbad \xff", "bad \ufffd"), (b"\xff\xfea\x00", "a"), (b"\xfe\xff\x00a", "a"),
        ("wide text".encode("utf-16-le"), "wide text"), ("wide text".encode("utf-16-be"), "wide text"), ("中文".encode("gbk"), "中文"), (b"a\x00bcdefgh", None), (b"", ""), (None, None),
    ]
    got = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(rows)], "i int, b binary").select("i", files.decode_text("b").alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [t for _, t in rows]


def test_listing_reads_no_content(spark, sf_dir):
    plan = files.read_listing(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>" in plan


def test_snapshots_publish_and_fall_back(spark, tmp_path):
    store = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        snapshots.load_snapshot(spark, store)
    snapshots.save_snapshot(spark.range(5), store, 1)
    snapshots.save_snapshot(spark.range(9), store, 2)
    assert snapshots.load_snapshot(spark, store).count() == 9
    newest = snapshots.published(spark, store)
    part = next((tmp_path / "store").glob("gen=2/attempt=*/part-*.parquet"))
    part.write_bytes(b"damaged")
    assert snapshots.load_snapshot(spark, store).count() == 5
    assert newest.generation == 2
    # an attempt that was written but never published stays invisible
    spark.range(100).write.parquet(f"{store}/gen=3/attempt=x")
    assert snapshots.load_snapshot(spark, store).count() == 5


def test_change_and_metric_round_trip(spark, tmp_path):
    path = str(tmp_path / "metrics")
    row = "'1' id, 'search' operation, timestamp'2024-01-01' started_at, 1.5D total_ms, 'success' outcome, 3L result_count"
    df = spark.sql(f"select {row}, map('read', 0.5D) stages, map('hits', 7L) counters")
    records.write_metrics(df, path)
    records.write_metrics(df, path)
    assert records.read_metrics(spark, path).collect() == df.collect() * 2


def test_describe_parquet(spark, sf_dir):
    schema, counts = files.describe_parquet(spark, f"{sf_dir}/embeddings.parquet")
    assert [(r.name, r.type) for r in schema.orderBy("position").collect()][:2] == [("vec_id", "bigint"), ("embedding", "array<float>")]
    assert counts.first().row_count == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()


def text_of(spark, fn, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_html(spark):
    page = (
        "<html><head><STYLE>p{}</STYLE><script>\nvar a='<p>';\n</script></head><body><h1>Title &amp; more</h1><p>One<br/>two</p>\n\n\n"
        "<noscript>no</noscript><b>three</b> &lt;x&gt; &#65;&#x42; &amp;lt; &#1114112; &unknown;</body></html>"
    )
    assert text_of(spark, html_to_text, page) == ["Title & more\n\nOne\ntwo\n\nthree <x> AB &lt; &#1114112; &unknown;"]


def test_markdown(spark):
    md = [
        "# Head\n\nText **bold** and _em_ `code` snake_case_name 2 * 3", "![alt](x.png) [link](http://x)",
        "> quote\n> more", "```python\ncode()\n```\nafter", "~~gone~~ <b>tag</b> &copy;", "   ### Deep",
    ]
    assert text_of(spark, markdown_to_text, *md) == [
        "Head\n\nText bold and em code snake_case_name 2 * 3", "alt link", "quote\nmore", "code()\nafter", "gone tag ©", "Deep",
    ]


def test_references_are_read_once(spark):
    got = text_of(spark, html_to_text, "&#38;lt;b &AMP; &#X41;&#x1F600; &#1114111;x &#0; &eacute;&Omega;&rarr; \u0001 &#65; a&b", "no reference", None)
    assert got == ["&lt;b &AMP; A\U0001f600 \U0010ffffx &#0; éΩ→ \u0001 A a&b", "no reference", None]


def test_markdown_links_and_emphasis(spark):
    md = ["[a [b] c](x(y)z \"t\") ![](i.png)![p](<q r>)", "***both*** __u__ 2*3*4 a_b_ *x* ** y", ">> deep\n~~~~ info\n# kept in fence\n~~~~", "a ~~b~~ ``c`d``"]
    assert text_of(spark, markdown_to_text, *md) == ["a [b] c p", "both u 2*3*4 a_b x ** y", "deep\nkept in fence", "a b cd"]


def test_mailbox(spark):
    text = (
        "From a@x Mon\r\nFrom: A <a@x>\r\nSubject: first\r\n second\r\nDate: d1\r\n\r\nbody\r\nSubject: not a header\r\n"
        "From b@x Tue\nsubject: one\nSubject: two\n\nFrom inside line\n"
    )
    got = mailbox_headers(spark.createDataFrame([(1, text), (2, "no mail")], "id int, text string"), "id").collect()
    assert [tuple(r) for r in got] == [(1, 1, "A <a@x>", "d1", "first second"), (1, 2, "", "", "two"), (1, 3, "", "", "")]
