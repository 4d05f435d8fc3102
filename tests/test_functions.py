import pytest
from pyspark.sql import functions as F

from pathmere.functions import alias as A
from pathmere.functions import paths as P
from pathmere.functions import scoring as S
from pathmere.functions.journal import DELETE_MASK, UPSERT_MASK


def column(spark, values, *exprs, schema="v string"):
    rows = [v if isinstance(v, tuple) else (v,) for v in values]
    out = spark.createDataFrame(rows, schema).select(*[e.alias(f"c{i}") for i, e in enumerate(exprs)]).collect()
    return [r[0] if len(exprs) == 1 else tuple(r) for r in out]


def test_norm_path(spark):
    got = column(
        spark,
        [" C:\\A\\B\\ ", "/a/../b/./c/", "/", "rel", "C:\\", "//srv/x/", "/a//b", "  ", "/../x", "C:\\a\\..\\.."],
        P.norm_path(F.col("v")),
    )
    assert got == ["C:/A/B", "/b/c", "/", None, "C:/", "//srv/x", "/a/b", None, "/x", "C:/"]


def test_name_parent_ancestors(spark):
    v = F.col("v")
    got = column(spark, ["C:/A/B.txt", "/", "C:/", "/x", "/a/b/c.txt"], P.name_of(v), P.parent_path(v), P.ancestors(v), P.volume_of(v))
    assert got == [
        ("B.txt", "C:/A", ["C:/A"], "c:"),
        ("", "", [], "/"),
        ("C:", "", [], "c:"),
        ("x", "/", [], "/x"),
        ("c.txt", "/a/b", ["/a", "/a/b"], "/a"),
    ]


def test_display_name(spark):
    got = column(
        spark,
        ["/d/My App.LNK", "/d/a%20b+c", "/d/C%3A%5CUsers%5Cme%5Cproj", "/d/100%", "/d/x%zz%41", "/d/%FF", "/d/plain", "/d/%2F"],
        P.display_name(F.col("v")),
    )
    assert got == ["My App", "a b+c", "proj", "100%", "x%zzA", "%FF", "plain", "/"]


def test_name_variants_and_like(spark):
    got = column(spark, ["PathFinder", "HTTPServerName", "fooBAR", "abc", "a b", "ab", "my_file", "x:Y"], P.name_variants(F.col("v")))
    assert got == [
        ["pathfinder", "path_finder", "path-finder"],
        ["httpservername", "http_server_name", "http-server-name"],
        ["foobar", "foo_bar", "foo-bar"],
        ["abc"], ["a b"], ["ab"], ["my_file"], ["x:y"],
    ]
    assert column(spark, ["a_b%"], P.escape_like(F.col("v")), P.ordered_like(F.col("v"))) == [("a\\_b\\%", "%a%\\_%b%\\%%")]


def test_applications(spark):
    rows = [
        ("/home/x.lnk", False), ("/home/x.lnk", True), ("/opt/Programs/x.exe", False), ("/opt/x.exe", False),
        ("C:\\Users\\me\\Desktop\\x.exe", False), ("/desktop/x.msc", False), ("/windowsapps/a.appref-ms", False),
    ]
    got = column(spark, rows, P.is_application(F.col("p"), F.col("d")), schema="p string, d boolean")
    assert got == [True, False, True, False, True, False, True]


def test_fuzzy_score(spark):
    rows = [("lo", "lunar-open"), ("abc", "xaxbxc"), ("zz", "abc"), ("pen", "Open "), ("", "x"), ("ab", "a-b"), ("aa", "aba"), ("x" * 40, "-".join("x" * 40))]
    got = column(spark, rows, S.fuzzy_score(F.col("q"), F.col("c")), schema="q string, c string")
    # independent greedy walk over the candidate characters
    def walk(q, c):
        q, c = q.strip().lower(), c.strip().lower()
        if not q or not c:
            return 0.0
        if q in c:
            return 200.0 + len(q)
        i = streak = score = 0
        for at, ch in enumerate(c):
            if i < len(q) and ch == q[i]:
                i, streak = i + 1, streak + 1
                score += 8 + 2 * streak + (10 if at == 0 or c[at - 1] in " -_.\\/" else 0)
            else:
                streak = 0
        return float(min(score, 199)) if i == len(q) else 0.0

    assert got == [walk(q, c) for q, c in rows]
    assert got[:3] == [40.0, 30.0, 0.0]


PATH_CASES = [
    ("C:\\source\\application\\x", "src\\app", False),
    ("C:\\Projects\\foo\\bar", "projects\\foo", True),
    ("C:\\Projects\\foo\\bar", "projects/bar", True),
    ("C:\\Projects\\foo\\bar", "bar/projects", False),
    ("C:\\application\\x", "app", False),
    ("C:\\app-data\\x", "app", True),
    ("C:\\source\\x", "src", False),
    ("C:\\Projects\\中大成赢\\门房图纸.cad", "中大\\门房", True),
    ("C:\\v1.2 build\\x", "1.2", True),
    ("C:\\a", " ", False),
]


def test_path_match(spark):
    got = column(spark, [(p, e) for p, e, _ in PATH_CASES], S.path_match(F.col("p"), F.col("e")), schema="p string, e string")
    assert got == [hit for _, _, hit in PATH_CASES]


def test_path_score(spark):
    assert column(spark, [("/a/bcd/ef", "bcd/ef"), ("/a/b", "x/y")], S.path_score(F.col("p"), F.col("e")), schema="p string, e string") == [9, 0]


def test_alias_forms(spark):
    v = F.col("v")
    got = column(spark, ["plain.txt", "Größe ok.txt", "звезда.txt", "星空.jpg"], A.alias_need(v), A.latin_reading(v))
    assert got == [
        ("none", "plain.txt"), ("multilingual", "grosseok.txt"), ("multilingual", "zvezda.txt"), ("chinese", "星空.jpg"),
    ]
    rows = [("星空.jpg", "xingkong.jpg", "xk.jpg"), ("ä", "a", "a"), ("a", "a", "a"), ("Ä b", "ä b", "ä b")]
    got = column(spark, rows, A.search_text(F.col("n"), F.col("r"), F.col("i")), schema="n string, r string, i string")
    assert got == ["xingkong.jpg xk.jpg", "a", "", ""]


def key_of(spark, term, name, reading=None, initials=None, path=None, fuzzy=True):
    path = path or f"/root/{name}"
    rows = [(name, reading or name, initials or reading or name, path, term)]
    df = spark.createDataFrame(rows, "name string, reading string, initials string, full_path string, t string")
    df = S.with_match_columns(df.withColumn("parent_path", P.parent_path(F.col("full_path"))))
    out = df.select(S.term_key(F.col("t"), S.NameForms.of_catalog(), fuzzy).alias("k")).first().k
    return None if out is None else tuple(out)


@pytest.mark.parametrize(
    "args, expected",
    [
        (("invoice", "Invoice"), (0, 7.0, 0, "exact-name")),
        (("proj", "C%3A%5Cproj"), (1, 4.0, 7, "exact-name")),
        (("inv", "Invoice.txt"), (1, 3.0, 8, "name-prefix")),
        (("roj", "C%3A%5Cproj"), (6, 3.0, 8, "name-substring")),
        (("voice", "Invoice"), (2, 5.0, 2, "name-substring")),
        (("xk", "星空.jpg", "xingkong.jpg", "xk.jpg"), (1, 302.0, 4, "pinyin")),
        (("ab", "a-b"), (3, 40.0, 1, "name-fuzzy")),
        (("kong", "星空.jpg", "xingkong.jpg", "xk.jpg"), (4, 204.0, 2, "pinyin")),
        (("foo/bar", "z.txt", None, None, "/foo/bar/z.txt"), (2, 10.0, 1, "path-segment")),
        (("zz", "abc"), None),
        (("ab", "a-b", None, None, None, False), None),
    ],
)
def test_term_rules(spark, args, expected):
    assert key_of(spark, *args) == expected


def test_combined_terms(spark):
    df = spark.createDataFrame([("red bolt",), ("bolt",), ("rxexd bolt",)], "name string").selectExpr(
        "*", "name reading", "name initials", "'/x/y' full_path", "'/x' parent_path"
    )
    df, row = S.with_match_columns(df), S.NameForms.of_catalog()
    none = F.array().cast("array<string>")
    keyed = df.select(S.all_keys(F.array(F.lit("red"), F.lit("bolt")), none, row).alias("keys"))
    got = keyed.select(F.when(S.all_matched(F.col("keys")), S.combine_keys(F.col("keys"))).alias("k")).collect()
    assert tuple(got[0].k)[:4] == (2, 7.0, 9, "name-substring")
    assert got[1].k is None
    assert got[2].k.tier == 3 and got[2].k.reason == "name-fuzzy"
    assert df.select(S.all_matched(S.all_keys(none, none, row)).alias("k")).first().k is False


def test_item_score(spark):
    rows = [
        ("Editor", "Some window", [], "editor"), ("Editor", "Some window", [], "win"), ("Editor", "Some window", ["ed"], "win"),
        ("Editor", "", [], "edit"), ("Editor", "", [], "tor"), ("Editor", "", [], "eo"), ("x", "", ["Big Tool", "tool"], "tool"),
    ]
    got = column(spark, rows, S.item_score(*[F.col(c) for c in "ndaq"]), schema="n string, d string, a array<string>, q string")
    assert got == [1000.0, 295.0, None, 800.0, 597.0, 94.0, 1000.0]


def test_masks():
    assert DELETE_MASK == 0x1200
    assert UPSERT_MASK == 0x1 | 0x2 | 0x4 | 0x10 | 0x20 | 0x40 | 0x100 | 0x8000 | 0x2000


def test_shares_are_volumes_and_roots(spark):
    rows = ["\\\\server\\share\\a\\b.txt", "//Server/Share", "//server/share/x/", "//server", "/vol/a/b", "C:/x/y"]
    n = P.norm_path(F.col("p"))
    got = spark.createDataFrame([(x,) for x in rows], "p string").select(n, P.volume_of(n), P.parent_path(n), P.ancestors(n), P.is_root(n)).collect()
    assert [tuple(r) for r in got] == [
        ("//server/share/a/b.txt", "//server/share", "//server/share/a", ["//server/share", "//server/share/a"], False),
        ("//Server/Share", "//server/share", "", [], True),
        ("//server/share/x", "//server/share", "//server/share", ["//server/share"], False),
        ("//server", "//server", "", [], True),
        ("/vol/a/b", "/vol", "/vol/a", ["/vol", "/vol/a"], False),
        ("C:/x/y", "c:", "C:/x", ["C:/x"], False),
    ]
