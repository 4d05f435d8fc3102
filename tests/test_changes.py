import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pathmere.operators import changes as C
from pathmere.sources import catalog_log
from pathmere.streaming import jobs

OPS = (
    "usn long, seq int, op string, path_key string, full_path string, is_directory boolean, size_bytes long, "
    "mtime timestamp, file_reference long, volume string, subtree boolean"
)
BASE = "path_key string, full_path string, is_directory boolean, size_bytes long, mtime timestamp, file_reference long, generation long"
AT = datetime(2024, 1, 1)


def volume(path):
    return "/" + path.split("/")[1]


def replay(base, changes, generation):
    """The rules applied one change at a time to a dictionary."""
    rows = {p: dict(size=s, ref=r, gen=g) for p, s, r, g in base}

    def upsert(path, size, ref):
        old = rows.get(path)
        if old is None:
            rows[path] = dict(size=size, ref=ref, gen=generation)
        elif old["size"] != size or (ref > 0 and old["ref"] != ref):
            rows[path] = dict(
                size=size, ref=ref if ref > 0 else old["ref"], gen=generation if generation > 0 else old["gen"]
            )

    for kind, *args in changes:
        if kind == "upsert":
            upsert(*args)
        elif kind == "delete":
            rows.pop(args[0], None)
        elif kind == "delete_tree":
            for path in [p for p in rows if p == args[0] or p.startswith(args[0] + "/")]:
                del rows[path]
        else:
            ref, live = args
            for path, size in live:
                upsert(path, size, ref)
            volumes = {volume(p) for p, _ in live}
            keep = {p for p, _ in live}
            for path in [p for p, r in rows.items() if r["ref"] == ref and p not in keep]:
                if not volumes or volume(path) in volumes:
                    del rows[path]
    return {p: (r["size"], r["ref"], r["gen"]) for p, r in rows.items()}


def as_rows(changes):
    out = []
    for usn, (kind, *args) in enumerate(changes):
        def row(seq, op, path, size=None, ref=0, vol=None, tree=False):
            out.append((usn, seq, op, path, path, False, size, AT, ref, vol, tree))

        if kind == "upsert":
            row(1, "upsert", *args)
        elif kind.startswith("delete"):
            row(2, "delete", args[0], tree=kind == "delete_tree")
        else:
            ref, live = args
            for vol in {volume(p) for p, _ in live} or {"*"}:
                row(0, "purge", None, ref=ref, vol=vol)
            for path, size in live:
                row(1, "upsert", path, size, ref)
    return out


def random_changes(rng, n):
    paths = [f"/{v}/{d}/{f}" for v in "ab" for d in "xy" for f in "12"] + ["/a/x", "/b"]
    made = []
    for _ in range(n):
        kind = rng.choices(["upsert", "delete", "delete_tree", "resync"], [5, 1, 1, 3])[0]
        if kind == "upsert":
            made.append((kind, rng.choice(paths), rng.randint(1, 2), rng.choice([0, 1, 2])))
        elif kind == "resync":
            live = rng.sample(paths, rng.choice([0, 1, 1, 2]))
            made.append((kind, rng.choice([1, 2]), [(p, rng.randint(1, 2)) for p in live]))
        else:
            made.append((kind, rng.choice(paths)))
    base = [(p, rng.randint(1, 2), rng.choice([0, 1, 2]), 3) for p in rng.sample(paths, 6)]
    return base, made


@pytest.mark.parametrize("generation", [0, 9])
def test_apply_matches_replay(spark, generation):
    """Many random batches at once: each case lives below its own pair of volumes and references."""
    rng = random.Random(11 + generation)
    base_rows, op_rows, expected = [], [], {}
    for case in range(150):
        base, made = random_changes(rng, rng.choice([1, 2, 3, 5, 8, 12]))
        tag = lambda p: f"/c{case}{p[1:]}" if p else p  # noqa: E731  (keeps the first component a volume)
        ref = lambda r: r + case * 10 if r else 0
        base_rows += [(tag(p), tag(p), False, s, AT, ref(r), g) for p, s, r, g in base]
        for usn, seq, op, path, _, d, size, at, r, vol, tree in as_rows(made):
            vol = vol if vol in (None, "*") else f"/c{case}{vol[1:]}"
            op_rows.append((usn, seq, op, tag(path), tag(path), d, size, at, ref(r), vol, tree))
        for path, (size, r, gen) in replay(base, made, generation).items():
            expected[tag(path)] = (size, ref(r), gen)
    ops, base = spark.createDataFrame(op_rows, OPS), spark.createDataFrame(base_rows, BASE)
    got = {r.path_key: (r.size_bytes, r.file_reference, r.generation) for r in C.apply_operations(base, ops, generation).collect()}
    wrong = {p: (got.get(p), expected.get(p)) for p in got.keys() | expected.keys() if got.get(p) != expected.get(p)}
    assert not wrong, (len(wrong), list(wrong.items())[:5])


def typed(spark, *rows):
    return spark.createDataFrame(rows, C.CHANGE_SCHEMA)


def test_lowering(spark):
    live = [("/v/a", False, 1, AT), ("/v/tmp", False, 1, AT)]
    rows = typed(
        spark,
        (1, "upsert", "/v/keep", None, False, 5, AT, 3, None),
        (2, "upsert", "/v/tmp", None, False, 5, AT, 3, None),
        (3, "rename", "/v/new", "/v/old", False, 5, AT, 3, None),
        (4, "rename", "/v/tmp", "/v/old2", False, 5, AT, 3, None),
        (5, "resync", None, None, None, None, None, 8, live),
        (6, "resync", None, None, None, None, None, 9, [("/v/tmp", False, 1, AT)]),
    )
    ok = lambda record: record["full_path"] != "/v/tmp"
    got = sorted((r.usn, r.seq, r.op, r.path_key, r.volume) for r in C.lower_changes(rows, ok).collect())
    assert got == [
        (1, 1, "upsert", "/v/keep", None), (2, 1, "delete", "/v/tmp", None),
        (3, 0, "delete", "/v/old", None), (3, 1, "upsert", "/v/new", None), (4, 0, "delete", "/v/old2", None),
        (5, 0, "purge", None, "/v"), (5, 1, "upsert", "/v/a", None), (6, 0, "purge", None, "*"),
    ]


def test_directory_move_empties_batch(spark):
    rows = typed(
        spark, (1, "upsert", "/v/a", None, False, 5, AT, 3, None), (2, "rescan", None, None, True, None, None, 0, None)
    )
    assert C.lower_changes(rows).count() == 0
    assert C.needs_rescan(rows).count() == 1


def test_catch_up_plan(spark):
    journals = spark.createDataFrame(
        [(r, 7, 100, 200) for r in ("none", "read", "id", "rules", "low", "high", "missing")],
        "root string, journal_id int, lowest_valid_usn long, next_usn long",
    )
    points = spark.createDataFrame(
        [("none", 7, 200, 2), ("read", 7, 150, 2), ("id", 8, 150, 2), ("rules", 7, 150, 1), ("low", 7, 99, 2), ("high", 7, 201, 2)],
        "root string, journal_id int, next_usn long, rules_version int",
    )
    got = {r.root: (r.action, r.start_usn, r.end_usn) for r in C.catch_up_plan(journals, points, 2).collect()}
    rescan = ("rescan", 0, 200)
    assert got == {
        "none": ("none", 200, 200), "read": ("read", 150, 200), "id": rescan, "rules": rescan,
        "low": rescan, "high": rescan, "missing": rescan,
    }


def test_scan_outcome(spark):
    rows = [
        ("same", 1, 5, 1, 5, True, 3), ("clean", 1, 5, 1, 9, False, 3), ("dirty", 1, 5, 1, 9, True, 3), ("id", 1, 5, 2, 9, False, 3),
        ("back", 1, 5, 1, 4, False, 3), ("empty", 1, 5, 1, 4, False, 0), ("gone", 1, 5, None, None, False, 3),
    ]
    df = spark.createDataFrame(rows, "root string, pre_id int, pre_usn int, post_id int, post_usn int, replay_rescan boolean, scanned int")
    assert {r.root: r.outcome for r in C.scan_outcome(df).collect()} == {
        "same": "prune", "clean": "prune", "dirty": "retain", "id": "retain", "back": "retain", "empty": "fallback", "gone": "retain",
    }


def test_coalescing_against_ordered_fold(spark):
    rng = random.Random(5)
    rows, expected = [], {}
    for seq in range(800):
        path, old = f"/p{rng.randint(0, 60)}", f"/p{rng.randint(0, 60)}"
        kind = rng.choice(["created", "changed", "changed", "renamed", "deleted"])
        rows.append((seq, path, kind, old if kind == "renamed" else None))
        if kind == "deleted":
            expected[path] = "delete"
        elif kind == "renamed":
            expected[old] = "delete"
            expected[path] = "refresh_recursive"
        elif kind == "created":
            expected[path] = "refresh_recursive"
        elif expected.get(path) != "refresh_recursive":
            expected[path] = "refresh"
    df = spark.createDataFrame(rows, "seq long, full_path string, kind string, old_full_path string")
    assert {r.full_path: r.action for r in C.coalesce_hints(df).collect()} == expected


def test_range_must_be_complete(spark):
    journal = spark.createDataFrame([(10,), (90,)], "next_usn long")
    assert C.range_progress(journal, 90).first().complete
    with pytest.raises(Exception, match="journal range incomplete"):
        C.require_complete(C.range_progress(journal, 91)).collect()


def test_superseded_requests(spark):
    rows = [("s", i, 1_000_000 + ms * 1000) for i, ms in enumerate([0, 50, 100, 300, 301, 301, 400, 480])] + [("t", 0, 1_000_000)]
    df = spark.createDataFrame(rows, "session_id string, seq long, us long").withColumn("ts", F.timestamp_micros("us"))
    kept = C.drop_superseded(df, 0.08).collect()
    assert sorted((r.session_id, r.seq) for r in kept) == [("s", 2), ("s", 5), ("s", 6), ("s", 7), ("t", 0)]


def test_connected_changes_carry_metadata_and_live_links(spark):
    bit = C.REASON_BITS
    entries = [
        (1, 10, 1, "a.txt", False, bit["file_create"]), (2, 11, 1, "gone.txt", False, bit["data_extend"]), (3, 12, 1, "b.txt", False, bit["hard_link_change"]),
        (4, 13, 1, "last.txt", False, bit["hard_link_change"]), (5, 14, 9, "lost.txt", False, bit["hard_link_change"]), (6, 15, 1, "c.txt", False, bit["file_delete"]),
        (7, 16, 1, "unread.txt", False, bit["file_create"]), (8, 17, 1, "D", True, bit["rename_new_name"]), (9, 10, 1, "a.txt", False, bit["close"]),
        (10, 18, 2, "out.txt", False, bit["hard_link_change"]),
    ]
    journal = spark.createDataFrame(entries, "usn long, ref long, parent_ref long, name string, is_dir boolean, reason long")
    folders = spark.createDataFrame([(1, "/v/in"), (2, "/out")], "id long, full_path string")
    at = datetime(2024, 1, 1)
    rows = [(10, "/v/in/A.txt", 5), (12, "/v/in/other.txt", 6), (12, "/v/in/x.txt", 6), (12, "/out/y.txt", 6), (16, "/v/in/unread.txt", None)]
    live = spark.createDataFrame([(r, p, False, n, at) for r, p, n in rows], "ref long, full_path string, is_directory boolean, size_bytes long, mtime timestamp")
    got = {(r.usn, r.kind): r for r in C.connected_changes(journal, folders, live, "/v").collect()}
    assert {k: r.full_path for k, r in got.items()} == {
        (1, "upsert"): "/v/in/a.txt", (2, "rescan"): "/v/in/gone.txt", (3, "resync"): None, (3, "delete"): "/v/in/b.txt", (4, "resync"): None,
        (4, "delete"): "/v/in/last.txt", (5, "rescan"): None, (6, "delete"): "/v/in/c.txt", (7, "rescan"): "/v/in/unread.txt", (8, "rescan"): "/v/in/D",
    }
    assert (got[1, "upsert"].size_bytes, got[1, "upsert"].mtime) == (5, at)
    assert [r.full_path for r in got[3, "resync"].live_records] == ["/v/in/other.txt", "/v/in/x.txt"] and got[4, "resync"].live_records == []


def test_journal_replay_equals_a_one_by_one_replay(spark, tmp_path):
    """Random entries on few records; a plain loop applies each to a dictionary."""
    rng, at, bit = random.Random(12), datetime(2024, 1, 1), C.REASON_BITS
    names = {r: [f"/v/d/n{r}.txt"] + [f"/v/e/m{r}.txt"] * (r % 2) for r in range(1, 7)}
    rows = [(r, p, False, r * 10, at) for r, own in names.items() for p in own]
    live = spark.createDataFrame(rows, "ref long, full_path string, is_directory boolean, size_bytes long, mtime timestamp")
    folders = spark.createDataFrame([(1, "/v/d"), (2, "/v/e")], "id long, full_path string")
    base = {f"/v/old{r}": (1, r) for r in names}
    want, entries = dict(base), []
    for usn in range(60):
        r, what = rng.randint(1, 6), rng.choice(["file_create", "file_delete", "hard_link_change", "close"])
        entries.append((usn, r, 1, f"n{r}.txt", False, bit[what]))
        if what == "file_create":
            want[names[r][0]] = (r * 10, r)
        elif what == "file_delete":
            want.pop(names[r][0], None)
        elif what == "hard_link_change":
            want = {p: v for p, v in want.items() if v[1] != r} | {p: (r * 10, r) for p in names[r]}
    schema = "usn long, ref long, parent_ref long, name string, is_dir boolean, reason long"
    catalog = spark.createDataFrame([(p, p, False, n, at, r, 1) for p, (n, r) in base.items()], "path_key string, full_path string, is_directory boolean, size_bytes long, mtime timestamp, file_reference long, generation long")
    source, folder = str(tmp_path / "entries"), str(tmp_path / "out")
    catalog_log.publish(catalog, f"{folder}/catalog", buckets=4)
    for k in range(3):
        spark.createDataFrame(entries[k * 20 : k * 20 + 20], schema).coalesce(1).write.mode("append").parquet(source)
        jobs.replay_journal(spark.readStream.schema(schema).parquet(source), folders, live, "/v", folder).awaitTermination()
    got = {r.path_key: (r.size_bytes, r.file_reference) for r in catalog_log.read(spark, f"{folder}/catalog").collect()}
    assert got == want and catalog_log.manifest(spark, f"{folder}/catalog").checkpoint.position == 59
