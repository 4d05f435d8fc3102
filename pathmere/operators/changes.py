"""Change data: journal entries to typed changes, change batches, live hints."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathmere.functions import paths as P
from pathmere.operators.aliases import with_alias_forms
from pathmere.operators.catalog import with_path_columns
from pathmere.functions.journal import DELETE_MASK, REASON_BITS, UPSERT_MASK, has_any
from pathmere.operators.filters import not_excluded
from pathmere.session import cut_lineage

RECORD = ["full_path", "is_directory", "size_bytes", "mtime"]
OP_COLUMNS = ["usn", "seq", "op", "path_key", *RECORD, "file_reference", "volume", "subtree"]


# --- journal entries to typed changes ----------------------------------------------------

def with_entry_path(journal: DataFrame, folders: DataFrame) -> DataFrame:
    """Entries with their resolved path; ``folders`` is (id, full_path) from the hierarchy."""
    parent = folders.select(F.col("id").alias("_id"), F.col("full_path").alias("_folder"))
    usable = (P.strip(F.col("name")) != "") & (F.col("name") != ".")
    path = F.when(usable, F.concat("_folder", F.lit("/"), "name"))
    joined = journal.join(parent, P.segment_ref(F.col("parent_ref")) == F.col("_id"), "left")
    return joined.withColumn("full_path", path).drop("_id", "_folder")


def is_ambiguous(reason: Column, is_dir: Column) -> Column:
    """A rename seen in one entry only: old name together with close or new name."""
    bits = REASON_BITS["close"] | REASON_BITS["rename_new_name"]
    return ~is_dir & has_any(reason, REASON_BITS["rename_old_name"]) & has_any(reason, bits)


def change_kind(root: str) -> Column:
    """'rescan', 'resync', 'delete', 'upsert' or null (no change to apply)."""
    reason, is_dir, path = F.col("reason"), F.col("is_dir"), F.col("full_path")
    moved_dir = is_dir & has_any(reason, DELETE_MASK | REASON_BITS["rename_new_name"])
    return (
        F.when(moved_dir | is_ambiguous(reason, is_dir), "rescan")
        .when(~is_dir & has_any(reason, REASON_BITS["hard_link_change"]), "resync")
        .when(path.isNull(), "rescan")
        .when(~P.under_root(P.path_key(path), F.lit(root)), None)
        .when(has_any(reason, DELETE_MASK), "delete")
        .when(has_any(reason, UPSERT_MASK), "upsert")
    )


def journal_changes(journal: DataFrame, folders: DataFrame, root: str) -> DataFrame:
    """Typed changes of journal entries; entries without effect drop out."""
    placed = with_entry_path(journal, folders)
    return (
        placed.withColumn("kind", change_kind(root))
        .where("kind is not null")
        .withColumn("file_reference", P.segment_ref(F.col("ref")))
    )


def hard_link_changes(entries: DataFrame, live: DataFrame, root: str) -> DataFrame:
    """Rows (usn, kind, file_reference, full_path) that replace resync entries.

    ``entries`` are resync entries with ``full_path`` (null when unresolved); ``live`` holds one
    row per current link (ref, full_path). A record still present gives one 'live' row per name
    inside the root plus a 'resync' marker; a reported name that is not live is also deleted. A
    vanished record gives a marker and the delete, or asks for a rescan when its name is unknown.
    Links stay rows, so a record may have any number of them.
    """
    inside = lambda p: P.under_root(P.path_key(p), F.lit(root))
    e = entries.select(
        "usn", P.segment_ref(F.col("ref")).alias("file_reference"), F.col("full_path").alias("reported")
    )
    links = live.select(P.segment_ref(F.col("ref")).alias("_ref"), F.col("full_path").alias("_link"))
    present = links.select("_ref").distinct().withColumn("_present", F.lit(True))
    known = e.join(present, F.col("file_reference") == F.col("_ref"), "left").drop("_ref")
    known = known.withColumn("_present", F.coalesce("_present", F.lit(False)))
    here = F.coalesce(inside(F.col("reported")), F.lit(False))

    def rows(df: DataFrame, kind: str, path: Column) -> DataFrame:
        return df.select("usn", F.lit(kind).alias("kind"), "file_reference", path.alias("full_path"))

    none = F.lit(None).cast("string")
    live_rows = known.where("_present").join(links.where(inside(F.col("_link"))), F.col("file_reference") == F.col("_ref"))
    unlisted = known.where(here).join(
        links.select("_ref", P.path_key(F.col("_link")).alias("_link_key")),
        (F.col("file_reference") == F.col("_ref")) & (P.path_key(F.col("reported")) == F.col("_link_key")),
        "left_anti",
    )
    return (
        rows(known.where(F.col("_present") | here), "resync", none)
        .unionByName(rows(live_rows, "live", F.col("_link")))
        .unionByName(rows(unlisted, "delete", F.col("reported")))
        .unionByName(rows(known.where("not _present and reported is null"), "rescan", none))
    )


def connected_changes(journal: DataFrame, folders: DataFrame, live: DataFrame, root: str) -> DataFrame:
    """Complete changes of journal entries, ready to be lowered: with size, time and live links.

    ``live`` has one row per current link: ref, full_path, is_directory, size_bytes, mtime. An upsert
    whose path has no readable row there asks for a rescan. A resync carries all live links of its
    record inside the root, as many as the record has.
    """
    typed = journal_changes(journal, folders, root)
    readable = live.where("size_bytes is not null and mtime is not null").select(
        P.path_key(F.col("full_path")).alias("_key"), P.segment_ref(F.col("ref")).alias("_ref"), F.struct("full_path", *RECORD[1:]).alias("_live")
    )
    by_path = readable.groupBy("_key").agg(F.max_by("_live", "_ref").alias("_live"))
    none = F.lit(None)
    plain = typed.where("kind <> 'resync'").join(by_path, P.path_key(F.col("full_path")) == F.col("_key"), "left")
    unread = (F.col("kind") == "upsert") & F.col("_live").isNull()
    plain = plain.select(
        "usn", F.when(unread, "rescan").otherwise(F.col("kind")).alias("kind"), "full_path", none.cast("string").alias("old_full_path"), F.col("is_dir").alias("is_directory"),
        F.col("_live.size_bytes").alias("size_bytes"), F.col("_live.mtime").alias("mtime"), "file_reference", none.cast(LIVE_TYPE).alias("live_records"),
    )
    links = hard_link_changes(typed.where("kind = 'resync'"), live, root)
    keyed = links.where("kind = 'live'").select("usn", "file_reference", P.path_key(F.col("full_path")).alias("_key"), F.col("file_reference").alias("_ref"))
    found = keyed.join(readable, ["_key", "_ref"])
    held = found.groupBy("usn", "file_reference").agg(F.array_sort(F.collect_set("_live")).cast(LIVE_TYPE).alias("live_records"))
    others = links.where("kind <> 'live'").join(held, ["usn", "file_reference"], "left")
    empty = F.array().cast(LIVE_TYPE)
    others = others.select(
        "usn", "kind", "full_path", none.cast("string").alias("old_full_path"), F.lit(False).alias("is_directory"), none.cast("long").alias("size_bytes"),
        none.cast("timestamp").alias("mtime"), "file_reference", F.when(F.col("kind") == "resync", F.coalesce("live_records", empty)).alias("live_records"),
    )
    return plain.unionByName(others)


# --- lowering and applying a batch -------------------------------------------------------

LIVE_TYPE = "array<struct<full_path:string,is_directory:boolean,size_bytes:bigint,mtime:timestamp>>"
CHANGE_SCHEMA = (
    "usn long, kind string, full_path string, old_full_path string, is_directory boolean, "
    f"size_bytes long, mtime timestamp, file_reference long, live_records {LIVE_TYPE}"
)


def needs_rescan(changes: DataFrame) -> DataFrame:
    """One row when the batch holds a directory move, none otherwise."""
    return changes.where("kind = 'rescan'").select(F.lit(True).alias("rescan")).limit(1)


def lower_changes(changes: DataFrame, record_filter: Callable[[Column], Column] | None = None) -> DataFrame:
    """Typed changes to operations: upsert, delete and purge, ordered by (usn, seq).

    A filtered upsert becomes a delete, a rename a delete and an upsert, a resync a purge of the
    reference per volume and an upsert per live record. One directory move empties the batch.
    ``record_filter`` maps a record struct to a boolean. Each change emits its operations from
    one expression, so the batch is read once.
    """
    keep = record_filter or (lambda record: F.lit(True))
    blocked = needs_rescan(changes).select(F.lit(1).alias("_one"))
    calm = changes.withColumn("_one", F.lit(1)).join(blocked, "_one", "left_anti")

    def op(seq: int, what: Column | str, record: Column | None, volume: Column | None = None) -> Column:
        field = lambda name, kind: (F.lit(None) if record is None else record[name]).cast(kind).alias(name)
        path = F.lit(None).cast("string") if record is None else P.path_key(record["full_path"])
        return F.struct(
            F.lit(seq).alias("seq"), (F.lit(what) if isinstance(what, str) else what).alias("op"), path.alias("path_key"),
            field("full_path", "string"), field("is_directory", "boolean"), field("size_bytes", "long"), field("mtime", "timestamp"),
            (F.lit(None).cast("string") if volume is None else volume).alias("volume"),
        )

    own = F.struct(*RECORD)
    old = F.struct(F.col("old_full_path").alias("full_path"), *RECORD[1:])
    live = F.filter(F.coalesce("live_records", F.array().cast(LIVE_TYPE)), lambda r: r["full_path"].isNotNull() & keep(r))
    # a resync without any live record left purges the reference on every volume
    volumes = F.when(F.size(live) == 0, F.array(F.lit("*"))).otherwise(
        F.array_distinct(F.transform(live, lambda r: P.volume_of(r["full_path"])))
    )
    kind = F.col("kind")
    ops = (
        F.when(kind == "upsert", F.array(op(1, F.when(keep(own), "upsert").otherwise("delete"), own)))
        .when(kind == "delete", F.array(op(2, "delete", own)))
        .when((kind == "rename") & keep(own), F.array(op(0, "delete", old), op(1, "upsert", own)))
        .when(kind == "rename", F.array(op(0, "delete", old)))
        .when(
            kind == "resync",
            F.concat(F.transform(volumes, lambda v: op(0, "purge", None, v)), F.transform(live, lambda r: op(1, "upsert", r))),
        )
    )
    lowered = calm.select("usn", "file_reference", F.explode(ops).alias("o"))
    return lowered.select("usn", "o.*", "file_reference", F.lit(False).alias("subtree")).select(*OP_COLUMNS)


def touched_rows(catalog: DataFrame, ops: DataFrame) -> DataFrame:
    """Catalog rows that a batch can change: named paths, purged references, deleted subtrees.

    The catalog meets only keys of the batch, so its two narrow scans join with a small side;
    ancestors are taken only if the batch deletes a subtree.
    """
    slim = catalog.select("path_key", "file_reference")
    keys = ops.where("op <> 'purge'").select("path_key").distinct()
    references = ops.where("op = 'purge' and file_reference > 0").select("file_reference").distinct()
    hit = slim.join(keys, "path_key", "left_semi").select("path_key")
    hit = hit.union(slim.join(references, "file_reference", "left_semi").select("path_key"))
    trees = ops.where("subtree").select(F.col("path_key").alias("above")).distinct()
    if not trees.isEmpty():
        lineage = slim.select("path_key", F.explode(P.self_and_ancestors(F.col("path_key"))).alias("above"))
        hit = hit.union(lineage.join(trees, "above", "left_semi").select("path_key"))
    return catalog.join(hit.distinct(), "path_key", "left_semi")


def change_delta(catalog: DataFrame, ops: DataFrame, generation: int = 0, readings: DataFrame | None = None, mode: str = "multilingual") -> DataFrame:
    """``changed_rows``, computed once: it is read twice where it is merged."""
    return cut_lineage(changed_rows(catalog, ops, generation, readings, mode))


def changed_rows(catalog: DataFrame, ops: DataFrame, generation: int = 0, readings: DataFrame | None = None, mode: str = "multilingual") -> DataFrame:
    """What a batch of operations changes: new or changed rows, and ``removed`` ones by path key.

    Only touched rows take part. A catalog with the derived columns of ``build_catalog`` gets them
    for the changed rows too, so the result stays searchable.
    """
    ops = cut_lineage(ops)  # read in several places below, so compute the batch once
    wide = "search_text" in catalog.columns
    plain = catalog if "generation" in catalog.columns else catalog.withColumn("generation", F.lit(0).cast("long"))
    near = cut_lineage(touched_rows(plain, ops))
    fields = [*RECORD, "file_reference", "generation"]
    before = near.select("path_key", F.struct(*fields).alias("_old"))
    after = _applied(near, ops, generation).select("path_key", F.struct(*fields).alias("_new"))
    changed = before.join(after, "path_key", "full").where(~F.col("_old").eqNullSafe(F.col("_new")))
    rows = changed.select("path_key", "_new.*", F.col("_new").isNull().alias("removed"))
    if wide:
        rows = with_path_columns(rows.withColumnRenamed("path_key", "_key")).withColumn("path_key", F.col("_key")).drop("_key")
        rows = with_alias_forms(rows.withColumn("structural", F.lit(False)), readings, mode)
    return rows.select(*catalog.columns, "removed")


def with_delta(catalog: DataFrame, delta: DataFrame) -> DataFrame:
    """Catalog with a delta merged on read."""
    kept = catalog.join(delta.select("path_key"), "path_key", "left_anti").select(*catalog.columns)
    return kept.unionByName(delta.where("not removed").drop("removed"))


def apply_operations(catalog: DataFrame, ops: DataFrame, generation: int = 0) -> DataFrame:
    """Catalog after a batch of operations, as if applied one by one in (usn, seq) order.

    ``catalog`` has path_key, full_path, is_directory, size_bytes, mtime and file_reference, with
    or without generation and the derived columns of ``build_catalog``; it keeps its columns.
    """
    return with_delta(catalog, change_delta(catalog, ops, generation))


def _applied(catalog: DataFrame, ops: DataFrame, generation: int) -> DataFrame:
    """Rows of ``catalog`` after a batch of operations.

    Nothing is replayed row by row: per path the latest upsert wins unless a later delete of the
    path (or, for subtree deletes, of an ancestor) or a later purge of its reference hides it.
    Every comparison is between positions aggregated per key, so hot paths and references are
    combined on the map side.
    """
    pos = F.struct("usn", "seq")
    content = F.struct(*RECORD)
    has_ref = F.col("file_reference") > 0
    up = (
        ops.where("op = 'upsert'")
        .groupBy("path_key")
        .agg(
            F.max(pos).alias("u_pos"),
            F.max_by(content, pos).alias("u_rec"),
            F.min(content).alias("u_min"),
            F.max(content).alias("u_max"),
            F.max(F.when(has_ref, pos)).alias("r_pos"),
            F.max_by("file_reference", F.when(has_ref, pos)).alias("r_ref"),
            F.min(F.when(has_ref, F.col("file_reference"))).alias("r_min"),
            F.max("file_reference").alias("r_max"),
        )
    )
    base = catalog.select(
        "path_key", content.alias("b_rec"), F.col("file_reference").alias("b_ref"), F.col("generation").alias("b_gen")
    )
    state = base.join(up, "path_key", "full")

    deletes = ops.where("op = 'delete'")
    exact = deletes.where("not subtree").groupBy("path_key").agg(F.max(pos).alias("d_exact"))
    subtree = deletes.where("subtree").groupBy(F.col("path_key").alias("above")).agg(F.max(pos).alias("d"))
    lineage = state.select("path_key", F.explode(P.self_and_ancestors(F.col("path_key"))).alias("above"))
    below = lineage.join(subtree, "above").groupBy("path_key").agg(F.max("d").alias("d_tree"))
    state = (
        state.join(exact, "path_key", "left")
        .join(below, "path_key", "left")
        .withColumn("d_pos", F.greatest("d_exact", "d_tree"))
    )
    in_base = F.col("b_rec").isNotNull()
    ref_alive = F.col("r_pos").isNotNull() & (F.col("d_pos").isNull() | (F.col("r_pos") > F.col("d_pos")))
    state = state.withColumns(
        {
            "ref": F.when(ref_alive, F.col("r_ref"))
            .when(F.col("r_pos").isNull() & in_base & F.col("d_pos").isNull(), F.col("b_ref"))
            .otherwise(0),
            "volume": P.volume_of(F.col("path_key")),
        }
    )

    purges = ops.where("op = 'purge'").select(
        F.col("file_reference").alias("p_ref"), F.col("volume").alias("p_volume"), pos.alias("p_pos")
    ).distinct()
    last = purges.groupBy("p_ref", "p_volume").agg(F.max("p_pos").alias("p_pos"), F.count("*").alias("p_n"))

    def purged_at(df: DataFrame, ref: str, volume: Column, out: str) -> DataFrame:
        found = last.select(
            F.col("p_ref").alias("_r"), F.col("p_volume").alias("_v"), F.col("p_pos").alias(out), F.col("p_n").alias(out + "_n")
        )
        return df.join(found, (F.col(ref) == F.col("_r")) & (volume == F.col("_v")), "left").drop("_r", "_v")

    state = purged_at(state, "ref", F.col("volume"), "p_own")
    state = purged_at(state, "ref", F.lit("*"), "p_any")
    state = purged_at(state, "b_ref", F.col("volume"), "q_own")
    state = purged_at(state, "b_ref", F.lit("*"), "q_any")
    state = state.withColumn("p_pos", F.greatest("p_own", "p_any"))

    # a row whose latest upsert carries no reference loses the kept one at a purge in between
    doubtful = state.where(
        "ref > 0 and p_pos is not null and u_pos is not null and (r_pos is null or r_pos < u_pos)"
    ).select("path_key", F.col("ref").alias("_ref"), F.col("volume").alias("_volume"), "u_pos", "r_pos")
    reset = doubtful.join(
        purges,
        (F.col("_ref") == F.col("p_ref"))
        & ((F.col("p_volume") == "*") | (F.col("p_volume") == F.col("_volume")))
        & (F.col("p_pos") < F.col("u_pos"))
        & (F.col("r_pos").isNull() | (F.col("p_pos") > F.col("r_pos"))),
        "left_semi",
    ).select("path_key", F.lit(True).alias("was_reset"))
    # resyncs that listed this path as live, to tell "kept" from "removed and inserted again"
    listed = (
        ops.where("op = 'upsert'")
        .join(ops.where("op = 'purge'").select("usn", "file_reference").distinct(), ["usn", "file_reference"], "left_semi")
        .groupBy("path_key", F.col("file_reference").alias("b_ref"))
        .agg(F.count_distinct("usn").alias("live_n"))
    )
    # a path that changed its reference inside the batch: did a purge hit the one held at the time?
    same_ref = F.col("r_min").isNull() | ((F.col("r_min") == F.col("b_ref")) & (F.col("r_max") == F.col("b_ref")))
    unsure = state.where(in_base & F.col("u_pos").isNotNull() & F.col("d_pos").isNull() & ~same_ref).select(
        "path_key", "b_ref", "volume", "u_pos"
    )
    held = unsure.select("path_key", F.col("b_ref").alias("_ref"), F.struct(F.lit(-1).cast("long").alias("usn"), F.lit(0).alias("seq")).alias("_from"))
    held = held.where("_ref > 0").unionByName(
        ops.where((F.col("op") == "upsert") & has_ref)
        .join(unsure.select("path_key"), "path_key", "left_semi")
        .select("path_key", F.col("file_reference").alias("_ref"), pos.alias("_from"))
    )
    until = F.lead("_from").over(Window.partitionBy("path_key").orderBy("_from"))
    held = held.withColumn("_until", until).join(unsure.select("path_key", "volume", "u_pos"), "path_key")
    removed = held.join(
        purges,
        (F.col("_ref") == F.col("p_ref"))
        & ((F.col("p_volume") == "*") | (F.col("p_volume") == F.col("volume")))
        & (F.col("p_pos") > F.col("_from"))
        & (F.col("p_pos") < F.col("u_pos"))
        & (F.col("_until").isNull() | (F.col("p_pos.usn") < F.col("_until.usn"))),
        "left_semi",
    ).select("path_key", F.lit(True).alias("was_removed")).distinct()
    state = (
        state.join(reset, "path_key", "left")
        .join(listed, ["path_key", "b_ref"], "left")
        .join(removed, "path_key", "left")
    )

    was_reset = F.coalesce("was_reset", F.lit(False))
    newest = F.col("u_pos")
    deleted = F.col("d_pos").isNotNull() & (newest.isNull() | (F.col("d_pos") > newest))
    purged = F.col("p_pos").isNotNull() & ~was_reset & (newest.isNull() | (F.col("p_pos") > newest))
    survivors = state.where(~(deleted | purged) & (in_base | newest.isNotNull()))

    purge_count = F.coalesce("q_own_n", F.lit(0)) + F.coalesce("q_any_n", F.lit(0))
    purged_before = F.when(same_ref, purge_count > F.coalesce("live_n", F.lit(0))).otherwise(
        F.coalesce("was_removed", F.lit(False))
    )
    again = F.col("d_pos").isNotNull() | was_reset | purged_before
    untouched = newest.isNull() | (
        (F.col("u_min") == F.col("b_rec")) & (F.col("u_max") == F.col("b_rec")) & same_ref
    )
    keep_base = in_base & (newest.isNull() | ~again)
    final_gen = (
        F.when(keep_base & untouched, F.col("b_gen"))
        .when(F.lit(generation > 0), F.lit(generation))
        .when(keep_base, F.col("b_gen"))
        .otherwise(0)
    )
    record = F.coalesce("u_rec", "b_rec")
    return survivors.select(
        "path_key",
        *[record[f].alias(f) for f in RECORD],
        F.when(was_reset, 0).otherwise(F.col("ref")).cast("long").alias("file_reference"),
        final_gen.cast("long").alias("generation"),
    )


def latest_state(ops: DataFrame) -> DataFrame:
    """Record or tombstone per path after a batch of upserts and exact deletes."""
    pos = F.struct("usn", "seq")
    fields = F.struct("op", *RECORD, "file_reference")
    latest = ops.where("op in ('upsert', 'delete')").groupBy("path_key").agg(F.max_by(fields, pos).alias("r"))
    return latest.select("path_key", (F.col("r.op") == "upsert").alias("is_live"), "r.*").drop("op")


def resync_links(catalog: DataFrame, live: DataFrame) -> DataFrame:
    """Replace all names of the resynced references by their live records.

    ``live`` has one row per resync and live record; a null path marks an empty set. Purging is
    limited to the volumes of the live records; an empty set purges every volume.
    """
    present = live.where("full_path is not null")
    scope = present.select("file_reference", P.volume_of(F.col("full_path")).alias("volume")).distinct()
    empty = (
        live.select("file_reference").distinct()
        .join(present.select("file_reference").distinct(), "file_reference", "left_anti")
    )
    stamped = catalog.withColumn("volume", P.volume_of(F.col("full_path")))
    kept = (
        stamped.join(scope, ["file_reference", "volume"], "left_anti")
        .join(empty, "file_reference", "left_anti")
        .drop("volume")
    )
    new_keys = present.select("path_key").distinct()
    columns = catalog.columns
    return kept.join(new_keys, "path_key", "left_anti").select(*columns).unionByName(
        present.dropDuplicates(["path_key"]).select(*columns)
    )


# --- checkpoints -------------------------------------------------------------------------

def catch_up_plan(journals: DataFrame, checkpoints: DataFrame, rules_version: int) -> DataFrame:
    """'none', 'read' or 'rescan' per root with the range to read.

    ``journals``: root, journal_id, lowest_valid_usn, next_usn. ``checkpoints``: root,
    journal_id, next_usn, rules_version.
    """
    c = checkpoints.select(
        F.col("root").alias("_root"), F.col("journal_id").alias("_id"),
        F.col("next_usn").alias("_next"), F.col("rules_version").alias("_rules"),
    )
    joined = journals.join(c, F.col("root") == F.col("_root"), "left")
    usable = (
        F.col("_root").isNotNull()
        & (F.col("_id") == F.col("journal_id"))
        & (F.col("_rules") == rules_version)
        & (F.col("_next") >= F.col("lowest_valid_usn"))
        & (F.col("_next") <= F.col("next_usn"))
    )
    action = F.when(~F.coalesce(usable, F.lit(False)), "rescan").when(F.col("_next") >= F.col("next_usn"), "none").otherwise("read")
    start = F.when(action == "rescan", 0).when(action == "none", F.col("next_usn")).otherwise(F.col("_next"))
    return joined.select("root", action.alias("action"), start.cast("long").alias("start_usn"), F.col("next_usn").alias("end_usn"))


def scan_outcome(states: DataFrame) -> DataFrame:
    """'prune' (complete: prune and checkpoint), 'retain' (keep stale rows) or 'fallback'.

    ``states``: root, pre_id, pre_usn, post_id, post_usn, replay_rescan, scanned.
    """
    proved = (
        (F.col("pre_id") == F.col("post_id"))
        & (F.col("post_usn") >= F.col("pre_usn"))
        & ((F.col("post_usn") == F.col("pre_usn")) | ~F.col("replay_rescan"))
    )
    outcome = F.when(F.coalesce(proved, F.lit(False)), "prune").when(F.col("scanned") > 0, "retain").otherwise("fallback")
    return states.select("root", outcome.alias("outcome"))


def range_progress(journal: DataFrame, end: int) -> DataFrame:
    """How far a range was read; gaps inside are normal because positions are byte offsets."""
    reached = F.coalesce(F.max("next_usn"), F.lit(0))
    return journal.agg(reached.alias("reached"), F.lit(end).cast("long").alias("wanted"), (reached >= end).alias("complete"))


def require_complete(progress: DataFrame) -> DataFrame:
    """Fail the job when a journal range ended early."""
    return progress.withColumn(
        "complete", F.when(F.col("complete"), True).otherwise(F.raise_error(F.lit("journal range incomplete")))
    )


def reconciliation_requests(hints: DataFrame, roots: DataFrame) -> DataFrame:
    """One request per root that reported an overflow or error (kind 'lost')."""
    from pathmere.operators.catalog import top_roots

    lost = hints.where("kind = 'lost'").select(F.explode(P.self_and_ancestors(F.lower("full_path"))).alias("root_key"))
    return top_roots(roots).join(lost, "root_key", "left_semi")


# --- live hints --------------------------------------------------------------------------

def hint_effects(hints: DataFrame) -> DataFrame:
    """One row per touched path and hint: 'delete', 'deep' (refresh recursively) or 'refresh'."""
    kind = F.col("kind")
    effect = F.when(kind == "deleted", "delete").when(kind.isin("created", "renamed"), "deep").when(kind == "changed", "refresh")
    main = hints.select("*", effect.alias("effect")).where("effect is not null")
    old = hints.where("kind = 'renamed' and trim(coalesce(old_full_path, '')) <> ''").withColumn(
        "full_path", F.col("old_full_path")
    ).withColumn("effect", F.lit("delete"))
    return main.unionByName(old)


def pending_action(last_delete: Column, last_deep: Column, last_refresh: Column) -> Column:
    """State of a path after its hints, from the latest position of each effect.

    The fold over arrival order has a closed form: a recursive refresh survives everything but
    a later delete, a plain refresh only overrides a delete.
    """
    deep_wins = last_deep.isNotNull() & (last_delete.isNull() | (last_deep >= last_delete))
    refreshed = last_refresh.isNotNull() & (last_delete.isNull() | (last_refresh > last_delete))
    return F.when(deep_wins, "refresh_recursive").when(refreshed, "refresh").otherwise("delete")


def coalesce_hints(hints: DataFrame) -> DataFrame:
    """Pending action per path, ignoring case and named as last seen; three maxima replace the ordered fold, so no path is buffered."""
    latest = lambda effect: F.max(F.when(F.col("effect") == effect, F.col("seq")))
    keyed = hint_effects(hints).withColumn("_key", P.path_key(F.col("full_path")))
    folded = keyed.groupBy("_key").agg(
        F.max_by("full_path", F.struct("seq", "full_path")).alias("full_path"), latest("delete").alias("d"), latest("deep").alias("r"), latest("refresh").alias("c"), F.count("*").alias("hints")
    )
    return folded.withColumn("action", pending_action(F.col("d"), F.col("r"), F.col("c"))).drop("_key", "d", "r", "c")


def verify_deletes(pending: DataFrame, listing: DataFrame, unknown: DataFrame | None = None) -> DataFrame:
    """Deletes of paths that still exist become refreshes; unknown existence is skipped.

    ``listing``: full_path, is_directory of what exists now. ``unknown``: paths whose existence
    could not be checked.
    """
    now = listing.select(P.path_key(F.col("full_path")).alias("_key"), F.col("is_directory").alias("_dir")).dropDuplicates(["_key"])
    out = pending.join(now, P.path_key(F.col("full_path")) == F.col("_key"), "left")
    is_delete = F.col("action") == "delete"
    fixed = (
        F.when(is_delete & F.col("_dir"), "refresh_recursive")
        .when(is_delete & F.col("_dir").isNotNull(), "refresh")
        .otherwise(F.col("action"))
    )
    out = out.withColumn("action", fixed).drop("_key", "_dir")
    if unknown is not None:
        keys = unknown.select(P.path_key(F.col("full_path")).alias("_key")).distinct()
        out = out.join(keys, P.path_key(F.col("full_path")) == F.col("_key"), "left_anti")
    return out


def in_scope(path: Column, roots: Sequence[str], exclusions: Sequence[str] = ()) -> Column:
    """Below a watched root and not excluded, for short configured lists."""
    below = F.lit(False)
    for root in roots:
        below = below | P.under_root(P.path_key(path), F.lit(root))
    return F.coalesce(below & not_excluded(exclusions, path), F.lit(False))


def observed(hints: DataFrame, roots: Sequence[str], exclusions: Sequence[str] = ()) -> DataFrame:
    """Hints to look at: a rename counts when either end is in scope."""
    return hints.where(
        in_scope(F.col("full_path"), roots, exclusions) | in_scope(F.col("old_full_path"), roots, exclusions)
    )


def drop_superseded(queries: DataFrame, gap_seconds: float) -> DataFrame:
    """Requests not replaced by a newer one of the same session within the gap.

    Time is cut into buckets of one gap. The next request within a gap lies in the same or the
    following bucket, so each row needs two per-bucket extremes instead of an ordered session.
    """
    gap = int(gap_seconds * 1_000_000)
    at = F.unix_micros("ts")
    rows = queries.withColumn("_at", at).withColumn("_bucket", F.floor(F.col("_at") / gap).cast("long"))
    extremes = rows.groupBy("session_id", "_bucket").agg(
        F.max(F.struct("_at", "seq")).alias("_last"), F.min("_at").alias("_first")
    )
    same = extremes.select("session_id", "_bucket", "_last")
    following = extremes.select("session_id", (F.col("_bucket") - 1).alias("_bucket"), "_first")
    joined = rows.join(same, ["session_id", "_bucket"]).join(following, ["session_id", "_bucket"], "left")
    newer_here = F.struct("_at", "seq") < F.col("_last")
    newer_next = F.coalesce(F.col("_first") - F.col("_at") < gap, F.lit(False))
    return joined.where(~(newer_here | newer_next)).select(*queries.columns)
