"""Queries for hierarchies, merges, change data and streams."""

from pyspark.sql import functions as F

from pathmere.operators import changes as C
from pathmere.operators import hierarchy as H
from pathmere.operators import reconcile as M
from pathmere.operators import search as R
from pathmere.plans import views as V
from pathmere.plans.registry import query
from pathmere.plans.views import sql_with
from pathmere.session import scratch_path, use_utc
from pathmere.sources import catalog_log, records, snapshots
from pathmere.streaming import jobs

c = F.col

# --- hierarchy --------------------------------------------------------------------------

_TREE = """select id, '' full_path from nodes where id = parent_id
union all select n.id, t.full_path||'/'||n.name from nodes n join tree t on n.parent_id = t.id where n.id <> n.parent_id"""


def _tree_sql(body):
    prefix = sql_with("select * from nodes").rsplit("\nselect", 1)[0].replace("with ", "with recursive ", 1)
    return f"{prefix},\ntree as ({_TREE})\n{body}"


@query(_tree_sql("select id, full_path from tree"))
def resolved_paths(spark, sf):
    return H.resolve_paths(V.nodes(spark, sf)).select("id", "full_path")


@query(_tree_sql("select id, full_path from tree"))
def resolved_broken_tree(spark, sf):
    """The tree with two-node cycles, their children and orphans mixed in: only the tree comes out."""
    nodes = V.nodes(spark, sf)
    shift = F.lit(1_000_000_000).cast("long")
    cycles = nodes.withColumns({"parent_id": c("id") + shift * 2, "id": c("id") + shift})
    back = nodes.withColumns({"parent_id": c("id") + shift, "id": c("id") + shift * 2})
    below = nodes.withColumns({"parent_id": c("id") + shift, "id": c("id") + shift * 3})
    orphans = nodes.withColumns({"parent_id": c("id") + shift * 9, "id": c("id") + shift * 4})
    blank = nodes.withColumns({"name": F.lit("  "), "parent_id": c("id"), "id": c("id") + shift * 5})
    mixed = nodes.unionByName(cycles).unionByName(back).unionByName(below).unionByName(orphans).unionByName(blank)
    return H.resolve_paths(mixed).select("id", "full_path")


@query(sql_with("""
select c.path_key, p.full_path parent_full_path, coalesce(p.file_reference, -1) parent_reference
from catalog c left join catalog p on c.parent_key = p.path_key"""))
def row_with_parent(spark, sf):
    rows = H.with_parent_row(V.catalog(spark, sf))
    return rows.select("path_key", "parent_full_path", F.coalesce("parent_reference", F.lit(-1)).alias("parent_reference"))


@query(sql_with("select path_key from catalog where parent_key in (select path_key from pinned)"))
def children_of_folders(spark, sf):
    return H.children_of(V.catalog(spark, sf), V.pinned(spark, sf)).select("path_key")


@query(sql_with("""
select parent_key, count(*) children, count_if(not is_directory) files, min(path_key) first_child, max(path_key) last_child
from catalog group by 1"""))
def child_counts(spark, sf):
    return H.child_counts(V.catalog(spark, sf))


@query(sql_with("select parent_key, path_key from catalog"))
def child_list(spark, sf):
    return H.child_list(V.catalog(spark, sf)).select("parent_key", "path_key")


@query(sql_with("select ref, parent, name, namespace from all_names"))
def collected_link_names(spark, sf):
    return H.collect_names(V.links(spark, sf))


@query(_tree_sql("""select a.ref, t.full_path||'/'||a.name full_path from all_names a join tree t on a.parent = t.id
where case when exists (select 1 from all_names k where k.ref = a.ref and k.namespace in ('win32', 'win32_and_dos'))
  then a.namespace in ('win32', 'win32_and_dos') else a.namespace <> 'dos' end""").replace(
    "tree as (", f"link_names as ({V.VIEWS['link_names']}), all_names as ({V.VIEWS['all_names']}), tree as ("))
def hard_link_paths(spark, sf):
    folders = H.resolve_directories(V.nodes(spark, sf))
    names = H.indexable_names(H.collect_names(V.links(spark, sf)))
    return H.link_paths(names, folders).select("ref", "full_path")


@query(sql_with("select ref, max(usn) usn, arg_max(name, usn) as name, arg_max(reason, usn) reason from journal group by 1"))
def last_entries(spark, sf):
    return H.last_entry_per_reference(V.journal(spark, sf)).select("ref", "usn", "name", "reason")


# --- merges -----------------------------------------------------------------------------

_MERGED = """
select coalesce(o.path_key, n.path_key) path_key,
  case when o.path_key is null then 'inserted' when n.path_key is null then 'kept'
    when o.size_bytes <> n.size_bytes or o.mtime <> n.mtime or (n.file_reference > 0 and n.file_reference <> o.file_reference) then 'updated'
    else 'unchanged' end merge_action,
  o.size_bytes old_size, n.size_bytes new_size, o.generation old_gen, n.generation new_gen, o.file_reference old_ref, n.file_reference new_ref
from snap_old o full join snap_new n on o.path_key = n.path_key"""


@query(sql_with("""
select path_key, merge_action, case when merge_action in ('inserted', 'updated') then new_size else old_size end size_bytes,
  case when merge_action in ('inserted', 'updated') and new_gen > 0 then new_gen else coalesce(old_gen, 0) end generation,
  case when merge_action in ('inserted', 'updated') and new_ref > 0 then new_ref else coalesce(old_ref, 0) end file_reference
from merged""", merged=_MERGED))
def upsert_merge(spark, sf):
    merged = M.upsert_merge(V.snap_old(spark, sf), V.snap_new(spark, sf))
    return merged.select("path_key", "merge_action", "size_bytes", "generation", "file_reference")


_CLASSES = """
select n.path_key, case when n.file_reference > 0 then case when coalesce(o.size_bytes = n.size_bytes and o.mtime = n.mtime
      and o.file_reference = n.file_reference, false) then 'by_reference' else 'upsert' end
    when coalesce(o.size_bytes = n.size_bytes and o.mtime = n.mtime, false) then 'by_path' else 'upsert' end reconcile_class
from snap_new n left join snap_old o on o.path_key = n.path_key"""


@query(sql_with(_CLASSES))
def reconcile_classes(spark, sf):
    return M.reconcile_rows(V.snap_old(spark, sf), V.snap_new(spark, sf)).select("path_key", "reconcile_class")


@query(sql_with("select reconcile_class, count(*) n from classes group by 1", classes=_CLASSES))
def reconcile_counts(spark, sf):
    return M.reconcile_counts(M.reconcile_rows(V.snap_old(spark, sf), V.snap_new(spark, sf)))


@query(sql_with("""
select path_key, case when merge_action in ('inserted', 'updated', 'unchanged') then 2 else old_gen end generation from merged""", merged=_MERGED))
def full_scan_generations(spark, sf):
    return M.touch_and_merge(V.snap_old(spark, sf), V.snap_new(spark, sf), 2).select("path_key", "generation")


@query(sql_with("""
select path_key from catalog where not regexp_matches(path_key||'/', '^/(docs/fr|parts/promo|customers/asia|missing)/')"""))
def delete_subtrees(spark, sf):
    deleted = R.pinned_keys(V.pinned(spark, sf))
    nested = deleted.unionByName(deleted.withColumn("path_key", F.concat("path_key", F.lit("/src1"))))
    return M.delete_subtrees(V.catalog(spark, sf), nested).select("path_key")


_DIFF = """
select coalesce(n.path_key, o.path_key) path_key,
  case when o.path_key is null then 'added' when n.path_key is null then 'removed'
    when o.size_bytes <> n.size_bytes or o.mtime <> n.mtime or o.file_reference <> n.file_reference then 'changed' else 'unchanged' end status,
  coalesce(o.size_bytes <> n.size_bytes, false) size_bytes_changed, coalesce(o.mtime <> n.mtime, false) mtime_changed,
  coalesce(o.file_reference <> n.file_reference, false) file_reference_changed
from snap_old o full join snap_new n on o.path_key = n.path_key"""
_DIFF_FIELDS = ["size_bytes", "mtime", "file_reference"]


def _diff(spark, sf):
    return M.diff_snapshots(V.snap_old(spark, sf), V.snap_new(spark, sf), _DIFF_FIELDS)


@query(sql_with(_DIFF))
def snapshot_diff(spark, sf):
    return _diff(spark, sf)


@query(sql_with("""
select count_if(status = 'added') added, count_if(status = 'removed') removed, count_if(status = 'changed') changed,
  count_if(status = 'unchanged') unchanged, count_if(size_bytes_changed) size_bytes_changed, count_if(mtime_changed) mtime_changed,
  count_if(file_reference_changed) file_reference_changed from diff""", diff=_DIFF))
def snapshot_diff_summary(spark, sf):
    return M.diff_summary(_diff(spark, sf))


@query(sql_with("select path_key, status from diff where status <> 'unchanged' order by path_key limit 12", diff=_DIFF))
def snapshot_diff_samples(spark, sf):
    return M.diff_samples(_diff(spark, sf), 12).select("path_key", "status")


def _staged(spark, sf, folder="/orders"):
    return V.snap_new(spark, sf).where(c("path_key").startswith(folder + "/"))


@query(sql_with("""
select path_key, generation from snap_old where path_key not like '/orders/7/%'
union all select path_key, generation from snap_new where path_key like '/orders/7/%'"""))
def replace_root(spark, sf):
    return M.replace_root(V.snap_old(spark, sf), "/orders/7", _staged(spark, sf, "/orders/7")).select("path_key", "generation")


@query(sql_with("""
select path_key, case when merge_action in ('inserted', 'updated') then new_size else old_size end size_bytes,
  case when merge_action in ('inserted', 'updated') then new_gen else old_gen end generation from merged""", merged=_MERGED))
def merge_root_keeping_stale(spark, sf):
    return M.merge_root(V.snap_old(spark, sf), "/orders", _staged(spark, sf)).select("path_key", "size_bytes", "generation")


@query(sql_with("""
select path_key from merged where not (case when merge_action = 'kept' then old_gen else 2 end <> 2 and path_key like '/orders/1/%')""", merged=_MERGED))
def prune_stale(spark, sf):
    scanned = M.touch_and_merge(V.snap_old(spark, sf), V.snap_new(spark, sf), 2)
    return M.prune_stale(scanned, "/orders/1", 2).select("path_key")


@query(sql_with("""
select o.n left_n, w.n right_n, o.t left_total, w.t right_total, (o.n, o.t, o.lo, o.hi) = (w.n, w.t, w.lo, w.hi) agree
from (select count(*) n, sum(size_bytes)::bigint t, min(size_bytes) lo, max(size_bytes) hi from snap_old) o,
  (select count(*) n, sum(size_bytes)::bigint t, min(size_bytes) lo, max(size_bytes) hi from snap_new) w"""))
def checksum_guard(spark, sf):
    return M.checksums_agree(V.snap_old(spark, sf), V.snap_new(spark, sf))


# --- change data ------------------------------------------------------------------------

_KIND = """
select *, case
  when is_dir and (reason & 12800) <> 0 then 'rescan'
  when not is_dir and (reason & 4096) <> 0 and (reason & 2147491840) <> 0 then 'rescan'
  when not is_dir and (reason & 65536) <> 0 then 'resync'
  when full_path is null then 'rescan'
  when not (lower(full_path) = '/vol' or lower(full_path) like '/vol/%') then null
  when (reason & 4608) <> 0 then 'delete'
  when (reason & 41335) <> 0 then 'upsert' end kind
from (select j.*, f.full_path||'/'||j.name full_path from journal j left join journal_folders f on f.id = j.parent_ref)"""


@query(sql_with("select usn, kind, full_path, ref file_reference from kinds where kind is not null", kinds=_KIND))
def journal_changes(spark, sf):
    typed = C.journal_changes(V.journal(spark, sf), V.journal_folders(spark, sf), "/vol")
    return typed.select("usn", "kind", "full_path", "file_reference")


def _live_links(spark, sf):
    """Current links: every journal reference below 100 has two names, one of them outside."""
    part = V.table(spark, sf, "part")
    two = F.array(F.concat(F.lit("/vol/"), "p_name"), F.concat(F.lit("/vol/x-"), "p_partkey"), F.concat(F.lit("/out/"), "p_name"))
    return part.where("p_size < 25").select(c("p_partkey").alias("ref"), F.explode(two).alias("full_path"))


_LIVE = """
select p_partkey ref, unnest(['/vol/'||p_name, '/vol/x-'||p_partkey, '/out/'||p_name]) full_path from part where p_size < 25"""


@query(sql_with("""
select usn, 'resync' kind, ref file_reference, null full_path from e where present or inside
union all select usn, 'live', e.ref, l.full_path from e join live l on l.ref = e.ref where lower(l.full_path) like '/vol/%'
union all select usn, 'delete', ref, full_path from e where inside
  and not exists (select 1 from live l where l.ref = e.ref and lower(l.full_path) = lower(e.full_path))
union all select usn, 'rescan', ref, null from e where not present and full_path is null""",
                kinds=_KIND, live=_LIVE, e="""
select usn, ref, full_path, exists (select 1 from live l where l.ref = k.ref) present,
  coalesce(lower(full_path) like '/vol/%', false) inside from kinds k where kind = 'resync'"""))
def hard_link_changes(spark, sf):
    typed = C.journal_changes(V.journal(spark, sf), V.journal_folders(spark, sf), "/vol")
    return C.hard_link_changes(typed.where("kind = 'resync'"), _live_links(spark, sf), "/vol")


_OPS = """
select event_id usn, 1 seq, 'upsert' op, path, case when event_type = 'click' then 0 else user_id + 1 end ref, null volume, sz, ts
  from ev where event_type in ('signup', 'click', 'purchase')
union all select event_id, 0, 'delete', other, user_id + 1, null, sz, ts from ev where event_type = 'purchase'
union all select event_id, 2, 'delete', path, user_id + 1, null, sz, ts from ev where event_type = 'error'
union all select event_id, 0, 'purge', null, user_id + 1, unnest(['/u', '/links']), null, null from ev where event_type = 'view' and value > 40
union all select event_id, 1, 'upsert', unnest([path, link]), user_id + 1, null, sz, ts from ev where event_type = 'view' and value > 40"""
_EV = """
select *, cast(round(value * 100) as bigint) sz, '/u/'||(user_id % 10)||'/'||user_id||'.txt' path,
  '/u/'||(user_id % 10)||'/'||user_id||'-old.txt' other, '/links/'||user_id||'.txt' link from events"""
_BASE = """
select '/u/'||(c_custkey % 10)||'/'||c_custkey||'-old.txt' path, cast(round(abs(c_acctbal) * 100) as bigint) sz, c_custkey + 1 ref from customer"""


@query(sql_with("select usn, seq, op, path path_key, volume, case when op = 'upsert' then sz else -1 end size_bytes, ref file_reference from ops",
                ev=_EV, ops=_OPS))
def lowered_changes(spark, sf):
    ops = C.lower_changes(V.changes(spark, sf))
    size = F.when(c("op") == "upsert", c("size_bytes")).otherwise(-1)
    return ops.select("usn", "seq", "op", "path_key", "volume", size.alias("size_bytes"), "file_reference")


_REPLAYED = """
select path path_key, sz size_bytes, ref file_reference, gen generation from (
  select l.path, l.sz, coalesce((select arg_max(u.ref, u.pos) from ups u where u.path = l.path and u.ref > 0
      and not exists (select 1 from ops d where d.op = 'delete' and d.path = l.path and row(d.usn, d.seq) > u.pos)), 0) ref,
    l.gen, l.pos
  from (select path, arg_max(sz, pos) sz, arg_max(gen, pos) gen, max(pos) pos from ups group by path) l
  where not exists (select 1 from ops d where d.op = 'delete' and d.path = l.path and row(d.usn, d.seq) > l.pos))
r where not exists (select 1 from ops p where p.op = 'purge' and p.ref = r.ref and p.volume = regexp_extract(r.path, '^/[^/]*') and row(p.usn, p.seq) > r.pos)"""
_UPS = """
select path, sz, ref, row(usn::bigint, seq::int) pos, 7 gen from ops where op = 'upsert'
union all select path, sz, ref, row(-1::bigint, 0::int), 1 from base"""
_REPLAY_VIEWS = {"ev": _EV, "ops": _OPS, "base": _BASE, "ups": _UPS}


@query(sql_with(_REPLAYED, **_REPLAY_VIEWS))
def applied_changes(spark, sf):
    ops = C.lower_changes(V.changes(spark, sf))
    final = C.apply_operations(V.replay_base(spark, sf), ops, generation=7)
    return final.select("path_key", "size_bytes", "file_reference", "generation")


@query(sql_with("""
select path path_key, arg_max(op, row(usn, seq)) = 'upsert' is_live, arg_max(case when op = 'upsert' then sz else -1 end, row(usn, seq)) size_bytes
from ops where op <> 'purge' group by 1""", ev=_EV, ops=_OPS))
def latest_states(spark, sf):
    states = C.latest_state(C.lower_changes(V.changes(spark, sf)))
    return states.select("path_key", "is_live", F.when(c("is_live"), c("size_bytes")).otherwise(-1).alias("size_bytes"))


@query(sql_with("""
select volume, count_if(live) live, count_if(not live) tombstones, count_if(not live) / count(*) tombstone_ratio from (
  select path, regexp_extract(path, '^/[^/]*') volume, arg_max(op, row(usn, seq)) = 'upsert' live from ops where op <> 'purge' group by 1) group by 1""",
                ev=_EV, ops=_OPS))
def catalog_stats(spark, sf):
    return M.catalog_stats(C.latest_state(C.lower_changes(V.changes(spark, sf))))


_RESYNC_LIVE = """
select user_id + 1 ref, arg_max(value, event_id) > 60 full_set, '/links/'||user_id||'.txt' link,
  '/u/'||(user_id % 10)||'/'||user_id||'.txt' path from events where event_type = 'view' and value > 40 group by user_id"""


@query(sql_with("""
select path path_key, ref file_reference from base where not exists (select 1 from live l where l.ref = base.ref)
union all select link, ref from live where full_set union all select path, ref from live where full_set""", live=_RESYNC_LIVE, base=_BASE))
def resynced_links(spark, sf):
    """Latest resync per reference: two live names, or an empty set that removes every name."""
    e = V.table(spark, sf, "events").where("event_type = 'view' and value > 40")
    last = e.groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"))
    user = c("user_id")
    names = F.array(
        F.concat(F.lit("/links/"), user, F.lit(".txt")),
        F.concat(F.lit("/u/"), (user % 10).cast("string"), F.lit("/"), user, F.lit(".txt")),
    )
    paths = F.when(c("value") > 60, names).otherwise(F.array(F.lit(None).cast("string")))
    live = last.select((user + 1).alias("file_reference"), F.explode(paths).alias("full_path")).select(
        c("full_path").alias("path_key"), "full_path", F.lit(False).alias("is_directory"), F.lit(0).cast("long").alias("size_bytes"),
        F.lit("2024-02-01").cast("timestamp").alias("mtime"), "file_reference", F.lit(7).cast("long").alias("generation"),
    )
    return C.resync_links(V.replay_base(spark, sf), live).select("path_key", "file_reference")


@query("""
select c_name as root, case when c_nationkey = 3 then 'rescan' when c_nationkey = 4 then 'rescan' when c_nationkey % 7 = 5 then 'rescan'
    when p < 1000 then 'rescan' when p > 8000 then 'rescan' when p = 8000 then 'none' else 'read' end "action",
  case when c_nationkey in (3, 4) or c_nationkey % 7 = 5 or p < 1000 or p > 8000 then 0 else p end start_usn, 8000 end_usn
from (select *, cast(floor(c_acctbal) as bigint) p from customer)""")
def catch_up_plan(spark, sf):
    """One root per customer: missing checkpoint, other journal, other rules, outside or inside the bounds."""
    roots = V.table(spark, sf, "customer").withColumn("p", F.floor("c_acctbal").cast("long"))
    journals = roots.select(
        c("c_name").alias("root"), F.lit(77).alias("journal_id"), F.lit(1000).cast("long").alias("lowest_valid_usn"),
        F.lit(8000).cast("long").alias("next_usn"),
    )
    checkpoints = roots.where("c_nationkey <> 3").select(
        c("c_name").alias("root"), F.when(c("c_nationkey") == 4, 78).otherwise(77).alias("journal_id"), c("p").alias("next_usn"),
        F.when(c("c_nationkey") % 7 == 5, 1).otherwise(2).alias("rules_version"),
    )
    return C.catch_up_plan(journals, checkpoints, rules_version=2)


@query("""
select c_name as root, case when c_nationkey <> 4 and c_acctbal >= 0 and (c_acctbal < 1 or c_mktsegment <> 'BUILDING') then 'prune'
  when c_custkey % 2 > 0 then 'retain' else 'fallback' end outcome from customer""")
def scan_outcomes(spark, sf):
    states = V.table(spark, sf, "customer").select(
        c("c_name").alias("root"), F.lit(77).alias("pre_id"), F.lit(0).alias("pre_usn"),
        F.when(c("c_nationkey") == 4, 78).otherwise(77).alias("post_id"), F.floor("c_acctbal").alias("post_usn"),
        (c("c_mktsegment") == "BUILDING").alias("replay_rescan"), (c("c_custkey") % 2).alias("scanned"),
    )
    return C.scan_outcome(states)


@query(sql_with("select max(usn) + 1 reached, 1000000 wanted, max(usn) + 1 >= 1000000 complete from journal"))
def journal_progress(spark, sf):
    return C.range_progress(V.journal(spark, sf).withColumn("next_usn", c("usn") + 1), 1_000_000)


_EFFECTS = """
select full_path, seq, case kind when 'deleted' then 'delete' when 'changed' then 'refresh' else 'deep' end effect from hints
union all select old_full_path, seq, 'delete' from hints where old_full_path is not null"""
_FOLD = """
select full_path, count(*) hints, list_reduce(list(effect order by seq, effect), lambda a, x: case
  when x = 'delete' then 'delete' when x = 'deep' then 'deep' when a = 'deep' then 'deep' else 'refresh' end, 'start') state
from effects group by 1"""


@query(sql_with("""
select full_path, hints, case state when 'deep' then 'refresh_recursive' else state end "action" from fold""", effects=_EFFECTS, fold=_FOLD))
def coalesced_hints(spark, sf):
    return C.coalesce_hints(V.hints(spark, sf))


@query(sql_with("""
select full_path, case when state = 'deep' then 'refresh_recursive' when state = 'refresh' then 'refresh'
  when u is null then 'delete' when d then 'refresh_recursive' else 'refresh' end "action"
from fold left join (select '/u/'||(c_custkey % 10)||'/'||c_custkey u, c_acctbal > 5000 d from customer where c_acctbal > 2000) on full_path = u
where not exists (select 1 from customer where '/u/'||(c_custkey % 10)||'/'||c_custkey = full_path and c_acctbal < 0)""",
                effects=_EFFECTS, fold=_FOLD))
def verified_deletes(spark, sf):
    """Deletes checked against what exists now (customers above a balance)."""
    customer = V.table(spark, sf, "customer")
    key = c("c_custkey")
    path = F.concat(F.lit("/u/"), (key % 10).cast("string"), F.lit("/"), key.cast("string")).alias("full_path")
    listing = customer.where("c_acctbal > 2000").select(path, (c("c_acctbal") > 5000).alias("is_directory"))
    unknown = customer.where("c_acctbal < 0").select(path)
    return C.verify_deletes(C.coalesce_hints(V.hints(spark, sf)), listing, unknown).select("full_path", "action")


@query(sql_with("""
select seq from hints where regexp_matches(full_path, '^/u/[12]/') and not regexp_matches(full_path||'/', '/(22|31)/')
  or coalesce(regexp_matches(old_full_path, '^/u/[12]/') and not regexp_matches(old_full_path||'/', '/(22|31)/'), false)"""))
def hints_in_scope(spark, sf):
    return C.observed(V.hints(spark, sf), ["/u/1", "/u/2"], ["22", "31", "*.tmp", "/u/1/x"]).select("seq")


@query(sql_with("select distinct root_key from roots where root_key in ('/docs', '/parts') "))
def reconciliation_requests(spark, sf):
    lost = V.catalog(spark, sf).where(c("path_key").rlike("^/(docs|parts)/")).select(F.lit("lost").alias("kind"), "full_path")
    return C.reconciliation_requests(lost, V.roots(spark, sf)).select("root_key")


_KEPT = """
select user_id session_id, event_id seq, ts from events
qualify coalesce(epoch_us(lead(ts) over (partition by user_id order by ts, event_id)) - epoch_us(ts) >= 1800000000, true)"""


@query(sql_with("select session_id, seq from kept", kept=_KEPT))
def superseded_queries(spark, sf):
    return C.drop_superseded(V.query_log(spark, sf), 1800).select("session_id", "seq")


@query("""
select lower('/docs/'||lang||'/'||source||'/moved-'||doc_id||'.txt') path_key, 'moved-'||doc_id||'.txt' as name, n_chars size_bytes from documents where doc_id % 10 = 1""")
def search_after_changes(spark, sf):
    """A search on the catalog log after a batch that moves a tenth of the documents and deletes another."""
    catalog, doc = V.catalog(spark, sf), c("path_key").startswith("/docs/") & ~c("is_directory")
    docs = catalog.where(doc).withColumn("doc_id", c("file_reference") - 1)
    moved = F.regexp_replace("full_path", "/doc-", "/moved-")
    nothing = F.lit(None)
    rename = docs.where("doc_id % 10 = 1").select(
        c("doc_id").alias("usn"), F.lit("rename").alias("kind"), moved.alias("full_path"), c("full_path").alias("old_full_path"),
        "is_directory", "size_bytes", "mtime", "file_reference", nothing.cast(C.LIVE_TYPE).alias("live_records"),
    )
    delete = docs.where("doc_id % 10 = 2").select(
        c("doc_id").alias("usn"), F.lit("delete").alias("kind"), "full_path", nothing.cast("string").alias("old_full_path"),
        "is_directory", "size_bytes", "mtime", "file_reference", nothing.cast(C.LIVE_TYPE).alias("live_records"),
    )
    folder = scratch_path(spark, "searched-log")
    catalog_log.publish(catalog, folder, buckets=16)
    catalog_log.apply(C.lower_changes(rename.unionByName(delete)), folder)
    after = catalog_log.read(spark, folder)
    request = R.SearchRequest(terms=["moved"], include_ext=["txt"], limit=1_000_000)
    return R.search(after, request).select("path_key", "name", "size_bytes")


# --- sources and sinks ------------------------------------------------------------------

@query("""
select case when event_type in ('signup', 'click') then 'upsert' when event_type = 'purchase' then 'rename' when event_type = 'error' then 'delete'
  else 'resync' end kind, count(*) n, sum(cast(round(value * 100) as bigint))::bigint total from events where event_type <> 'view' or value > 40 group by 1""")
def changes_from_files(spark, sf):
    """Changes written as JSON lines and read back with the fixed schema."""
    path = scratch_path(use_utc(spark), "changes")
    records.write_changes(V.changes(spark, sf), path)
    back = records.read_changes(spark, path)
    return back.groupBy("kind").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("total"))


@query(sql_with("select event_id::varchar id, operation, outcome, total_ms, k \"read\", k::bigint candidates from metrics"))
def metrics_from_files(spark, sf):
    path = scratch_path(use_utc(spark), "metrics")
    records.write_metrics(V.metrics(spark, sf), path)
    back = records.read_metrics(spark, path)
    return back.select("id", "operation", "outcome", "total_ms", c("stages")["read"].alias("read"), c("counters")["candidates"].alias("candidates"))


@query(sql_with("select path_key, size_bytes, generation from snap_new"))
def published_snapshot(spark, sf):
    """Two published generations; the newest one is read."""
    folder = scratch_path(use_utc(spark), "store")
    snapshots.save_snapshot(V.snap_old(spark, sf), folder, 1)
    snapshots.save_snapshot(V.snap_new(spark, sf), folder, 2)
    return snapshots.load_snapshot(spark, folder).select("path_key", "size_bytes", "generation")


@query(sql_with("select path_key, size_bytes, generation from snap_old"))
def snapshot_fallback(spark, sf):
    """A generation whose rows do not match its record is skipped for the one before."""
    folder = scratch_path(use_utc(spark), "store")
    snapshots.save_snapshot(V.snap_old(spark, sf), folder, 1)
    broken = spark.createDataFrame([(2, f"{folder}/gen=2/missing", 5, -1)], snapshots.POINTER_SCHEMA)
    broken.write.mode("append").parquet(f"{folder}/pointer")
    return snapshots.load_snapshot(spark, folder).select("path_key", "size_bytes", "generation")


# --- streams ----------------------------------------------------------------------------

#: Rows of one file of a stream, about.
FILE_ROWS = 500_000


def _stream(spark, df, label, order, files=4):
    """The rows of a table as a stream in the order of a column, in portions, one per micro-batch.

    The table is computed once. A portion has as many files as its rows ask for, the same number in all.
    """
    path, staged = scratch_path(use_utc(spark), label), scratch_path(spark, f"{label}-staged")
    df.write.parquet(staged)
    rows = spark.read.schema(df.schema).parquet(staged)
    bounds = rows.select(F.percentile_approx(order, [k / files for k in range(1, files)], 10_000).alias("q")).first()["q"] or []
    portion = sum((F.when(c(order) > b, 1).otherwise(0) for b in bounds), F.lit(0))
    sizes = dict(rows.groupBy(portion.alias("p")).count().collect())
    counts = [sizes.get(k, 0) for k in range(len(bounds) + 1)]
    each = _files_each(counts)
    for k in range(len(counts)):
        rows.where(portion == k).repartition(each).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", each).parquet(path), scratch_path(spark, label + "-out")


def _files_each(counts, file_rows=FILE_ROWS):
    """Files of each portion: about one for ``file_rows``, but so few that none is empty, for an empty one is not written."""
    return max(1, min(max(counts) // file_rows, min(counts) // 1000))


@query(sql_with("select path_key, full_path, open_count, epoch_us(last_used_at) last_used_us from usage"))
def usage_stream(spark, sf):
    stream, folder = _stream(spark, V.opens(spark, sf), "opens", "event_id", 10)
    jobs.write_updates(jobs.usage_counts(stream), folder, keys=["path_key"]).awaitTermination()
    found = jobs.latest_updates(spark, folder, ["path_key"])
    return found.select("path_key", "full_path", "open_count", F.unix_micros("last_used_at").alias("last_used_us"))


@query(sql_with("""
select epoch_us(date_trunc('hour', started_at)) window_us, operation, outcome, count(*) n, count_if(total_ms <= 1) le_1,
  count_if(total_ms > 25 and total_ms <= 50) le_50, count_if(total_ms > 1000) above from metrics group by 1, 2, 3"""))
def metric_stream(spark, sf):
    stream, folder = _stream(spark, V.metrics(spark, sf), "metric-rows", "started_at")
    keys = ["window_start", "operation", "outcome"]
    jobs.write_updates(jobs.metric_windows(stream, "1 hour", "1 hour"), folder, keys=keys).awaitTermination()
    found = jobs.latest_updates(spark, folder, keys)
    return found.select(F.unix_micros("window_start").alias("window_us"), "operation", "outcome", "n", "le_1", "le_50", "above")


@query(sql_with("""
select session_id, seq from kept where epoch_ms(ts) + 1800000 <= (select max(epoch_ms(ts)) from events) - 3600000""", kept=_KEPT))
def superseded_stream(spark, sf):
    """Requests that are final: the last of a burst that ended before the watermark; open bursts are still state."""
    stream, folder = _stream(spark, V.query_log(spark, sf), "queries", "ts")
    jobs.write_updates(jobs.last_of_bursts(stream, "30 minutes", "1 hour"), folder, "append").awaitTermination()
    return jobs.all_updates(spark, folder).select("session_id", "seq")


@query(sql_with("""
select path path_key, arg_max(op, row(usn, seq)) = 'upsert' is_live from ops where op <> 'purge' group by 1""", ev=_EV, ops=_OPS))
def state_stream(spark, sf):
    stream, folder = _stream(spark, C.lower_changes(V.changes(spark, sf)), "ops", "size_bytes")
    jobs.write_updates(jobs.latest_states(stream), folder, keys=["path_key"]).awaitTermination()
    return jobs.latest_updates(spark, folder, ["path_key"]).select("path_key", "is_live")


@query(sql_with("""
select full_path, hints, case state when 'deep' then 'refresh_recursive' else state end "action" from fold""", effects=_EFFECTS, fold=_FOLD))
def hint_stream(spark, sf):
    """All hints in five files folded over micro-batches; a last hint long after them lets every timer run out."""
    hints = V.hints(spark, sf)
    end = hints.agg(F.max("seq").alias("seq"), (F.max("ts") + F.expr("interval 900 days")).alias("ts"))
    end = end.select("seq", "ts", F.lit("/end").alias("full_path"), F.lit("changed").alias("kind"), F.lit(None).cast("string").alias("old_full_path"))
    stream, folder = _stream(spark, hints.unionByName(end), "hints", "ts", 5)
    jobs.coalesce_hint_stream(stream, folder, 1_800_000, "event", "400 days").awaitTermination()
    return spark.read.parquet(f"{folder}/pending").select("full_path", "hints", "action")


def _replayed_log(spark, sf, compact_after):
    """The catalog log after changes that arrive in three portions, each applied by a restarted query."""
    use_utc(spark)
    source, folder = scratch_path(spark, "feed"), scratch_path(spark, "replay")
    catalog_log.publish(V.replay_base(spark, sf), f"{folder}/catalog", buckets=16)
    changes = V.changes(spark, sf)
    third = changes.agg(F.max("usn").alias("n")).first()["n"] // 3 + 1
    for k in range(3):
        records.write_changes(changes.where(F.floor(c("usn") / third) == k), source)
        jobs.apply_change_stream(records.read_changes(spark, source, streaming=True), folder, generation=7, compact_after=compact_after).awaitTermination()
    return f"{folder}/catalog"


@query(sql_with(_REPLAYED, **_REPLAY_VIEWS))
def change_stream(spark, sf):
    """Base and the deltas of three portions, merged on read."""
    folder = _replayed_log(spark, sf, compact_after=9)
    return catalog_log.read(spark, folder).select("path_key", "size_bytes", "file_reference", "generation")


@query(sql_with(_REPLAYED, **_REPLAY_VIEWS))
def compacted_catalog(spark, sf):
    """The same changes with the buckets that a delta touches merged after every batch."""
    folder = _replayed_log(spark, sf, compact_after=1)
    return catalog_log.read(spark, folder).select("path_key", "size_bytes", "file_reference", "generation")


_USER_FOLDER = "'/vol/'||p_name||'-'||p_partkey"


@query(sql_with(f"""
select lower({_USER_FOLDER}||'/n'||user_id||'.txt') path_key, user_id * 10 size_bytes, user_id + 1 file_reference, 7 generation from u where last_event <> 'error'
union all select '/vol/links/n'||user_id||'.txt', user_id * 10, user_id + 1, 7 from u where bought and user_id % 3 = 0
union all select '/vol/old/n'||user_id||'.txt', 1, user_id + 1, 1 from u where not bought""", u="""
select user_id, p_name, p_partkey, coalesce(arg_max(event_type, event_id) filter (event_type <> 'view'), 'error') last_event,
  coalesce(bool_or(event_type = 'purchase'), false) bought
from events join part on p_partkey = user_id % 50 + 1 group by all"""))
def journal_to_catalog(spark, sf):
    """Raw journal entries of all events in two portions, replayed by a restarted query over old links."""
    use_utc(spark)
    part = V.table(spark, sf, "part").select(c("p_partkey").alias("id"), F.concat(F.lit("/vol/"), "p_name", F.lit("-"), "p_partkey").alias("full_path"))
    events = V.table(spark, sf, "events")
    name = F.concat(F.lit("n"), "user_id", F.lit(".txt"))
    at = F.lit("2024-03-01").cast("timestamp")
    users = events.select("user_id").distinct().join(part.withColumnRenamed("full_path", "folder"), c("id") == c("user_id") % 50 + 1)
    link = lambda folder, size: users.select(
        (c("user_id") + 1).alias("ref"), F.concat(folder, F.lit("/"), name).alias("full_path"), F.lit(False).alias("is_directory"),
        size.cast("long").alias("size_bytes"), at.alias("mtime"),
    )
    live = link(c("folder"), c("user_id") * 10).unionByName(link(F.lit("/vol/links"), c("user_id") * 10).where((c("ref") - 1) % 3 == 0))
    old = link(F.lit("/vol/old"), F.lit(1)).select(
        F.lower("full_path").alias("path_key"), "full_path", "is_directory", "size_bytes", "mtime", c("ref").alias("file_reference"), F.lit(1).cast("long").alias("generation")
    )
    bits = {"signup": "file_create", "click": "data_extend", "purchase": "hard_link_change", "error": "file_delete"}
    reason = F.lit(C.REASON_BITS["close"])
    for event, bit in bits.items():
        reason = F.when(c("event_type") == event, C.REASON_BITS[bit]).otherwise(reason)
    entries = events.select(
        (c("user_id") + 1).alias("ref"), (c("user_id") % 50 + 1).alias("parent_ref"), name.alias("name"), F.lit(False).alias("is_dir"),
        c("event_id").alias("usn"), reason.cast("long").alias("reason"),
    )
    source, folder = scratch_path(spark, "entries"), scratch_path(spark, "journal")
    catalog_log.publish(old, f"{folder}/catalog", journal_id=5, buckets=16)
    half = entries.agg(F.max("usn").alias("n")).first()["n"] // 2 + 1
    for k in range(2):
        entries.where(F.floor(c("usn") / half) == k).write.mode("append").parquet(source)
        stream = spark.readStream.schema(entries.schema).parquet(source)
        jobs.replay_journal(stream, part, live, "/vol", folder, generation=7, journal_id=5).awaitTermination()
    return catalog_log.read(spark, f"{folder}/catalog").select("path_key", "size_bytes", "file_reference", "generation")
