"""SQL text of the match rules, written relationally for comparison with the Spark operators."""

from pathmere.plans.expressions import _APP_SQL

SEPARATORS = "(' ', '-', '_', '.', chr(92), '/')"


def fuzzy(q: str, c: str) -> str:
    """Walks every candidate character (the Spark side jumps between query characters)."""
    steps = (
        f"list_transform(range(1, length({c}) + 1), lambda i: {{'k': 0, 's': 0, 't': 0.0::double, "
        f"'ch': substr({c}, i::int, 1), 'before': case when i = 1 then ' ' else substr({c}, i::int - 1, 1) end}})"
    )
    start = "{'k': 0, 's': 0, 't': 0.0::double, 'ch': '', 'before': ''}"
    walk = (
        f"list_reduce({steps}, lambda a, x: case when a.k >= length({q}) then a "
        f"when x.ch = substr({q}, a.k + 1, 1) then {{'k': a.k + 1, 's': a.s + 1, "
        f"'t': a.t + 8 + 2 * (a.s + 1) + case when x.before in {SEPARATORS} then 10 else 0 end, 'ch': '', 'before': ''}} "
        f"else {{'k': a.k, 's': 0, 't': a.t, 'ch': '', 'before': ''}} end, {start})"
    )
    in_order = f"'%'||array_to_string(string_split({q}, ''), '%')||'%'"
    return (
        f"case when {q} = '' or {c} = '' then 0.0 when contains({c}, {q}) then 200.0 + length({q}) "
        f"when {c} not like {in_order} then 0.0 "
        f"else list_transform([{walk}], lambda r: case when r.k = length({q}) then least(r.t, 199.0) else 0.0 end)[1] end"
    )


def parts(x: str) -> str:
    return f"list_filter(list_transform(string_split(replace(lower({x}), chr(92), '/'), '/'), lambda p: trim(p)), lambda p: p <> '')"


def component(c: str, s: str) -> str:
    return (
        f"({c} = {s} or case when regexp_full_match({s}, '[a-z]+') then starts_with({c}, {s}) and "
        f"not regexp_matches(substr({c}, length({s}) + 1, 1), '\\p{{L}}') else contains({c}, {s}) end)"
    )


def path_match(p: str, e: str) -> str:
    segs, comps = parts(e), parts(p)
    reached = (
        f"list_reduce(list_transform({comps}, lambda x: {{'i': 0, 'c': x}}), "
        f"lambda a, x: case when a.i < len({segs}) and {component('x.c', f'({segs})[a.i + 1]')} then {{'i': a.i + 1, 'c': ''}} "
        f"else {{'i': a.i, 'c': ''}} end, {{'i': 0, 'c': ''}})"
    )
    norm = f"replace(lower(trim({p})), chr(92), '/')"
    snippet = f"trim(replace(lower(trim({e})), chr(92), '/'), '/')"
    return (
        f"(case len({segs}) when 0 then false "
        f"when 1 then len(list_filter({comps}, lambda x: {component('x', f'({segs})[1]')})) > 0 "
        f"else contains('/'||ltrim({norm}, '/')||'/', '/'||{snippet}||'/') or ({reached}).i = len({segs}) end)"
    )


def path_score(p: str, e: str) -> str:
    return f"(case when {path_match(p, e)} then coalesce(list_sum(list_transform({parts(e)}, lambda s: length(s) + 2)), 0) else 0 end)"


_PAIRS = """
select r.*, c.*, lower(trim(c.name)) nm, %s is_app,
  case when r.preferred_root is null or c.parent_key = lower(r.preferred_root) then 0 else 1 end root_priority
from {catalog} c join {requests} r on
  (r.kind = 'any' or c.is_directory = (r.kind = 'folders'))
  and (len(r.required_ext) = 0 or (not c.is_directory and list_contains(r.required_ext, c.ext)))
  and (not r.apps_only or %s)
  and (r.modified_after is null or c.mtime >= r.modified_after)
  and (len(r.include_ext) = 0 or len(list_filter(r.include_ext, lambda e: ends_with(lower(c.name), '.'||e))) > 0)
  and len(list_filter(r.exclude_ext, lambda e: ends_with(lower(c.name), '.'||e))) = 0
  and len(list_filter(r.excluded_terms, lambda t: contains(c.path_key, t))) = 0
  and len(list_filter(r.phrases, lambda t: not contains(c.path_key, t))) = 0
  and len(list_filter(r.path_terms, lambda t: not %s)) = 0
""" % (_APP_SQL, _APP_SQL, path_match("c.full_path", "t"))

_TERMS = """
select query_id, path_key, nm, reading, initials, full_path, parent_path, len(terms) + len(phrases) wanted,
  unnest(list_concat(phrases, terms)) q, unnest(range(0, len(terms) + len(phrases))) pos, len(phrases) phrase_count
from pairs"""

_SCORED = f"""
select *, pos >= phrase_count fuzzy_ok, {fuzzy('q', 'nm')} f,
  case when lower(reading) = nm then 0.0 else greatest({fuzzy('q', 'lower(trim(reading))')}, {fuzzy('q', 'lower(trim(initials))')}) end a,
  case when contains(q, '/') or contains(q, chr(92)) then {path_score('full_path', 'q')} else 0 end ps
from term_rows"""

_KEYS = """
select query_id, path_key, pos, wanted,
  case when nm = q then {'t': 0, 'q': length(q)::double, 'd': 0, 'r': 'exact-name'}
    when starts_with(nm, q) then {'t': 1, 'q': length(q)::double, 'd': length(nm) - length(q), 'r': 'name-prefix'}
    when contains(nm, q) and regexp_matches(nm, '(?i)%(3A|5C|2F)') then {'t': 6, 'q': length(q)::double, 'd': length(nm) - length(q), 'r': 'name-substring'}
    when contains(nm, q) then {'t': 2, 'q': length(q)::double, 'd': length(nm) - length(q), 'r': 'name-substring'}
    when fuzzy_ok and a > 0 and length(q) <= 3 and (lower(initials) = q or starts_with(lower(initials), q||'.')
      or contains(' '||lower(initials)||' ', ' '||q||' ') or starts_with(lower(reading), q))
      then {'t': 1, 'q': 100 + a, 'd': abs(length(nm) - length(q)), 'r': 'pinyin'}
    when fuzzy_ok and f > 0 then {'t': 3, 'q': f, 'd': abs(length(nm) - length(q)), 'r': 'name-fuzzy'}
    when fuzzy_ok and a > 0 then {'t': 4, 'q': a, 'd': abs(length(nm) - length(q)), 'r': 'pinyin'}
    when ps > 0 then {'t': 2, 'q': ps::double, 'd': abs(length(parent_path) - length(q)), 'r': 'path-segment'} end k
from scored_terms"""

_COMBINED = """
select query_id, path_key, max(k.t) tier, sum(k.q) quality, sum(k.d)::int length_diff,
  arg_min(k.r, {'a': -k.t, 'b': k.q, 'c': pos}) reason
from term_keys group by query_id, path_key having count(k) = any_value(wanted)"""

_MATCHED = """
select p.*, coalesce(m.tier, 0) tier, coalesce(m.quality, 1) quality, coalesce(m.length_diff, 0) length_diff,
  case when m.tier is null then 1 else 10000 - 1000 * m.tier + m.quality end score, coalesce(m.reason, 'filter') match_reason
from pairs p left join combined m using (query_id, path_key)
where m.tier is not null or len(p.terms) + len(p.phrases) = 0"""

_READY = """
select m.*, coalesce(u.open_count, 0) open_count,
  case when u.path_key is null then 0.0 else greatest(0.0, least(20.0,
    20 - (epoch_us(timestamp '2024-02-01') - epoch_us(u.last_used_at)) / 86400000000.0)) end recency,
  exists (select 1 from pinned z where z.path_key = m.path_key) and (m.is_directory or len(m.terms) + len(m.phrases) = 0) is_pinned
from matched m left join usage u using (path_key)"""

ORDER = (
    "root_priority, tier, quality desc, length_diff, is_app desc, is_pinned desc, open_count desc, recency desc, "
    "lower(name), name, path_key, full_path"
)

_RANKED = f"""
select * from (select *, row_number() over (partition by query_id order by {ORDER}) as rnk from ready) where rnk <= lim"""


def search_views(catalog: str = "catalog", requests: str = "requests") -> dict[str, str]:
    """Views ``matched``, ``ready`` and ``ranked`` for a catalog and a request view."""
    return {
        "pairs": _PAIRS.replace("{catalog}", catalog).replace("{requests}", requests),
        "term_rows": _TERMS, "scored_terms": _SCORED, "term_keys": _KEYS, "combined": _COMBINED,
        "matched": _MATCHED, "ready": _READY, "ranked": _RANKED,
    }
