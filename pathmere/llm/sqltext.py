"""SQL counterparts of the newer operators, for DuckDB, by brute force where the operator is clever."""

from __future__ import annotations


def _crc_step(register: int) -> int:
    for _ in range(8):
        register = register >> 1 ^ (0xEDB88320 if register & 1 else 0)
    return register


_TABLE = "[" + ",".join(f"{_crc_step(b)}" for b in range(256)) + "]"


def crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a SQL text, byte by byte."""
    data = f"list_transform(range(0, strlen({text})), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda c, b: xor(c >> 8, {_TABLE}[(xor(c, b) & 255) + 1])), 4294967295)"


LINKED_VECTORS = """
    with recursive v as (
        select row_number() over () as k, vec_id, label, embedding::double[] as e,
               label is not null and embedding is not null and len(embedding) > 0
               and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
               and len(list_filter(embedding, lambda x: x <> 0)) > 0 as sound
        from embeddings),
    pairs as (
        select a.k as a, b.k as b from v a join v b on a.label = b.label and a.k <> b.k and len(a.e) = len(b.e)
        where a.sound and b.sound and list_cosine_similarity(a.e, b.e) >= 0.98),
    reach(a, b) as (select k, k from v union select r.a, p.b from reach r join pairs p on r.b = p.a),
    least as (select r.a as k, min(w.vec_id) as component_id from reach r join v w on w.k = r.b group by r.a),
    links as (select a as k, count(*) as n from pairs group by a)
    select vec_id, coalesce(n, 0) as n_links, component_id, vec_id is not distinct from component_id as kept
    from v join least using (k) left join links using (k)
"""

REPAIRED_CONVERSATIONS = rf"""
    with recursive c as (
        select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
               coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name from conversations),
    p as (select *, {crc32("name")} % 20 as part from c),
    d as (
        select conv_id, turn, case when part = 4 then 'user' else role end as role,
               case part when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
               unnest(range(case when part = 3 then 2 else 1 end)) as copy
        from p where part <> 0),
    placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as seq from d),
    e as (
        select *, row_number() over (partition by conv_id, role, text order by seq) > 1 as again,
               regexp_replace(text, '[\x20\x09-\x0D]+$', '') as t, left(role, 1) as x
        from placed),
    f as (
        select *, lag(x) over (partition by conv_id order by seq) as px,
               case when t = '' then 'B' when again then 'D' when right(t, 1) in ('.', '!', '?') then '-' else 'T' end as fault
        from e),
    moves(q, x, s) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
    ins(q, s, i, cost) as (values (0, 0, '', 0), (1, 1, '', 0), (2, 2, '', 0), (3, 3, '', 0),
        (0, 2, 'I', 5), (1, 2, 'I', 5), (3, 2, 'I', 5), (2, 3, 'I', 5), (0, 3, 'II', 10), (1, 3, 'II', 10), (3, 3, 'II', 10)),
    edits(letter, q, x, s, cost) as (
        select 'D', q, null, q, 2 from range(4) r(q) union all select 'K', q, x, s, 0 from moves union all select 'R', q, null, s, 1 from moves where x <> 's'),
    sizes as (select conv_id, count(*) as n from f group by conv_id),
    best(conv_id, k, q, cost, audit) as (
        select conv_id, n::bigint, i.q, i.cost, i.i from sizes, ins i where i.s in (0, 3)
        qualify row_number() over (partition by conv_id, i.q order by i.cost, i.i) = 1
        union all
        select conv_id, k, q, cost, audit from (
            select f.conv_id, b.k - 1 as k, i.q, i.cost + e.cost + b.cost + case when e.letter <> 'D' and f.fault = 'T' then 5 else 0 end as cost,
                   i.i || e.letter || b.audit as audit
            from best b join f on f.conv_id is not distinct from b.conv_id and f.seq = b.k
                 join edits e on e.s = b.q and (e.x is null or e.x = f.x) and (e.letter = 'D' or f.fault not in ('B', 'D'))
                 join ins i on i.s = e.q)
        qualify row_number() over (partition by conv_id, k, q order by cost, audit) = 1),
    won as (select conv_id, cost, audit from best where k = 0 and q = 0),
    letters as (
        select conv_id, i, audit[i] as letter, sum((audit[i] <> 'I')::int) over (partition by conv_id order by i) as seq
        from (select conv_id, audit, unnest(range(1, len(audit) + 1)) as i from won)),
    left_over as (
        select l.conv_id, l.i, l.letter, f.role, f.text, row_number() over (partition by l.conv_id order by l.i) as j,
               first_value(l.letter = 'K' and f.x = 's') over (partition by l.conv_id order by l.i) as led
        from letters l left join f on f.conv_id is not distinct from l.conv_id and f.seq = l.seq and l.letter <> 'I' where l.letter <> 'D'),
    lines as (
        select conv_id, string_agg(case when letter = 'K' then role when (j - led::int) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''), chr(10) order by i) as t
        from left_over group by conv_id),
    facts as (
        select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'B') as blank,
               count(*) filter (fault = 'D') as duplicate, count(*) filter (fault = 'T') as truncated,
               count(*) filter (px is not null and px || x not in ('su', 'ua', 'au')) as illegal
        from f group by conv_id)
    select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
           coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(audit, '') as audit, sha256(coalesce(t, '')) as repaired_sha256
    from (select distinct conv_id from conversations) o
    left join facts on facts.conv_id is not distinct from o.conv_id
    left join won on won.conv_id is not distinct from o.conv_id
    left join lines on lines.conv_id is not distinct from o.conv_id
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _features(table: str) -> str:
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    runs = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"(select k, doc_id, len(w) as n_words, {runs} as fs from (select row_number() over () as k, doc_id, {words} as w from {table}))"


RESAMPLED_DOCUMENTS = f"""
    with d as materialized {_features("documents")},
    b as materialized {_features("(select null as doc_id, text from benchmark)")},
    f as materialized (select k, unnest(fs) as f from d),
    g as materialized (select unnest(fs) as f from b),
    names as (select distinct f from (select f from f union all select f from g)),
    bucket as materialized (select f, {crc32("f")} % 10000 as bucket from names),
    s as (select bucket, count(*) as n from f join bucket using (f) group by bucket),
    t as (select bucket, count(*) as n from g join bucket using (f) group by bucket),
    gain as (
        select r.bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from s) + 10000)::double)
               / ((coalesce(s.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from t) + 10000)::double)))::bigint as gain
        from range(10000) r(bucket) left join s using (bucket) left join t using (bucket)),
    total as (select k, sum(gain) as total from f join bucket using (f) join gain using (bucket) group by k),
    scored as (
        select doc_id, n_words, len(fs) as n_features, coalesce(total // len(fs) - (total % len(fs) < 0)::int, 0)::bigint as weight,
               ('0x' || left(sha256('7:' || coalesce(doc_id::varchar, 'null')), 8))::bigint as h
        from d left join total using (k)),
    noisy as (select doc_id, n_words, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from scored),
    ranked as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as place, count(*) filter (n_words >= 20) over () as able from noisy)
    select doc_id, n_features, weight, score, case when n_words >= 20 and place <= floor(25 * able / 100) then place end as rank from ranked
"""
