"""Queries for scoring, ranked search and result lists."""

from pyspark.sql import functions as F

from pathmere.functions import scoring as S
from pathmere.operators import search as R
from pathmere.operators import filters as flt
from pathmere.plans import sqltext as X
from pathmere.plans import views as V
from pathmere.plans.registry import query
from pathmere.plans.views import ALIAS_REQUESTS, REQUESTS, sql_with

c = F.col
SHOWN = ["rank", "path_key", "tier", "quality", "length_diff", "score", "match_reason", "is_app", "open_count", "is_pinned", "recency"]
SHOWN_SQL = "rnk as rank, path_key, tier, quality, length_diff, score, match_reason, is_app, open_count, is_pinned, recency"


def _searched(spark, sf, request, **kw):
    return R.search(V.catalog(spark, sf), request, V.usage(spark, sf), V.pinned(spark, sf), V.as_of(), **kw)


# --- scores -----------------------------------------------------------------------------

TERMS = ["rdblt", "bolt", "doc-1", "src", "cu0", "e/x", "ring 1"]


def _with_terms(df, terms=TERMS):
    return df.withColumn("term", F.explode(F.array(*[F.lit(t) for t in terms])))


_TERM_ROWS = f"select *, lower(trim(name)) nm from catalog, (select unnest({V.list_sql(TERMS)}) term)"


@query(sql_with(f"select path_key, term, {X.fuzzy('term', 'nm')} score from term_pairs", term_pairs=_TERM_ROWS))
def fuzzy_score(spark, sf):
    return _with_terms(V.catalog(spark, sf)).select("path_key", "term", S.fuzzy_score(c("term"), c("name")).alias("score"))


ALIAS_TERMS = ["eleve", "fr", "e"]


@query(sql_with(f"""
select doc_id, line_no, term, {X.fuzzy('term', 'lower(trim(reading))')} score,
  length(term) <= 3 and (reading_low = term or starts_with(reading_low, term||'.') or contains(' '||reading_low||' ', ' '||term||' ')
    or starts_with(reading_low, term)) short_hit
from (select *, {V.reading_sql('name')} reading, lower({V.reading_sql('name')}) reading_low
  from doc_lines, (select unnest({V.list_sql(ALIAS_TERMS)}) term))"""))
def alias_score(spark, sf):
    from pathmere.operators.aliases import with_alias_forms

    rows = _with_terms(with_alias_forms(V.doc_lines(spark, sf)), ALIAS_TERMS)
    score = S.alias_score(c("term"), c("reading"), c("initials"))
    hit = S.short_alias_hit(c("term"), c("reading"), c("initials"))
    return rows.select("doc_id", "line_no", "term", score.alias("score"), hit.alias("short_hit"))


SEGMENTS = ["src1", "asia", "brand#1", "promo/gear", "fr/src3/doc", "docs/fr", "example.com/en", "parts/brand#2/re"]


@query(sql_with(f"""
select path_key, seg, {X.path_match('full_path', 'seg')} hit, {X.path_score('full_path', 'seg')} score
from catalog, (select unnest({V.list_sql(SEGMENTS)}) seg)"""))
def path_segment_match(spark, sf):
    rows = V.catalog(spark, sf).withColumn("seg", F.explode(F.array(*[F.lit(s) for s in SEGMENTS])))
    return rows.select(
        "path_key", "seg", S.path_match(c("full_path"), c("seg")).alias("hit"), S.path_score(c("full_path"), c("seg")).cast("long").alias("score")
    )


@query(sql_with("""
select path_key, seg, comp, %s hit from (
  select path_key, seg, unnest(%s) comp from catalog, (select unnest(['src1', 'a', '#1', 'doc']) seg))"""
                % (X.component("comp", "seg"), X.parts("full_path"))))
def component_match(spark, sf):
    from pathmere.functions.paths import components

    rows = _with_terms(V.catalog(spark, sf), ["src1", "a", "#1", "doc"]).withColumn("comp", F.explode(components(c("full_path"))))
    return rows.select("path_key", c("term").alias("seg"), "comp", S.component_match(c("comp"), c("term")).alias("hit"))


SINGLE_TERMS = {i: R.SearchRequest(terms=[t]) for i, t in enumerate(["rdblt", "bolt", "doc-1", "fr/src3", "src", "e"])}


@query(sql_with("select query_id, path_key, k.t tier, k.q quality, k.d length_diff, k.r reason from term_keys where k is not null",
                **X.search_views(requests="single"), single=V.requests_sql(SINGLE_TERMS)))
def term_keys(spark, sf):
    """Match key of single terms against every row."""
    terms = F.array(*[F.struct(F.lit(i).alias("query_id"), F.lit(r.terms[0]).alias("term")) for i, r in SINGLE_TERMS.items()])
    rows = S.with_match_columns(V.catalog(spark, sf)).withColumn("t", F.explode(terms))
    keyed = rows.select("t.query_id", "path_key", S.term_key(c("t.term"), S.NameForms.of_catalog()).alias("k"))
    return keyed.select("query_id", "path_key", "k.*").where("tier is not null")


@query(sql_with("select path_key, tier, quality, length_diff, score, match_reason from matched where query_id = 6", **X.search_views()))
def combined_terms(spark, sf):
    return R.matches(V.catalog(spark, sf), REQUESTS[6]).select("path_key", "tier", "quality", "length_diff", "score", "match_reason")


@query(sql_with("""
select path_key, round(greatest(0.0, least(20.0, 20 - (epoch_us(timestamp '2024-02-01') - epoch_us(last_used_at)) / 86400000000.0)), 9) recency
from usage"""))
def recency(spark, sf):
    return V.usage(spark, sf).select("path_key", F.round(S.recency(c("last_used_at"), V.as_of()), 9).alias("recency"))


# --- ranked search ----------------------------------------------------------------------

def _ranked(name, qid):
    def run(spark, sf):
        return _searched(spark, sf, REQUESTS[qid]).select(*SHOWN)
    run.__name__ = name
    sql = sql_with(f"select {SHOWN_SQL} from ranked", **X.search_views(requests="one"), one=V.requests_sql({qid: REQUESTS[qid]}))
    query(sql)(run)


_ranked("search_ranked", 6)
_ranked("search_exact", 1)
_ranked("search_prefix", 2)
_ranked("search_substring", 3)
_ranked("search_fuzzy", 4)
_ranked("search_no_hit", 5)
_ranked("search_path_segment", 7)
_ranked("search_phrase", 8)
_ranked("search_exclusions", 9)
_ranked("search_filter_only", 12)
_ranked("search_preferred_root", 11)
_ranked("search_quick_filters", 13)
_ranked("search_applications", 14)


@query(sql_with(f"select query_id, {SHOWN_SQL} from ranked", **X.search_views()))
def search_batch(spark, sf):
    """All requests in one pass: top rows per request."""
    found = R.search_many(V.catalog(spark, sf), V.requests(spark, sf), V.usage(spark, sf), V.pinned(spark, sf), V.as_of())
    return found.select("query_id", *SHOWN)


@query(sql_with(f"select query_id, {SHOWN_SQL} from ranked", **X.search_views("line_catalog", "alias_requests")))
def search_batch_aliases(spark, sf):
    """Transliterated matches over document lines as names."""
    requests = R.request_table(spark, ALIAS_REQUESTS)
    found = R.search_many(V.line_rows(spark, sf), requests, V.usage(spark, sf), V.pinned(spark, sf), V.as_of())
    return found.select("query_id", *SHOWN)


@query(sql_with(f"select {SHOWN_SQL} from ranked", **X.search_views("line_catalog", "one"), one=V.requests_sql({1: ALIAS_REQUESTS[1]})))
def search_alias(spark, sf):
    found = R.search(V.line_catalog(spark, sf), ALIAS_REQUESTS[1], V.usage(spark, sf), V.pinned(spark, sf), V.as_of())
    return found.select(*SHOWN)


@query(sql_with("select rnk as rank, path_key from ranked where rnk between 51 and 100", **X.search_views(requests="one"),
                one=V.requests_sql({3: REQUESTS[3]})))
def search_second_page(spark, sf):
    return R.page(_searched(spark, sf, REQUESTS[3]), 2).select("rank", "path_key")


@query(sql_with("select count(*) compared, 0 differing from ranked where query_id in (2, 9)", **X.search_views()))
def batch_equals_single(spark, sf):
    """Ranks compared between the batch search and the one-request search, and differences."""
    batch = R.search_many(V.catalog(spark, sf), V.requests(spark, sf), V.usage(spark, sf), V.pinned(spark, sf), V.as_of())
    both = [
        _searched(spark, sf, REQUESTS[i]).select(F.lit(i).cast("long").alias("query_id"), "rank", "path_key", "score", "match_reason")
        for i in (2, 9)
    ]
    single = both[0].unionByName(both[1])
    keys = ("query_id", "rank")
    differing = R.same_results(batch.where(c("query_id").isin(2, 9)), single, keys).select(*keys, F.lit(1).alias("differs"))
    flagged = single.select(*keys, F.lit(0).alias("differs")).unionByName(differing)
    return flagged.agg(F.count_if(c("differs") == 0).alias("compared"), F.sum("differs").alias("differing"))


# --- joins and result lists -------------------------------------------------------------

@query(sql_with("select c.path_key, coalesce(open_count, 0) open_count, last_used_at is not null used from catalog c left join usage u using (path_key)"))
def catalog_with_usage(spark, sf):
    used = V.usage(spark, sf).select("path_key", c("open_count").alias("opens"), "last_used_at")
    joined = V.catalog(spark, sf).join(used, "path_key", "left")
    return joined.select("path_key", F.coalesce("opens", F.lit(0)).alias("open_count"), c("last_used_at").isNotNull().alias("used"))


@query(sql_with("""
select row_number() over (order by last_used_at desc, open_count desc, c.path_key) as rank, c.path_key, 1.0 score, 'recent' match_reason
from usage join catalog c using (path_key) qualify rank <= 12"""))
def recent_rows(spark, sf):
    return R.recents(V.usage(spark, sf), V.catalog(spark, sf), 12).select("rank", "path_key", "score", "match_reason")


@query(sql_with("select path_key, exists (select 1 from pinned p where p.path_key = c.path_key) pinned from catalog c"))
def pinned_flags(spark, sf):
    pins = R.pinned_keys(V.pinned(spark, sf)).withColumn("pin", F.lit(True))
    return V.catalog(spark, sf).join(pins, "path_key", "left").select("path_key", F.coalesce("pin", F.lit(False)).alias("pinned"))


@query(sql_with("""
select user_id query_id, arg_min(p_partkey, p_partkey) seq, arg_min(upper(p_name), p_partkey) keyword
from (select distinct user_id, ' '||p_name||' ' as typed from events join part on p_partkey = user_id) e
join part on lower(trim(typed)) = lower(p_name) and p_size > 2 group by user_id"""))
def keyword_lookup(spark, sf):
    part = V.table(spark, sf, "part")
    entries = part.select(
        c("p_partkey").alias("seq"), F.concat(F.lit(" "), F.upper("p_name")).alias("keyword"), c("p_type").alias("target"),
        (c("p_size") > 2).alias("enabled"),
    )
    users = V.table(spark, sf, "events").select("user_id").distinct()
    typed = users.join(part, c("user_id") == c("p_partkey")).select(
        c("user_id").alias("query_id"), F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("text")
    )
    return R.keyword_targets(typed, entries).select("query_id", "seq", F.trim("keyword").alias("keyword"))


@query(sql_with("""
select path_key, rnk as rank, case when parent_key = '/parts/promo/brand#1' then 0 when starts_with(path_key, '/parts/promo/brand#1/') then 1 else 2 end root_group
from ranked""", **X.search_views(requests="one"), one=V.requests_sql({3: REQUESTS[3]})))
def regroup_by_root(spark, sf):
    found = R.regroup_by_root(_searched(spark, sf, REQUESTS[3]), "/parts/PROMO/Brand#1")
    return found.select("path_key", "rank", "root_group")


_TWO = {1: REQUESTS[3], 2: REQUESTS[6]}


@query(sql_with("""
select path_key, arg_min(source_no, {'a': source_no, 'b': rnk}) source_no, arg_min(rnk, {'a': source_no, 'b': rnk}) as rank
from (select path_key, query_id - 1 source_no, rnk from ranked) group by path_key""",
                **X.search_views(requests="two"), two=V.requests_sql(_TWO)))
def first_seen_merge(spark, sf):
    lists = [_searched(spark, sf, r).select("path_key", "rank") for r in _TWO.values()]
    return R.first_seen(*lists).select("path_key", "source_no", "rank")


@query(sql_with(f"""
select path_key, min(lane_no) lane_no from (
  select path_key, 0 lane_no from catalog where parent_key = '/docs/en/src1' and lower(name) like '%d%o%c%-%1%'
  union all select path_key, 1 from catalog where lower(name) like 'doc-1%'
  union all select path_key, 2 from catalog where contains(lower(name), 'doc-1')
  union all select path_key, 3 from catalog where lower(name) like '%d%o%c%-%1%') group by path_key"""))
def match_lanes(spark, sf):
    """Union of the match lanes with the first lane of each row."""
    return R.lane_candidates(V.stored_catalog(spark, sf), REQUESTS[11]).select("path_key", "lane_no")


_LANE_ORDER = "length(name), lower(name), name, length(full_path), full_path"


@query(sql_with(f"""
select path_key, lane_class, row_number() over (order by lane_class, {_LANE_ORDER}) pos from (
  select *, case when lower(name) = 'en' then 0 else 1 end lane_class from catalog where lower(name) like 'en%') qualify pos <= 200"""))
def prefix_lane(spark, sf):
    from pyspark.sql import Window

    rows = R.prefix_lane(V.stored_catalog(spark, sf), "en", 200)
    order = Window.orderBy("lane_class", *R.lane_order())
    return rows.select("path_key", "lane_class", F.row_number().over(order).alias("pos"))


def _pinned_rows(spark, sf):
    """Catalog rows of the pinned paths, ranked by path."""
    rows = V.catalog(spark, sf).join(R.pinned_keys(V.pinned(spark, sf)), "path_key", "left_semi")
    return rows.select("path_key", F.lit("pinned").alias("match_reason"), F.length("path_key").cast("long").alias("rank"))


@query(sql_with("""
select path_key, arg_min(source_no, source_no) source_no, arg_min(rnk, source_no) as rank from (
  select path_key, 0 source_no, length(path_key) rnk from catalog join pinned using (path_key) where contains(path_key, 'docs')
  union all select path_key, 1, rnk from ranked) group by path_key""",
                **X.search_views(requests="one"), one=V.requests_sql({1: R.SearchRequest(terms=["docs"], limit=50)})))
def pinned_before_results(spark, sf):
    request = R.SearchRequest(terms=["docs"], limit=50)
    results = _searched(spark, sf, request).select("path_key", "match_reason", c("rank").cast("long").alias("rank"))
    return R.pinned_first(_pinned_rows(spark, sf), results, request).select("path_key", "source_no", "rank")


@query(sql_with("""
select path_key, arg_min(source_no, source_no) source_no, arg_min(rnk, source_no) as rank from (
  select path_key, 0 source_no, length(path_key) rnk from catalog join pinned using (path_key)
  union all select * from (select path_key, 1, row_number() over (order by last_used_at desc, open_count desc, c.path_key) rnk
    from usage join catalog c using (path_key) qualify rnk <= 12)) group by path_key"""))
def list_without_query(spark, sf):
    rows = _pinned_rows(spark, sf).withColumn("is_directory", F.lit(True))
    merged = R.without_query(rows, V.usage(spark, sf), V.catalog(spark, sf), flt.type_preset("files"), 12)
    return merged.select("path_key", "source_no", "rank")


