"""Queries for path, name, alias and filter expressions."""

from pyspark.sql import functions as F

from pathmere.functions import alias as A
from pathmere.functions import paths as P
from pathmere.functions.formats import known_format_rows, with_format_info
from pathmere.functions.journal import REASON_BITS, reason_flags
from pathmere.operators import filters as flt
from pathmere.operators.aliases import with_alias_forms
from pathmere.operators.catalog import missing_ancestors, top_roots, within_roots
from pathmere.operators.hierarchy import indexable_names
from pathmere.plans import views as V
from pathmere.plans.registry import query
from pathmere.plans.views import q, sql_with

c = F.col


# --- path and name expressions ---------------------------------------------------------



@query(sql_with(f"""
select lower(full_path) path_key, full_path as norm, full_path is not null as absolute
from catalog union all select lower(full_path), null, false from catalog"""))
def norm_path(spark, sf):
    paths = V.catalog(spark, sf).select("path_key", "full_path")
    spelled = paths.select("path_key", F.concat(F.lit("  "), F.translate("full_path", "/", "\\"), F.lit("\\ ")).alias("raw"))
    relative = paths.select("path_key", F.ltrim("full_path", F.lit("/")).alias("raw"))
    norm = P.norm_path(c("raw"))
    return spelled.unionByName(relative).select("path_key", norm.alias("norm"), norm.isNotNull().alias("absolute"))


@query(sql_with("select path_key, name, parent_path, ext from catalog"))
def path_parts(spark, sf):
    return V.catalog(spark, sf).select("path_key", "name", "parent_path", "ext")


@query(sql_with("select path_key, count(*) n from catalog group by 1"))
def path_key(spark, sf):
    return V.catalog(spark, sf).groupBy(P.path_key(c("full_path")).alias("path_key")).agg(F.count("*").alias("n"))


@query(sql_with("""
select path_key, case when lower(name) like '%.lnk' then substr(name, 1, length(name) - 4) else name end shown,
  replace(case when lower(name) like '%.lnk' then substr(name, 1, length(name) - 4) else name end, '%2B', '+') decoded
from catalog"""))
def display_name(spark, sf):
    # the second column encodes the name as one escaped path and decodes it to its leaf
    shown = P.display_name(c("full_path"))
    escaped = F.concat(F.lit("C%3A%5C"), F.replace(F.url_encode(shown), F.lit("+"), F.lit("%20")))
    return V.catalog(spark, sf).select("path_key", shown.alias("shown"), P.decoded_name(escaped).alias("decoded"))


@query(sql_with("""
select doc_id, line_no, false plain, true encoded from doc_lines"""))
def looks_percent_encoded(spark, sf):
    lines = V.doc_lines(spark, sf)
    escaped = F.concat(F.lit("x%2f"), F.url_encode("name"))
    plain = P.looks_percent_encoded(F.translate("name", "%", ""))
    return lines.select("doc_id", "line_no", plain.alias("plain"), P.looks_percent_encoded(escaped).alias("encoded"))


_APP_SQL = """not is_directory and (lower(full_path) like '%.lnk'
  or (regexp_matches(lower(full_path), '\\.(exe|appref-ms|msc)$') and (contains(lower(full_path), '/start menu/') or contains(lower(full_path), '/programs/')
    or contains(lower(full_path), '/program files/') or contains(lower(full_path), '/program files (x86)/') or contains(lower(full_path), '/windowsapps/')))
  or (lower(full_path) like '%.exe' and contains(lower(full_path), '/desktop/')))"""


@query(sql_with(f"""
select full_path, {_APP_SQL} is_app from (
  select full_path, is_directory from catalog union all select '/program files'||full_path, is_directory from catalog
  union all select '/home/desktop'||full_path, is_directory from catalog)"""))
def is_application(spark, sf):
    rows = V.catalog(spark, sf).select("full_path", "is_directory")
    moved = [rows.withColumn("full_path", F.concat(F.lit(p), "full_path")) for p in ("/program files", "/home/desktop")]
    both = rows.unionByName(moved[0]).unionByName(moved[1])
    return both.select("full_path", P.is_application(c("full_path"), c("is_directory")).alias("is_app"))


@query(sql_with("""
select doc_id, line_no, case when regexp_matches(name, '[^\\x00-\\x7F]') then 'multilingual' else 'none' end need from doc_lines"""))
def alias_need(spark, sf):
    return V.doc_lines(spark, sf).select("doc_id", "line_no", A.alias_need(c("name")).alias("need"))


@query(sql_with(f"select doc_id, line_no, {V.reading_sql('name')} reading, {V.reading_sql('name')} initials, name as off from doc_lines"))
def alias_forms(spark, sf):
    lines = V.doc_lines(spark, sf)
    return with_alias_forms(lines).select("doc_id", "line_no", "reading", "initials", A.latin_reading(c("name"), "chinese").alias("off"))




@query(sql_with("""
select path_key, name||'中国'||name as han_name, lower(name)||'zhongguo'||lower(name) reading, lower(name)||'zg'||lower(name) initials,
  lower(name)||'zhongguo'||lower(name)||' '||lower(name)||'zg'||lower(name) search_text from catalog"""))
def alias_forms_han(spark, sf):
    readings = spark.createDataFrame([("中", "ZHONG"), ("国", "GUO"), ("文", "WEN")], "char string, reading string")
    names = V.catalog(spark, sf).select("path_key", F.concat("name", F.lit("中国"), "name").alias("han_name"))
    return with_alias_forms(names, readings, name_col="han_name").select("path_key", "han_name", "reading", "initials", "search_text")


@query(sql_with("""
select doc_id, line_no, case when r <> lower(trim(name)) and regexp_matches(name, '[^\\x00-\\x7F]') then r else '' end search_text
from (select *, %s r from doc_lines)""" % V.reading_sql("name")))
def search_text(spark, sf):
    return with_alias_forms(V.doc_lines(spark, sf)).select("doc_id", "line_no", "search_text")


@query(sql_with("select full_path from ancestors"))
def ancestor_placeholders(spark, sf):
    return missing_ancestors(V.files(spark, sf)).select("full_path")


@query(sql_with("""
select path_key, len(parts) n, array_to_string(parts, '>') joined from (
  select path_key, list_filter(list_transform(string_split(lower(full_path), '/'), lambda x: trim(x)), lambda x: x <> '') parts from catalog)"""))
def path_components(spark, sf):
    parts = P.components(c("full_path"))
    return V.catalog(spark, sf).select("path_key", F.size(parts).alias("n"), F.array_join(parts, ">").alias("joined"))


@query(sql_with("select event_id, user_id + 8 ref from events"))
def segment_ref(spark, sf):
    tagged = (c("user_id") + 8).bitwiseOR(F.shiftleft(c("event_id") % 1000 + 1, 48))
    return V.table(spark, sf, "events").select("event_id", P.segment_ref(tagged).alias("ref"))


@query(sql_with("""
select distinct p_name, low||'|'||snake||case when snake <> kebab then '|'||kebab else '' end variants from (
  select p_name, replace(p_name, ' ', '') low, replace(p_name, ' ', '_') snake, replace(p_name, ' ', '-') kebab from part)"""))
def name_variants(spark, sf):
    token = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    names = V.table(spark, sf, "part").select("p_name").distinct()
    return names.select("p_name", F.array_join(P.name_variants(token), "|").alias("variants"))


@query(sql_with("""
select path_key, replace(replace(replace(name, '\\', '\\\\'), '%', '\\%'), '_', '\\_') escaped,
  name like '%' || replace(replace(replace(name, '\\', '\\\\'), '%', '\\%'), '_', '\\_') || '%' escape '\\' as self_hit,
  length(name) + length(name) + 1 + length(name) - length(replace(replace(replace(name, '\\', ''), '%', ''), '_', '')) ordered_size
from catalog"""))
def like_patterns(spark, sf):
    ordered = P.ordered_like(c("name"))
    return V.catalog(spark, sf).select(
        "path_key", P.escape_like(c("name")).alias("escaped"), F.like("name", ordered).alias("self_hit"),
        F.length(ordered).cast("long").alias("ordered_size"),
    )


@query(sql_with("select usn, " + ", ".join(f"(reason & {b}) <> 0 as {n}" for n, b in REASON_BITS.items()) + " from journal"))
def reason_bits(spark, sf):
    return V.journal(spark, sf).select("usn", *reason_flags(c("reason")))


_FORMATS_SQL = "select * from (values " + ", ".join(
    f"({q(e)}, {q(cat)}, {q(cap)}, {str(b).lower()})" for e, cat, cap, b in known_format_rows()
) + ") t(fext, fcategory, fcapability, fbinary)"


@query(sql_with("""
select path_key, coalesce(fcategory, 'unknown') category, coalesce(fcapability, 'none') capability, coalesce(fbinary, false) is_binary
from catalog left join formats on ext = fext where not is_directory
union all
select path_key||'.part1.rar', 'archive', 'extracted', true from catalog where not is_directory
union all
select path_key||'.fb2.zip', 'ebook', 'extracted', true from catalog where not is_directory""", formats=_FORMATS_SQL))
def format_info(spark, sf):
    files = V.catalog(spark, sf).where("not is_directory").select("path_key", "name", "ext")
    renamed = [
        files.select(F.concat("path_key", F.lit(s)).alias("path_key"), F.concat("name", F.lit(s)).alias("name"), F.lit(e).alias("ext"))
        for s, e in ((".part1.rar", "rar"), (".fb2.zip", "zip"))
    ]
    every = files.unionByName(renamed[0]).unionByName(renamed[1])
    return with_format_info(every).select("path_key", "category", "capability", "is_binary")


@query(sql_with("""
select ref, name, namespace from link_names l
where case when exists (select 1 from link_names k where k.ref = l.ref and k.namespace in ('win32', 'win32_and_dos'))
  then namespace in ('win32', 'win32_and_dos') else namespace <> 'dos' end"""))
def indexable_link_names(spark, sf):
    names = V.links(spark, sf).select("ref", F.explode("names").alias("n")).select("ref", "n.parent", "n.name", "n.namespace")
    return indexable_names(names).select("ref", "name", "namespace")


# --- filters ----------------------------------------------------------------------------

def _keys(condition, source=None):
    def run(spark, sf):
        return (source or V.catalog)(spark, sf).where(condition()).select("path_key")
    return run


def _filter(name, condition, sql, source=None):
    run = _keys(condition, source)
    run.__name__ = name
    query(sql_with(sql))(run)


_filter("filter_folders", lambda: flt.kind("folders"), "select path_key from catalog where is_directory")
_filter("filter_files", lambda: flt.kind("files"), "select path_key from catalog where not is_directory")
_filter("filter_applications", flt.applications, f"select path_key from catalog where {_APP_SQL}")
_filter("filter_extensions", lambda: flt.has_suffix(["tar.gz", "PDF", "txt"]),
        "select path_key from catalog where regexp_matches(lower(name), '\\.(tar\\.gz|pdf|txt)$')")
_filter("filter_without_extensions", lambda: flt.lacks_suffix(["gz", "txt", "com"]),
        "select path_key from catalog where not regexp_matches(lower(name), '\\.(gz|txt|com)$')")
_filter("filter_last_extension", lambda: flt.last_extension_in([".GZ", "md"]),
        "select path_key from catalog where not is_directory and ext in ('gz', 'md')")
_filter("filter_modified_since", lambda: flt.modified_since(F.lit("2023-12-15").cast("timestamp")),
        "select path_key from catalog where mtime >= timestamp '2023-12-15'")
_filter("filter_documents", lambda: flt.type_preset("documents"),
        "select path_key from catalog where not is_directory and ext in ('doc','docx','odt','pdf','ppt','pptx','rtf','txt','xls','xlsx')")
_filter("filter_images", lambda: flt.type_preset("images"),
        "select path_key from catalog where not is_directory and ext in ('bmp','gif','jpeg','jpg','png','svg','tif','tiff','webp')")
_filter("filter_videos", lambda: flt.type_preset("videos"),
        "select path_key from catalog where not is_directory and ext in ('avi','m4v','mkv','mov','mp4','mpeg','mpg','webm','wmv')")
_filter("filter_phrases", lambda: flt.contains_all(["Brand#1", "old "]),
        "select path_key from catalog where contains(path_key, 'brand#1') and contains(path_key, 'old ')")
_filter("filter_excluded_terms", lambda: flt.contains_none(["docs", "BOLT"]),
        "select path_key from catalog where not contains(path_key, 'docs') and not contains(path_key, 'bolt')")
_filter("filter_under_root", lambda: flt.under("/parts/Promo/Brand#1"),
        "select path_key from catalog where path_key = '/parts/promo/brand#1' or path_key like '/parts/promo/brand#1/%'")
_filter("filter_outside_folders", lambda: flt.outside_named_folders(["SRC3", "brand#7", "building"]),
        """select path_key from catalog where not regexp_matches(case when is_directory then path_key||'/' else parent_key||'/' end,
           '/(src3|brand#7|building)/')""")
_filter("filter_metadata_names", flt.not_metadata, "select path_key from catalog where name not like '$%'")
_filter("filter_name_prefix", lambda: flt.starts_with_variant("SpamFarm", "name_lower"),
        "select path_key from catalog where regexp_matches(lower(name), '^spam[_-]?farm')", V.stored_catalog)
_filter("filter_name_prefix_plain", lambda: flt.starts_with_variant("Doc-1", "name_lower"),
        "select path_key from catalog where lower(name) like 'doc-1%'", V.stored_catalog)
_filter("filter_has_alias", lambda: c("has_alias").cast("string") == "true", "select path_key from line_catalog where search_text <> ''", V.stored_lines)
_filter("filter_in_order", lambda: flt.in_order("rdBlt"),
        "select path_key from catalog where lower(name) like '%r%d%b%l%t%'")
_filter("filter_pinned_match", lambda: flt.pinned_match(["parts", "gear"], ["promo"]),
        "select path_key from catalog where contains(path_key, 'parts') and contains(path_key, 'gear') and not contains(path_key, 'promo')")


@query(sql_with("""
select 'today' preset, path_key from catalog where mtime >= timestamp '2024-02-01'
union all select '7d', path_key from catalog where mtime >= timestamp '2024-01-25'
union all select '30d', path_key from catalog where mtime >= timestamp '2024-01-02'
union all select '1y', path_key from catalog where mtime >= timestamp '2023-02-01'"""))
def filter_date_presets(spark, sf):
    rows = V.catalog(spark, sf)
    parts = [
        rows.where(flt.date_preset(p, V.as_of())).select(F.lit(p).alias("preset"), "path_key") for p in ("today", "7d", "30d", "1y")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_EXCLUDED_SQL = """regexp_matches(lower(full_path), '\\.(mp4|tar\\.gz)$') or regexp_matches(lower(full_path)||'/', '/(building|brand#7)/')
  or lower(full_path)||'/' like '/docs/de/%'"""


@query(sql_with(f"select full_path from catalog where not ({_EXCLUDED_SQL})"))
def filter_exclusion_table(spark, sf):
    return flt.drop_excluded(V.catalog(spark, sf).select("full_path"), V.exclusions(spark, sf))


@query(sql_with(f"select full_path from catalog where not ({_EXCLUDED_SQL})"))
def filter_exclusion_list(spark, sf):
    return V.catalog(spark, sf).where(flt.not_excluded(V.EXCLUSIONS)).select("full_path")


@query(sql_with("""
select full_path, true valid from files union all select substr(full_path, 2), false from files
union all select full_path||'/.', false from files union all select '  ', false from files"""))
def filter_valid_rows(spark, sf):
    good = V.files(spark, sf).select("full_path", "size_bytes")
    relative = good.withColumn("full_path", F.expr("substring(full_path, 2)"))
    dot = good.withColumn("full_path", F.concat("full_path", F.lit("/.")))
    blank = good.withColumn("full_path", F.lit("  "))
    ok, rejected = flt.split_valid(good.unionByName(relative).unionByName(dot).unionByName(blank))
    return ok.select("full_path", F.lit(True).alias("valid")).unionByName(rejected.select("full_path", F.lit(False).alias("valid")))


@query(sql_with("select usn, ref from journal where usn >= 200 and usn < 700000"))
def filter_journal_range(spark, sf):
    return V.journal(spark, sf).where(flt.journal_range(200, 700_000)).select("usn", "ref")


@query(sql_with("""
select root_key from all_roots r where not exists (
  select 1 from all_roots o where o.root_key <> r.root_key and starts_with(r.root_key, o.root_key||'/'))""", all_roots="""
select root_key from roots union select distinct lower(parent_path) from catalog where starts_with(path_key, '/docs/') or starts_with(path_key, '/customers/')"""))
def top_level_roots(spark, sf):
    """Given roots and all folders of two trees, without those below another."""
    inside = c("path_key").startswith("/docs/") | c("path_key").startswith("/customers/")
    folders = V.catalog(spark, sf).where(inside).select(c("parent_key").alias("path")).distinct()
    return top_roots(V.roots(spark, sf).select("path").unionByName(folders)).select("root_key")


@query(sql_with("""
select full_path from catalog where regexp_matches(path_key||'/', '^/(docs|parts|web|docsx)/')"""))
def rows_within_roots(spark, sf):
    return within_roots(V.catalog(spark, sf).select("full_path"), V.roots(spark, sf))
