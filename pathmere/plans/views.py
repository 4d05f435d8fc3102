"""Test views over the driver tables, once as DataFrames and once as SQL text.

Every view covers its whole tables. ``sql_with`` puts the views a query needs in front of it.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathmere.functions.alias import LETTER_GROUPS, TRANSLATE_FROM, TRANSLATE_TO
from pathmere.functions.journal import REASON_BITS
from pathmere.operators.aliases import with_alias_forms
from pathmere.operators.catalog import (
    CATALOG_COLUMNS, best_records, catalog_from, parts_for, with_path_columns, write_records,
)
from pathmere.operators.search import SearchRequest, request_table
from pathmere.operators.usage import roll_up
from pathmere.session import scratch_path, use_utc
from pathmere.sources.gram_index import build_index

AS_OF = "2024-02-01 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for costly text work on tables of few files; a no-op for large tables."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _after(start: str, amount, unit: str):
    return F.timestamp_add(unit, amount, F.lit(start).cast("timestamp"))


EXTENSIONS = ["pdf", "docx", "png", "mp4", "exe", "tar.gz", "lnk", "md"]


def files(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    part = table(spark, sf, "part")
    customer = table(spark, sf, "customer")
    nation = table(spark, sf, "nation")
    region = table(spark, sf, "region")
    pages = table(spark, sf, "pages")
    no, c = F.lit(False), F.col

    doc_files = catalog_from(
        docs, F.concat(F.lit("/docs/"), "lang", F.lit("/"), "source", F.lit("/doc-"), "doc_id", F.lit(".txt")),
        no, c("n_chars"), _after("2024-01-01", c("doc_id").cast("int"), "MINUTE"), c("doc_id") + 1,
    )
    ext = F.get(F.array(*[F.lit(e) for e in EXTENSIONS]), c("p_size") % 8)
    part_files = catalog_from(
        part,
        F.concat(F.lit("/parts/"), "p_type", F.lit("/"), "p_brand", F.lit("/"), "p_name", F.lit("-"), "p_partkey", F.lit("."), ext),
        no, F.round(c("p_retailprice") * 100), _after("2024-01-01", -c("p_size"), "DAY"), c("p_partkey") + 1_000_000,
    )
    located = customer.join(nation, c("c_nationkey") == c("n_nationkey")).join(region, c("n_regionkey") == c("r_regionkey"))
    card_files = catalog_from(
        located,
        F.concat(F.lit("/customers/"), "r_name", F.lit("/"), "n_name", F.lit("/"), "c_mktsegment", F.lit("/"), "c_name", F.lit(".vcf")),
        no, F.round(F.abs(c("c_acctbal")) * 100), _after("2023-06-01", c("c_custkey").cast("int"), "HOUR"), c("c_custkey") + 2_000_000,
    )
    bare = F.regexp_replace("url", r"[?#].*$", "")
    page_files = catalog_from(
        pages, F.concat(F.lit("/web/"), F.regexp_replace(bare, r"^https?://", "")), bare.endswith("/"),
        F.length("html"), _after("2024-01-15", c("page_id").cast("int"), "SECOND"), c("page_id") + 3_000_000,
    )
    return doc_files.unionByName(part_files).unionByName(card_files).unionByName(page_files)


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf: str, label: str, build, write) -> DataFrame:
    """Build a table once per session and data folder, then read the stored files."""
    key = (spark.sparkContext.applicationId, sf, label)
    if key not in _STORED:
        path = scratch_path(spark, label)
        write(build(), path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def stored_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog with the columns its files are laid out by: ``name_lower`` and ``has_alias``."""
    def write(records: DataFrame, path: str) -> None:
        parts = parts_for(records.count(), spark)
        write_records(best_records(records, parts), path, parts)

    return stored(use_utc(spark), sf, "catalog", lambda: files(spark, sf), write)


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    return stored_catalog(spark, sf).select(*CATALOG_COLUMNS)


def gram_index_folder(spark: SparkSession, sf: str) -> str:
    """The stored gram index of the catalog, built once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf, "grams")
    if key not in _STORED:
        path = scratch_path(spark, "grams")
        build_index(catalog(spark, sf), path)
        _STORED[key] = path
    return _STORED[key]


#: Characters of a document line, about; it only sets the number of files.
LINE_CHARS = 50


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of every document as a name."""
    docs = spread(table(spark, sf, "documents"))
    lines = docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "name"))
    return lines.where(F.trim("name") != "")


def stored_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The line catalog with the columns its files are laid out by."""
    def write(records: DataFrame, path: str) -> None:
        chars = table(spark, sf, "documents").agg(F.sum(F.length("text"))).first()[0] or 0
        write_records(records, path, parts_for(chars // LINE_CHARS, spark))

    return stored(use_utc(spark), sf, "lines", lambda: _line_records(spark, sf), write)


def line_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """A catalog whose names are document lines: long, accented, often repeated."""
    return stored_lines(spark, sf).select(*CATALOG_COLUMNS)


def line_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The line catalog as it is read: no copies of the lines are staged, sorted and stored first."""
    return with_alias_forms(with_path_columns(_line_records(use_utc(spark), sf))).select(*CATALOG_COLUMNS)


def _line_records(spark: SparkSession, sf: str) -> DataFrame:
    lines = doc_lines(spark, sf)
    safe = F.trim(F.replace(F.replace("name", F.lit("/"), F.lit(" ")), F.lit("\\"), F.lit(" ")))
    return lines.where(safe != "").select(
        F.concat(F.lit("/lines/"), "lang", F.lit("/"), "doc_id", F.lit("-"), "line_no", F.lit("/"), safe).alias("full_path"),
        F.lit(False).alias("is_directory"),
        F.length(safe).cast("long").alias("size_bytes"),
        F.lit(AS_OF).cast("timestamp").alias("mtime"),
        (F.col("doc_id") + 1).alias("file_reference"),
        F.lit(False).alias("structural"),
    )


def opens(spark: SparkSession, sf: str) -> DataFrame:
    """Open events of customer cards."""
    events = table(spark, sf, "events").where(F.col("event_type").isin("view", "click", "purchase"))
    cards = catalog(spark, sf).where(F.col("full_path").startswith("/customers/") & ~F.col("structural"))
    joined = events.join(cards, F.col("file_reference") == F.col("user_id") + 2_000_000)
    return joined.select("full_path", F.col("ts").cast("timestamp").alias("used_at"), "event_type", "event_id")


def usage(spark: SparkSession, sf: str) -> DataFrame:
    """The stored usage table."""
    plain = lambda df, path: df.write.parquet(path)
    return stored(use_utc(spark), sf, "usage", lambda: roll_up(opens(spark, sf)), plain)


PINNED = ["/docs/fr", "/parts/PROMO/", "/customers/ASIA", "/missing"]


def pinned(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in PINNED], "path string")


REQUESTS = {
    1: SearchRequest(terms=["red bolt-1.docx"], limit=20),
    2: SearchRequest(terms=["customer#0000000"], limit=500),
    3: SearchRequest(terms=["widget"], limit=300),
    4: SearchRequest(terms=["rdblt"], limit=100),
    5: SearchRequest(terms=["qqqqzz"]),
    6: SearchRequest(terms=["red", "bolt"], limit=20),
    7: SearchRequest(terms=["fr/src3"], limit=50),
    8: SearchRequest(phrases=["old anvil"], kind="files", limit=40),
    9: SearchRequest(terms=["ring"], excluded_terms=["promo"], exclude_ext=["pdf", "tar.gz"], limit=50),
    10: SearchRequest(include_ext=["tar.gz"], path_terms=["large/brand#7"], limit=30),
    11: SearchRequest(terms=["doc-1"], preferred_root="/docs/en/src1", limit=25),
    12: SearchRequest(kind="folders", limit=60),
    13: SearchRequest(terms=["gear"], required_ext=["md", "docx"], modified_after=datetime(2023, 12, 1), limit=50),
    14: SearchRequest(terms=["plate"], apps_only=True, limit=50),
    15: SearchRequest(path_terms=["asia", "building"], limit=40),
    16: SearchRequest(terms=["src"], kind="folders", limit=50),
}


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return request_table(use_utc(spark), REQUESTS)


ALIAS_REQUESTS = {
    1: SearchRequest(terms=["eleve"], limit=100),
    2: SearchRequest(terms=["gros"], limit=100),
    3: SearchRequest(terms=["en"], limit=50),
    4: SearchRequest(terms=["uber", "der"], limit=100),
    5: SearchRequest(terms=["fur"], limit=500),
}


def hints(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "click", "changed")
    kinds = kinds.when(F.col("event_type") == "purchase", "renamed").when(F.col("event_type") == "error", "deleted")
    user = F.col("user_id")
    path = lambda u: F.concat(F.lit("/u/"), (u % 10).cast("string"), F.lit("/"), u.cast("string"))
    rows = table(spark, sf, "events").where("event_type <> 'view'")
    return rows.select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), path(user).alias("full_path"),
        kinds.alias("kind"), F.when(F.col("event_type") == "purchase", path(user + 1)).alias("old_full_path"),
    )


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """Typed changes: customer cards created, modified, renamed, deleted and relinked by events."""
    e = table(spark, sf, "events")
    user = F.col("user_id")
    folder = F.concat(F.lit("/u/"), (user % 10).cast("string"), F.lit("/"))
    path = F.concat(folder, user.cast("string"), F.lit(".txt"))
    other = F.concat(folder, user.cast("string"), F.lit("-old.txt"))
    link = F.concat(F.lit("/links/"), user.cast("string"), F.lit(".txt"))
    kind = (
        F.when(F.col("event_type").isin("signup", "click"), "upsert").when(F.col("event_type") == "purchase", "rename")
        .when(F.col("event_type") == "error", "delete").when(F.col("value") > 40, "resync")
    )
    size = F.round(F.col("value") * 100).cast("long")
    at = F.col("ts").cast("timestamp")
    live = F.array(
        F.struct(path.alias("full_path"), F.lit(False).alias("is_directory"), size.alias("size_bytes"), at.alias("mtime")),
        F.struct(link.alias("full_path"), F.lit(False).alias("is_directory"), size.alias("size_bytes"), at.alias("mtime")),
    )
    return e.select(
        F.col("event_id").alias("usn"), kind.alias("kind"), path.alias("full_path"),
        F.when(kind == "rename", other).alias("old_full_path"), F.lit(False).alias("is_directory"),
        size.alias("size_bytes"), at.alias("mtime"),
        F.when((kind == "upsert") & (F.col("event_type") == "click"), 0).otherwise(user + 1).alias("file_reference"),
        F.when(kind == "resync", live).alias("live_records"),
    ).where("kind is not null")


def replay_base(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog the changes are applied to: one old card per customer that has events or not."""
    key = F.col("c_custkey")
    folder = F.concat(F.lit("/u/"), (key % 10).cast("string"), F.lit("/"), key.cast("string"))
    path = F.concat(folder, F.lit("-old.txt"))
    return table(spark, sf, "customer").select(
        path.alias("path_key"), path.alias("full_path"), F.lit(False).alias("is_directory"),
        F.round(F.abs("c_acctbal") * 100).cast("long").alias("size_bytes"), F.lit("2023-06-01").cast("timestamp").alias("mtime"),
        (key + 1).alias("file_reference"), F.lit(1).cast("long").alias("generation"),
    )


def snapshot(spark: SparkSession, sf: str, generation: int) -> DataFrame:
    """All orders; in the second generation a tenth of them have moved and every seventh is larger."""
    per_order = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").cast("long").alias("size_bytes"), F.max("l_shipdate").cast("timestamp").alias("mtime"),
        F.min("l_suppkey").alias("first_supplier"),
    )
    key, moved = F.col("l_orderkey"), F.lit("")
    if generation == 2:
        per_order = per_order.withColumn("size_bytes", F.col("size_bytes") + (key % 7 == 0).cast("long"))
        moved = F.when(key % 10 == 0, "-moved").otherwise("")
    path = F.concat(F.lit("/orders/"), (key % 100).cast("string"), F.lit("/"), key.cast("string"), moved)
    return per_order.select(
        path.alias("path_key"), path.alias("full_path"), F.lit(False).alias("is_directory"), "size_bytes", "mtime",
        F.when(F.col("first_supplier") % 5 == 0, 0).otherwise(F.col("l_orderkey") + 1).alias("file_reference"),
        F.lit(generation).cast("long").alias("generation"),
    )


def snap_old(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot(spark, sf, 1)


def snap_new(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot(spark, sf, 2)


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    return part.select(
        F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 8).cast("long").alias("parent_id"),
        F.concat("p_name", F.lit("-"), "p_partkey").alias("name"), F.lit(True).alias("is_directory"),
    )


def journal(spark: SparkSession, sf: str) -> DataFrame:
    bits = {"signup": "file_create", "click": "data_extend", "purchase": "rename_new_name", "error": "file_delete", "view": "close"}
    reason = F.lit(None).cast("long")
    for event, bit in bits.items():
        reason = F.when(F.col("event_type") == event, REASON_BITS[bit]).otherwise(reason)
    # expensive clicks change links; expensive errors are renames seen in one entry
    reason = F.when((F.col("event_type") == "click") & (F.col("value") > 100), REASON_BITS["hard_link_change"]).otherwise(reason)
    both = REASON_BITS["rename_old_name"] | REASON_BITS["close"]
    reason = F.when((F.col("event_type") == "error") & (F.col("value") > 150), both).otherwise(reason)
    ref = F.col("user_id") + 8
    return table(spark, sf, "events").select(
        ref.alias("ref"), F.floor(ref / 8).cast("long").alias("parent_ref"), F.concat(F.lit("n"), F.col("user_id")).alias("name"),
        (ref < 20).alias("is_dir"), F.col("event_id").alias("usn"), reason.cast("long").alias("reason"),
    )


def journal_folders(spark: SparkSession, sf: str) -> DataFrame:
    """Known folders for the journal: one per small part key below a volume root."""
    return table(spark, sf, "part").where("p_size > 3").select(
        F.col("p_partkey").alias("id"),
        F.concat(F.when(F.col("p_size") > 40, "/other/").otherwise("/vol/"), "p_name", F.lit("-"), "p_partkey").alias("full_path"),
    )


def links(spark: SparkSession, sf: str) -> DataFrame:
    """Records with stored names; small parts have a second name, large ones a short alias."""
    name = lambda suffix, space: F.struct(
        F.floor(F.col("p_partkey") / 8).cast("long").alias("parent"),
        F.concat("p_name", F.lit(suffix), F.col("p_partkey")).alias("name"), F.lit(space).alias("namespace"),
    )
    none = F.array().cast("array<struct<parent:bigint,name:string,namespace:string>>")
    names = F.concat(
        F.array(name("-", "win32")),
        F.when(F.col("p_size") <= 5, F.array(name("=", "posix"), name("+", "win32_and_dos"))).otherwise(none),
        F.when(F.col("p_size") > 40, F.array(name("~", "dos"))).otherwise(none),
    )
    posix_only = F.array(name("-", "posix"), name("~", "dos"))
    names = F.when(F.col("p_size") == 20, posix_only).otherwise(names)
    refs = F.when(F.col("p_size") == 30, F.array(F.col("p_partkey"), F.col("p_partkey") + 1)).otherwise(F.array().cast("array<bigint>"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("ref"), names.alias("names"), refs.alias("ext_refs"))


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("value") > 60, "cancelled").otherwise("success")
    operation = F.when(F.col("user_id") < 75, "search").otherwise("index")
    return table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("id"), operation.alias("operation"),
        F.col("ts").cast("timestamp").alias("started_at"), F.col("value").alias("total_ms"), outcome.alias("outcome"),
        F.length("props").cast("long").alias("result_count"),
        F.create_map(F.lit("read"), k, F.lit("rank"), F.col("value") / 2).alias("stages"),
        F.create_map(F.lit("candidates"), k.cast("long")).alias("counters"),
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select(
        F.col("event_type").alias("scenario"), F.when(k < 50, "baseline").otherwise("optimized").alias("variant"),
        "value", (F.col("value") < 450).alias("semantic_ok"),
    )


def query_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq")
    )


def items(spark: SparkSession, sf: str) -> DataFrame:
    customer, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    none = F.array().cast("array<string>")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"), F.concat("c_mktsegment", F.lit(" "), F.col("c_custkey")).alias("name"),
        F.concat(F.lit("segment of "), "n_name").alias("details"),
        F.when(F.col("c_acctbal") > 0, F.array("c_name", "n_name")).otherwise(none).alias("aliases"),
        F.when(F.col("c_nationkey") == 3, "").otherwise(F.col("n_name")).alias("identity"),
        F.when(F.col("c_acctbal") > 9000, F.concat(F.lit("/icons/"), F.col("c_custkey"))).alias("icon_path"),
    )


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("seq"), F.concat(F.lit("/work/"), F.col("s_nationkey"), F.lit("/")).alias("folder_path"),
        F.when(F.col("s_acctbal") > 5000, "shell").otherwise("commander").alias("source"),
        (F.col("s_acctbal") > 8000).alias("is_foreground"),
    )


EXCLUSIONS = ["*.mp4", "BUILDING", "/docs/de", "*.tar.gz", " Brand#7 "]
ROOTS = ["/docs", "/docs/fr", "/parts", "/PARTS", "/web/", "/docsx"]


def exclusions(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in EXCLUSIONS], "value string")


def roots(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in ROOTS], "path string")


def turn_mailboxes(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation turn as a mailbox text of two messages: the turn and a notice about it."""
    turn, conv = F.col("turn").cast("string"), F.col("conv_id").cast("string")
    text = F.concat(
        F.lit("From turn@"), "role", F.lit(" now\nFrom: "), "role", F.lit("@example.org\nX-Pad: a\nDate: day "), turn,
        F.lit("\nSubject: turn "), turn, F.lit("\n of "), conv, F.lit("\n\n"), F.regexp_replace("text", "(?m)^From ", ">From "),
        F.lit("\nFrom notice now\nSubject: seen "), turn, F.lit("\n\nend\n"),
    )
    return table(spark, sf, "conversations").select(F.concat(conv, F.lit("-"), turn).alias("box"), text.alias("text"))


# --- the same views in SQL ---------------------------------------------------------------

def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def transliterate_sql(x: str) -> str:
    out = f"translate(lower({x}), {q(TRANSLATE_FROM)}, {q(TRANSLATE_TO)})"
    for letter, group in LETTER_GROUPS.items():
        out = f"replace({out}, {q(letter)}, {q(group)})"
    return f"replace({out}, ' ', '')"


def reading_sql(name: str) -> str:
    return (
        rf"case when regexp_matches({name}, '[^\x00-\x7F]') and {transliterate_sql(name)} <> '' "
        f"then {transliterate_sql(name)} else {name} end"
    )


def list_sql(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]::varchar[]"


def requests_sql(items: dict[int, SearchRequest]) -> str:
    rows = []
    for qid, r in items.items():
        after = f"timestamp '{r.modified_after}'" if r.modified_after else "null::timestamp"
        root = q(r.preferred_root) if r.preferred_root else "null::varchar"
        lists = ", ".join(
            list_sql(v) for v in (r.terms, r.phrases, r.path_terms, r.include_ext, r.exclude_ext, r.excluded_terms, r.required_ext)
        )
        rows.append(f"({qid}, {lists}, {q(r.kind)}, {str(r.apps_only).lower()}, {after}, {root}, {r.limit})")
    names = "query_id, terms, phrases, path_terms, include_ext, exclude_ext, excluded_terms, required_ext, kind, apps_only, modified_after, preferred_root, lim"
    return f"select * from (values {', '.join(rows)}) t({names})"


def _catalog_sql(source: str) -> str:
    return f"""
select full_path, lower(full_path) path_key, name, parent_path, lower(parent_path) parent_key,
  lower(regexp_extract(name, '\\.([^.]*)$', 1)) ext, is_directory, size_bytes, mtime, file_reference, structural,
  reading, reading initials,
  case when reading <> lower(trim(name)) and regexp_matches(name, '[^\\x00-\\x7F]') then reading else '' end search_text
from (select *, {reading_sql('name')} reading from (
  select *, string_split(full_path, '/')[-1] as name,
    case when regexp_replace(full_path, '/[^/]*$', '') = '' then '/' else regexp_replace(full_path, '/[^/]*$', '') end parent_path
  from ({source})))"""


_SNAP = """select '/orders/'||(l_orderkey % 100)||'/'||l_orderkey||{moved} path_key, '/orders/'||(l_orderkey % 100)||'/'||l_orderkey||{moved} full_path,
  false is_directory, cast(sum(l_quantity) as bigint) + {more} size_bytes, max(l_shipdate) mtime,
  case when min(l_suppkey) % 5 = 0 then 0 else l_orderkey + 1 end file_reference, {gen} generation
from lineitem group by l_orderkey"""

VIEWS = {
    "files": f"""
select '/docs/'||lang||'/'||source||'/doc-'||doc_id||'.txt' full_path, false is_directory, n_chars size_bytes,
  timestamp '2024-01-01' + doc_id * interval 1 minute mtime, doc_id + 1 file_reference from documents
union all
select '/parts/'||p_type||'/'||p_brand||'/'||p_name||'-'||p_partkey||'.'||({list_sql(EXTENSIONS)})[p_size % 8 + 1], false,
  cast(round(p_retailprice * 100) as bigint), timestamp '2024-01-01' - p_size * interval 1 day, 1000000 + p_partkey from part
union all
select '/customers/'||r_name||'/'||n_name||'/'||c_mktsegment||'/'||c_name||'.vcf', false,
  cast(round(abs(c_acctbal) * 100) as bigint), timestamp '2023-06-01' + c_custkey * interval 1 hour, 2000000 + c_custkey
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
union all
select '/web/'||regexp_replace(regexp_replace(regexp_replace(url,'^https?://',''),'[?#].*$',''),'/+$',''),
  regexp_matches(regexp_replace(url,'[?#].*$',''),'/$'), cast(length(html) as bigint),
  timestamp '2024-01-15' + page_id * interval 1 second, 3000000 + page_id from pages""",
    "ancestors": """
select distinct array_to_string(parts[1:i], '/') full_path
from (select string_split(full_path, '/') parts from files), lateral (select unnest(range(2, len(parts))) i)""",
    "catalog": _catalog_sql("""
  select * from (
    select full_path, is_directory, size_bytes, mtime, file_reference, false structural from files
    union all select full_path, true, 0, timestamp '1970-01-01', 0, true from ancestors)
  qualify row_number() over (partition by lower(full_path) order by structural, file_reference, full_path) = 1"""),
    "doc_lines": """
select * from (select doc_id, lang, unnest(range(0, len(ls))) line_no, unnest(ls) as name
from (select doc_id, lang, string_split(text, chr(10)) ls from documents)) where trim(name) <> ''""",
    "line_catalog": _catalog_sql("""
  select '/lines/'||lang||'/'||doc_id||'-'||line_no||'/'||safe full_path, false is_directory, cast(length(safe) as bigint) size_bytes,
    timestamp '2024-02-01' mtime, doc_id + 1 file_reference, false structural
  from (select *, trim(translate(name, '/\\', '  ')) safe from doc_lines) where safe <> ''"""),
    "opens": """
select f.full_path, ts used_at, event_type, event_id from events join files f on f.file_reference = 2000000 + user_id
where event_type in ('view', 'click', 'purchase') and f.full_path like '/customers/%'""",
    "usage": """
select lower(full_path) path_key, full_path, count(*) open_count, max(used_at) last_used_at from opens group by 1, 2""",
    "hints": """
select event_id seq, ts, '/u/'||(user_id % 10)||'/'||user_id full_path,
  case event_type when 'signup' then 'created' when 'click' then 'changed' when 'purchase' then 'renamed' else 'deleted' end kind,
  case when event_type = 'purchase' then '/u/'||((user_id + 1) % 10)||'/'||(user_id + 1) end old_full_path
from events where event_type <> 'view'""",
    "snap_old": _SNAP.format(gen=1, moved="''", more="0"),
    "snap_new": _SNAP.format(gen=2, moved="case when l_orderkey % 10 = 0 then '-moved' else '' end", more="(l_orderkey % 7 = 0)::bigint"),
    "nodes": "select p_partkey id, p_partkey // 8 parent_id, p_name||'-'||p_partkey as name from part",
    "journal": f"""
select user_id + 8 ref, (user_id + 8) // 8 parent_ref, 'n'||user_id as name, user_id + 8 < 20 is_dir, event_id usn,
  case when event_type = 'error' and value > 150 then {REASON_BITS['rename_old_name'] | REASON_BITS['close']}
    when event_type = 'click' and value > 100 then {REASON_BITS['hard_link_change']}
    when event_type = 'signup' then {REASON_BITS['file_create']} when event_type = 'click' then {REASON_BITS['data_extend']}
    when event_type = 'purchase' then {REASON_BITS['rename_new_name']} when event_type = 'error' then {REASON_BITS['file_delete']}
    else {REASON_BITS['close']} end::bigint reason
from events""",
    "journal_folders": """
select p_partkey id, case when p_size > 40 then '/other/' else '/vol/' end||p_name||'-'||p_partkey full_path
from part where p_size > 3""",
    "link_names": """
select p_partkey ref, p_partkey // 8 parent, p_name||sep||p_partkey as name, namespace from part,
  (values ('-', 'win32', 0), ('=', 'posix', 1), ('+', 'win32_and_dos', 1), ('~', 'dos', 2), ('-', 'posix', 3), ('~', 'dos', 3)) s(sep, namespace, rule)
where case rule when 0 then p_size <> 20 when 1 then p_size <= 5 when 2 then p_size > 40 else p_size = 20 end""",
    "all_names": """
select * from link_names
union all select p.p_partkey, n.parent, n.name, n.namespace from part p join link_names n on n.ref = p.p_partkey + 1 where p.p_size = 30""",
    "metrics": """
select event_id, case when user_id < 75 then 'search' else 'index' end operation, ts started_at, value total_ms,
  case when event_type = 'error' then 'failed' when value > 60 then 'cancelled' else 'success' end outcome,
  cast(props->>'$.k' as double) k from events""",
    "runs": """
select event_type scenario, case when cast(props->>'$.k' as int) < 50 then 'baseline' else 'optimized' end variant, value,
  value < 450 semantic_ok from events""",
    "items": """
select c_custkey id, c_mktsegment||' '||c_custkey as name, 'segment of '||n_name details,
  case when c_acctbal > 0 then [c_name, n_name] else []::varchar[] end aliases,
  case when c_nationkey = 3 then '' else n_name end identity,
  case when c_acctbal > 9000 then '/icons/'||c_custkey end icon_path
from customer join nation on c_nationkey = n_nationkey""",
    "candidates": """
select s_suppkey seq, '/work/'||s_nationkey folder_path, case when s_acctbal > 5000 then 'shell' else 'commander' end source,
  s_acctbal > 8000 is_foreground from supplier""",
    "pinned": f"select lower(rtrim(p, '/')) path_key from (select unnest({list_sql(PINNED)}) p)",
    "exclusions": f"select lower(trim(v)) v from (select unnest({list_sql(EXCLUSIONS)}) v)",
    "roots": f"select distinct lower(rtrim(v, '/')) root_key from (select unnest({list_sql(ROOTS)}) v)",
    "requests": requests_sql(REQUESTS),
    "alias_requests": requests_sql(ALIAS_REQUESTS),
}


def sql_with(body: str, **extra: str) -> str:
    """Prefix a query with the views it reads, dependencies first."""
    available = {**VIEWS, **extra}
    ordered: list[str] = []

    def need(text: str, current: str = "") -> None:
        for word in re.findall(r"[a-z_]+", text):
            if word in available and word != current and word not in ordered:
                need(available[word], word)
                if word not in ordered:
                    ordered.append(word)

    need(body)
    if not ordered:
        return body
    return "with " + ",\n".join(f"{v} as ({available[v]})" for v in ordered) + "\n" + body
