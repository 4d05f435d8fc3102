"""Ranked search over a catalog, for one request or a table of requests.

All matching rows are ranked; the only cut is the requested number of results. Filters come
first, scoring runs on rows that can match, usage joins the few survivors.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathmere.functions import paths as P
from pathmere.functions import scoring as S
from pathmere.operators import filters as flt
from pathmere.session import filter_once, scratch_path

DEFAULT_LIMIT = 50
PAGE_SIZE = 50
#: The first keys of the rank order need neither usage nor pins.
FIXED_KEYS = 5
FIXED_COLUMNS = ("root_priority", "tier", "quality", "length_diff", "is_app")
#: Largest rank that Spark cuts before the shuffle of a window (its default threshold).
GROUP_LIMIT = 1000

REQUEST_SCHEMA = (
    "query_id long, terms array<string>, phrases array<string>, path_terms array<string>, "
    "include_ext array<string>, exclude_ext array<string>, excluded_terms array<string>, "
    "required_ext array<string>, kind string, apps_only boolean, modified_after timestamp, "
    "preferred_root string, limit int"
)


def _lower(values: Sequence[str]) -> list[str]:
    return [v.strip().lower() for v in values if v.strip()]


@dataclass(frozen=True)
class SearchRequest:
    """One request. Text lists are lower-cased; ``limit`` is the only cut of its result."""

    terms: Sequence[str] = ()
    phrases: Sequence[str] = ()
    path_terms: Sequence[str] = ()
    include_ext: Sequence[str] = ()
    exclude_ext: Sequence[str] = ()
    excluded_terms: Sequence[str] = ()
    required_ext: Sequence[str] = ()
    kind: str = "any"
    apps_only: bool = False
    modified_after: datetime | None = None
    preferred_root: str | None = None
    limit: int = field(default=DEFAULT_LIMIT)

    def __post_init__(self) -> None:
        if self.limit <= 0:
            raise ValueError("limit must be positive")
        for name in ("terms", "phrases", "path_terms", "excluded_terms"):
            object.__setattr__(self, name, _lower(getattr(self, name)))
        for name in ("include_ext", "exclude_ext", "required_ext"):
            object.__setattr__(self, name, [v.lstrip(".") for v in _lower(getattr(self, name))])

    @property
    def has_text(self) -> bool:
        return bool(self.terms or self.phrases)


def request_table(spark: SparkSession, requests: dict[int, SearchRequest]) -> DataFrame:
    names = [part.split()[0] for part in REQUEST_SCHEMA.split(", ")]
    rows = [tuple([qid] + [asdict(r)[n] for n in names[1:]]) for qid, r in requests.items()]
    return spark.createDataFrame(rows, REQUEST_SCHEMA)


# --- one request -----------------------------------------------------------------------

def request_filter(request: SearchRequest) -> Column:
    """All yes/no conditions of a request as one native predicate."""
    cond = flt.kind(request.kind) & flt.last_extension_in(request.required_ext)
    if request.apps_only:
        cond = cond & flt.applications()
    if request.modified_after is not None:
        cond = cond & flt.modified_since(F.lit(request.modified_after))
    if request.include_ext:
        cond = cond & flt.has_suffix(request.include_ext)
    if request.exclude_ext:
        cond = cond & flt.lacks_suffix(request.exclude_ext)
    if request.excluded_terms:
        cond = cond & flt.contains_none(request.excluded_terms)
    return cond & flt.contains_all(request.phrases) & flt.matches_path_terms(request.path_terms)


def may_match(request: SearchRequest) -> Column:
    """Cheap necessary condition: every text part occurs, in order, in some form of the row."""
    cond = F.lit(True)
    for text, fuzzy in [(p, False) for p in request.phrases] + [(t, True) for t in request.terms]:
        letters = S.subsequence_pattern(text)
        if fuzzy:
            aliases = F.lower("reading").rlike(letters) | F.lower("initials").rlike(letters)
            part = F.col("_name").rlike(letters) | (F.col("_has_alias") & aliases)
        else:
            part = F.col("_name").contains(text)
        part = part | (F.col("name").contains("%") & (F.col("_leaf") == text))
        if "/" in text or "\\" in text:
            pieces = [x.strip() for x in text.replace("\\", "/").split("/") if x.strip()]
            part = part | flt.contains_all(pieces)
        cond = cond & part
    return cond


def matches(catalog: DataFrame, request: SearchRequest) -> DataFrame:
    """Matching rows with tier, quality, length_diff, score and match_reason; not ranked."""
    rows = catalog.where(request_filter(request))
    if not request.has_text:
        return rows.withColumns(_filter_only_columns())
    strings = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    keys = S.all_keys(strings(request.terms), strings(request.phrases), S.NameForms.of_catalog())
    named = S.with_match_columns(rows).where(may_match(request))
    hits = filter_once(named, {"_keys": keys}, S.all_matched(F.col("_keys")))
    return _unpack_key(hits.withColumn("_key", S.combine_keys(F.col("_keys"))))


def _filter_only_columns() -> dict[str, Column]:
    return {
        "tier": F.lit(0), "quality": F.lit(1.0), "length_diff": F.lit(0),
        "score": F.lit(1.0), "match_reason": F.lit("filter"),
    }


def _unpack_key(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "tier": F.col("_key.tier"),
            "quality": F.col("_key.quality"),
            "length_diff": F.col("_key.length_diff"),
            "score": S.display_score(F.col("_key.tier"), F.col("_key.quality")),
            "match_reason": F.col("_key.reason"),
        }
    ).drop("_key", "_keys", *S.MATCH_COLUMNS)


def with_tie_breakers(
    matched: DataFrame,
    has_text: Column,
    preferred_root: Column,
    usage: DataFrame | None,
    pinned: DataFrame | None,
    as_of: Column,
    best: int | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Add root priority, application flag, pin, open count and recency.

    With ``best`` only rows that can be among the best of each ``by`` group meet usage and pins.
    """
    out = matched.withColumns(fixed_columns(preferred_root))
    if best is not None and not (usage is None and pinned is None):
        out = contenders(out, best, by)
    if usage is None:
        out = out.withColumns({"open_count": F.lit(0).cast("long"), "recency": F.lit(0.0)})
    else:
        opened = usage.select("path_key", F.col("open_count").cast("long").alias("_opens"), "last_used_at")
        out = (
            out.join(opened, "path_key", "left")
            .withColumn("open_count", F.coalesce("_opens", F.lit(0)))
            .withColumn("recency", S.recency(F.col("last_used_at"), as_of))
            .drop("_opens", "last_used_at")
        )
    if pinned is None:
        return out.withColumn("is_pinned", F.lit(False))
    pins = pinned_keys(pinned)
    flagged = out.join(pins.withColumn("_pin", F.lit(True)), "path_key", "left")
    # with text only folders profit from a pin, without text every kind does
    pin = F.coalesce("_pin", F.lit(False)) & (F.col("is_directory") | ~has_text)
    return flagged.withColumn("is_pinned", pin).drop("_pin")


def fixed_columns(preferred_root: Column) -> dict[str, Column]:
    """The fixed keys of the rank order that are not part of the match."""
    return {
        "root_priority": S.root_priority(F.col("parent_key"), preferred_root),
        "is_app": P.is_application(F.col("full_path"), F.col("is_directory")),
    }


def contenders(rows: DataFrame, best: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows that the part of the rank order known before usage leaves among the first ``best``.

    Each input partition is cut on its own, where it lies, and keeps all ties of its last place:
    a row of the final top has fewer than ``best`` rows before it in its partition, too.
    """
    if best > GROUP_LIMIT:
        return rows
    place = F.rank().over(Window.partitionBy("_slice", *by).orderBy(*rank_order()[:FIXED_KEYS]))
    placed = rows.withColumn("_slice", F.spark_partition_id()).withColumn("_place", place)
    return placed.where(F.col("_place") <= best).drop("_slice", "_place")


def pinned_keys(pinned: DataFrame) -> DataFrame:
    return (
        pinned.select(P.path_key(P.norm_path(F.col("path"))).alias("path_key"))
        .where("path_key is not null")
        .distinct()
    )


def rank_order() -> list[Column]:
    """The one total order of results; the path is unique, so there are no ties."""
    return [
        F.col("root_priority").asc(), F.col("tier").asc(), F.col("quality").desc(),
        F.col("length_diff").asc(), F.col("is_app").desc(), F.col("is_pinned").desc(),
        F.col("open_count").desc(), F.col("recency").desc(),
        F.lower("name").asc(), F.col("name").asc(), F.col("path_key").asc(), F.col("full_path").asc(),
    ]


def search(
    catalog: DataFrame,
    request: SearchRequest,
    usage: DataFrame | None = None,
    pinned: DataFrame | None = None,
    as_of: Column | None = None,
    first_rank: int = 1,
) -> DataFrame:
    """Best ``limit`` rows in rank order, numbered by ``rank`` (from ``first_rank`` on: paging)."""
    as_of = _as_of(usage, as_of)
    ready = with_tie_breakers(
        matches(catalog, request), F.lit(request.has_text), F.lit(request.preferred_root).cast("string"),
        usage, pinned, as_of, request.limit if request.has_text else None,
    )
    top = ready.orderBy(*rank_order()).limit(request.limit)
    # only ``limit`` rows reach this window
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*rank_order())))
    return ranked.where(F.col("rank") >= first_rank)


def _as_of(usage: DataFrame | None, as_of: Column | None) -> Column:
    """The time recency is counted from; it must be given with usage."""
    if usage is not None and as_of is None:
        raise ValueError("as_of is required with usage")
    return F.lit(None).cast("timestamp") if as_of is None else as_of


def page(results: DataFrame, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """Page ``number`` (from 1) of ranked results."""
    return results.where(F.col("rank").between((number - 1) * size + 1, number * size))


# --- a table of requests ---------------------------------------------------------------

# Signs, digits and letters of names from common to rare; any other character counts as rarest.
LETTERS_BY_FREQUENCY = "-_. 1023456789etaoinsrhldcumfpgwybvkxjqz"


def _rarest_char(text: Column) -> Column:
    ranked = F.transform(
        F.filter(chars_without_blanks(text), lambda ch: ~ch.isin("/", "\\")),
        lambda ch: F.struct(
            F.coalesce(F.nullif(F.position(ch, F.lit(LETTERS_BY_FREQUENCY)), F.lit(0)), F.lit(99)).alias("r"),
            ch.alias("ch"),
        ),
    )
    return F.array_max(ranked)["ch"]


def chars_without_blanks(text: Column) -> Column:
    return F.filter(P.chars(text), lambda ch: P.strip(ch) != "")


def request_join_key(requests: DataFrame) -> DataFrame:
    """Equi-join keys of each request: every matching row is certain to carry one, and only one.

    A text hit needs every character of the text in some form of the name, so the rarest
    character is a safe key; text with separators and path terms are keyed on the path. Pure
    filters are keyed on their extensions (a row has one), on applications or on the kind. Only
    a request that names none of these, whose result is nearly every row, has the key '*'.
    """
    parts = F.concat("phrases", "terms")
    plain = F.filter(parts, lambda t: ~t.rlike(r"[\\/]"))
    pathlike = F.concat(F.filter(parts, lambda t: t.rlike(r"[\\/]")), F.col("path_terms"))
    last = lambda names: F.array_distinct(F.transform(names, lambda e: F.concat(F.lit("x:"), F.substring_index(e, ".", -1))))
    single = F.coalesce(
        F.concat(F.lit("n:"), _rarest_char(F.array_join(plain, ""))),
        F.concat(F.lit("p:"), _rarest_char(F.array_join(pathlike, ""))),
    )
    keys = (
        F.when(single.isNotNull(), F.array(single))
        .when(F.size("required_ext") > 0, last(F.col("required_ext")))
        .when(F.size("include_ext") > 0, last(F.col("include_ext")))
        .when(F.col("apps_only"), F.array(F.lit("app")))
        .when(F.col("kind") != "any", F.array(F.concat(F.lit("k:"), "kind")))
        .otherwise(F.array(F.lit("*")))
    )
    return requests.withColumn("_key_char", F.explode(keys))


def row_join_keys(text: Column, wanted: Column) -> Column:
    """The ``wanted`` keys a catalog row can be reached by; ``text`` holds all forms of its name."""
    def letters(of: Column, mark: str) -> Column:
        own = F.transform(F.filter(wanted, lambda k: F.startswith(k, F.lit(mark))), lambda k: F.substring(k, 3, 2))
        # few letters are looked up, many are met with those of the text
        found = F.when(F.size(own) <= MASK_BITS, F.filter(own, lambda ch: F.contains(of, ch))).otherwise(F.array_intersect(own, F.split(of, "")))
        return F.transform(found, lambda ch: F.concat(F.lit(mark), ch))

    others = F.array(
        F.concat(F.lit("x:"), F.col("ext")),
        F.when(P.is_application(F.col("full_path"), F.col("is_directory")), F.lit("app")),
        F.when(F.col("is_directory"), F.lit("k:folders")).otherwise(F.lit("k:files")),
        F.lit("*"),
    )
    return F.concat(letters(text, "n:"), letters(F.col("path_key"), "p:"), F.array_intersect(others, wanted))


#: Letters that a mask tells apart.
MASK_BITS = 64


def letter_mask(text: Column, letters: Column | None = None) -> Column:
    """One bit for each of up to 64 ``letters`` that occurs: a row misses a request whose bits it lacks.

    Without ``letters`` all characters share the bits, by classes.
    """
    zero = F.lit(0).cast("long")
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    if letters is not None:
        bits = F.transform(letters, lambda ch, i: F.when(F.contains(text, ch), bit(i)).otherwise(zero))
        return F.aggregate(bits, zero, lambda mask, b: mask.bitwiseOR(b))
    listed = F.array_distinct(F.filter(F.split(text, ""), lambda ch: P.strip(ch) != ""))
    return F.aggregate(listed, zero, lambda mask, ch: mask.bitwiseOR(bit(F.pmod(F.xxhash64(ch), F.lit(MASK_BITS)).cast("int"))))


def name_text() -> Column:
    """All forms of a row's name that a text may match."""
    return F.concat_ws(
        " ",
        F.col("_name"),
        F.when(F.col("_leaf") != F.col("_name"), F.col("_leaf")),
        F.when(F.col("_has_alias"), F.lower(F.concat_ws(" ", "reading", "initials"))),
    )


def pair_filter() -> Column:
    """Request conditions over a joined (row, request) pair."""
    name_low = F.lower("name")
    suffix = lambda e: F.endswith(name_low, F.concat(F.lit("."), e))
    path = F.col("path_key")
    return (
        ((F.col("kind") == "any") | (F.col("is_directory") == (F.col("kind") == "folders")))
        & ((F.size("required_ext") == 0)
           | (~F.col("is_directory") & F.array_contains(F.col("required_ext"), F.col("ext"))))
        & (~F.col("apps_only") | P.is_application(F.col("full_path"), F.col("is_directory")))
        & (F.col("modified_after").isNull() | (F.col("mtime") >= F.col("modified_after")))
        & ((F.size("include_ext") == 0) | F.exists("include_ext", suffix))
        & ~F.exists("exclude_ext", suffix)
        & ~F.exists("excluded_terms", lambda t: F.contains(path, t))
        & F.forall("phrases", lambda t: F.contains(path, t))
        & F.forall("path_terms", lambda t: S.path_match(F.col("full_path"), t))
    )


def request_keys(requests: DataFrame) -> tuple[DataFrame, Column]:
    """Requests with their join keys and letter masks, and the letters of the masks.

    They are staged, so that the planner knows their size: a few meet the rows where these lie.
    """
    spark = requests.sparkSession
    lists = ("terms", "phrases", "path_terms", "include_ext", "exclude_ext", "excluded_terms", "required_ext")
    requests = requests.withColumns({name: F.transform(name, F.lower) for name in lists})
    plain = F.filter(F.concat("phrases", "terms"), lambda t: ~t.rlike(r"[\\/]"))
    staged = scratch_path(spark, "requests")
    keyed = request_join_key(requests).withColumn("_plain", F.array_join(plain, "")).hint("rebalance")
    keyed.write.parquet(staged)
    keyed = spark.read.schema(keyed.schema).parquet(staged)
    # the letters of any request; beyond the bits of a mask the others are left to the match itself
    letters = keyed.select(F.explode(chars_without_blanks(F.col("_plain"))).alias("ch")).agg(F.slice(F.array_sort(F.collect_set("ch")), 1, MASK_BITS)).first()[0]
    letters = F.array(*map(F.lit, letters)).cast("array<string>")
    return keyed.withColumn("_needs", letter_mask(F.col("_plain"), letters)).drop("_plain"), letters


def has_text() -> Column:
    return F.size(F.concat("terms", "phrases")) > 0


def matching_pairs(catalog: DataFrame, keyed: DataFrame, letters: Column) -> DataFrame:
    """Every (row, request) pair that matches, with its tier, quality, length_diff, score and match_reason."""
    # the keys that any request uses: single characters and extensions
    wanted = keyed.agg(F.collect_set("_key_char").alias("k")).select("k").scalar()
    rows = filter_once(S.with_match_columns(catalog), {"_text": name_text(), "_wanted": wanted}, F.lit(True))
    rows = filter_once(rows, {"_has": letter_mask(F.col("_text"), letters), "_reached": row_join_keys(F.col("_text"), F.col("_wanted"))}, F.size("_reached") > 0)
    rows = rows.withColumn("_key_char", F.explode("_reached")).drop("_reached", "_text", "_wanted")
    rows, keyed = rows.alias("r"), keyed.alias("q")
    pairs = rows.join(keyed, (F.col("r._key_char") == F.col("q._key_char")) & (F.col("_has").bitwiseAND(F.col("_needs")) == F.col("_needs"))).drop("_key_char", "_has", "_needs")
    keys = S.all_keys(F.col("terms"), F.col("phrases"), S.NameForms.of_catalog())
    fitting = filter_once(pairs, {"_fits": pair_filter()}, F.col("_fits")).drop("_fits")
    hits = filter_once(fitting, {"_keys": keys}, ~has_text() | S.all_matched(F.col("_keys")))
    combined = hits.withColumn("_key", F.when(has_text(), S.combine_keys(F.col("_keys"))))
    return _unpack_key(combined).withColumns(
        {
            name: F.coalesce(name, default)
            for name, default in _filter_only_columns().items()
        }
    )


def leading_rows(catalog: DataFrame, pairs: DataFrame, best: int) -> DataFrame:
    """Catalog rows that the fixed keys of the order leave among the first ``limit`` of any request, ties kept.

    Only the fixed keys and a hash of the path key are sorted and shuffled, names and paths are not; the
    rows are then read again by that hash. Another row of the same hash does no harm: all of them are ranked.
    """
    spark = catalog.sparkSession
    fixed = pairs.withColumns({**fixed_columns(F.col("preferred_root")), "_row": F.xxhash64("path_key")})
    place = F.rank().over(Window.partitionBy("query_id").orderBy(*rank_order()[:FIXED_KEYS]))
    narrow = fixed.select("query_id", "limit", *FIXED_COLUMNS, "_row").withColumn("_place", place)
    first = narrow.where(F.col("_place") <= best).where(F.col("_place") <= F.col("limit")).select("_row").distinct()
    staged = scratch_path(spark, "leading")
    first.write.parquet(staged)
    return catalog.withColumn("_row", F.xxhash64("path_key")).join(spark.read.schema(first.schema).parquet(staged), "_row", "left_semi").drop("_row")


def search_many(
    catalog: DataFrame,
    requests: DataFrame,
    usage: DataFrame | None = None,
    pinned: DataFrame | None = None,
    as_of: Column | None = None,
) -> DataFrame:
    """Top rows of every request.

    Rows meet only requests that share a join key, and of these only the ones all of whose
    letters they hold (a bit mask in the join condition). A common key is split by adaptive
    execution. Requests with text are matched in a narrow pass first, which leaves the rows that can be
    among their best (:func:`leading_rows`); only these are ranked as a whole.
    """
    as_of = _as_of(usage, as_of)
    keyed, letters = request_keys(requests)
    widest, texts, others = keyed.agg(F.max("limit"), F.count_if(has_text()), F.count_if(~has_text())).first()
    widest = widest or 0
    if texts and widest <= GROUP_LIMIT:
        texted = keyed.where(has_text())
        leading = leading_rows(catalog, matching_pairs(catalog, texted, letters), widest)
        scored = matching_pairs(leading, texted, letters)
        if others:  # without text all rows tie on most of the fixed keys, and no letters are needed
            plain = matching_pairs(catalog, keyed.where(~has_text()), F.array().cast("array<string>"))
            scored = scored.unionByName(plain)
    else:
        scored = matching_pairs(catalog, keyed, letters)
    ready = with_tie_breakers(scored, has_text(), F.col("preferred_root"), usage, pinned, as_of, widest, ["query_id"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*rank_order()))
    return (
        ready.withColumn("rank", rank)
        .where(F.col("rank") <= widest)  # a constant, so each partition is cut before the shuffle
        .where(F.col("rank") <= F.col("limit"))
        .select("query_id", *RESULT_COLUMNS)
    )


RESULT_COLUMNS = [
    "rank", "full_path", "path_key", "is_directory", "size_bytes", "mtime", "tier", "quality",
    "length_diff", "score", "match_reason", "root_priority", "is_app", "is_pinned",
    "open_count", "recency",
]


# --- result lists ----------------------------------------------------------------------

def recents(usage: DataFrame, catalog: DataFrame, limit: int) -> DataFrame:
    """Last used rows still in the catalog: latest first, then most opened, then path."""
    order = [F.col("last_used_at").desc(), F.col("open_count").desc(), F.col("path_key").asc()]
    used = usage.select("path_key", "open_count", "last_used_at")
    return (
        catalog.join(used, "path_key")
        .withColumns({"score": F.lit(1.0), "match_reason": F.lit("recent")})
        .orderBy(*order)
        .limit(limit)
        .withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    )


def first_seen(*sources: DataFrame, key: str = "path_key") -> DataFrame:
    """Concatenate ranked lists and keep the first row per key; ``source_no`` and ``rank`` order the result."""
    shared = [c for c in sources[0].columns if all(c in s.columns for s in sources)]
    tagged = [
        s.select(*shared).withColumn("source_no", F.lit(i)) for i, s in enumerate(sources)
    ]
    union = tagged[0]
    for other in tagged[1:]:
        union = union.unionByName(other)
    best = union.groupBy(key).agg(
        F.min_by(F.struct(*[c for c in union.columns if c != key]), F.struct("source_no", "rank")).alias("r")
    )
    return best.select(key, "r.*")


def regroup_by_root(results: DataFrame, root: str | None) -> DataFrame:
    """Children of the root first, then descendants, then the rest; rank order inside."""
    group = S.root_group(F.col("path_key"), F.col("parent_key"), F.lit(root).cast("string"))
    return results.withColumn("root_group", group).orderBy("root_group", "rank")


def pinned_first(pinned_rows: DataFrame, results: DataFrame, request: SearchRequest) -> DataFrame:
    """Pinned rows that fit the request text, then the other results without repeats."""
    parts = [*request.terms, *request.phrases, *request.path_terms]
    fitting = pinned_rows.where(flt.pinned_match(parts, request.excluded_terms))
    return first_seen(fitting, results)


def without_query(
    pinned_rows: DataFrame, usage: DataFrame, catalog: DataFrame, quick_filter: Column, limit: int
) -> DataFrame:
    """Result list before any text is typed: pinned rows, then recents passing the quick filter."""
    return first_seen(pinned_rows, recents(usage, catalog, limit).where(quick_filter))


def keyword_targets(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """First enabled entry whose trimmed keyword equals the query text, ignoring case."""
    text = F.lower(P.strip(F.col("text")))
    keyed = entries.where("enabled").withColumn("_keyword", F.lower(P.strip(F.col("keyword"))))
    first = keyed.groupBy("_keyword").agg(
        F.min_by(F.struct("seq", "keyword", "target"), "seq").alias("e")
    )
    return queries.join(first, text == F.col("_keyword")).select("query_id", "e.seq", "e.keyword", "e.target")


def same_results(left: DataFrame, right: DataFrame, by: Sequence[str] = ("rank",)) -> DataFrame:
    """Ranks at which two ranked lists differ in key, score or reason; empty = equal."""
    fields = ("path_key", "score", "match_reason")
    pick = lambda df, side: df.select(*by, F.struct(*fields).alias(side))
    both = pick(left, "left_row").join(pick(right, "right_row"), list(by), "full")
    return both.where(~F.col("left_row").eqNullSafe(F.col("right_row")))


# --- match lanes -----------------------------------------------------------------------

def lanes(catalog: DataFrame, request: SearchRequest, token: str | None = None) -> dict[str, DataFrame]:
    """Rows per match lane, cheapest lane first; every lane filter is pushed to its own scan."""
    text = " ".join([*request.phrases, *request.terms])
    rows = catalog.where(request_filter(request))
    name, aliases = F.lower("name"), F.col("search_text")
    ordered = S.subsequence_pattern(text)
    in_order = name.rlike(ordered) | aliases.rlike(ordered)
    found: dict[str, DataFrame] = {}
    if request.preferred_root:
        found["preferred_root"] = rows.where((F.col("parent_key") == request.preferred_root.lower()) & in_order)
    found["prefix"] = rows.where(flt.stored_prefix(rows, token or text))
    if len(text) <= 2:
        found["short_alias"] = rows.where(flt.stored_alias(rows) & aliases.contains(text))
    found["contains"] = rows.where(name.contains(text) | aliases.contains(text))
    found["in_order"] = rows.where(in_order)
    return found


def lane_order() -> list[Column]:
    return [F.length("name").asc(), F.lower("name").asc(), F.col("name").asc(),
            F.length("full_path").asc(), F.col("full_path").asc()]


def prefix_lane(catalog: DataFrame, token: str, limit: int) -> DataFrame:
    """Names starting with a token: the exact name first, then shorter names."""
    exact = F.when(F.lower("name") == token.strip().lower(), 0).otherwise(1)
    return (
        catalog.where(flt.stored_prefix(catalog, token))
        .withColumn("lane_class", exact)
        .orderBy("lane_class", *lane_order())
        .limit(limit)
    )


def lane_candidates(catalog: DataFrame, request: SearchRequest, token: str | None = None) -> DataFrame:
    """Union of the match lanes, one row per path with its first lane."""
    parts = []
    for number, (lane, rows) in enumerate(lanes(catalog, request, token).items()):
        parts.append(rows.select("path_key", "full_path", "name", F.lit(number).alias("lane_no"), F.lit(lane).alias("lane")))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    best = union.groupBy("path_key").agg(F.min_by(F.struct("full_path", "name", "lane_no", "lane"), "lane_no").alias("r"))
    return best.select("path_key", "r.*")
