"""Match and score expressions: fuzzy, alias, path-segment and combined term keys.

All builders take and return columns. A term may be a literal or a lambda variable, so the
same rules serve one request and a table of requests.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathmere.functions.paths import (
    bind, chars, components, decoded_name, is_application, looks_percent_encoded, strip,
)

SEPARATORS = [" ", "-", "_", ".", "\\", "/"]
KEY_TYPE = "struct<tier:int,quality:double,length_diff:int,reason:string>"


def clean(s: Column) -> Column:
    return F.lower(strip(s))


def fuzzy_score(query: Column, candidate: Column) -> Column:
    return bind(clean(query), lambda q: bind(clean(candidate), lambda c: _fuzzy(q, c)))


def _fuzzy(q: Column, c: Column) -> Column:
    """200 + length for a contiguous hit, else the greedy in-order hit score below 200, else 0.

    The fold runs over the few query characters and jumps with ``position``; the earliest next
    occurrence is exactly the greedy choice.
    """
    start = F.struct(
        F.lit(0).alias("pos"), F.lit(0).alias("streak"), F.lit(0.0).alias("score")
    )

    lost = F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("streak"), F.lit(0.0).alias("score"))

    def hit(state: Column, at: Column) -> Column:
        streak = F.when(at == state.pos + 1, state.streak + 1).otherwise(1)
        at_word_start = (at == 1) | F.substring(c, at - 1, F.lit(1)).isin(SEPARATORS)
        gain = 8 + 2 * streak + F.when(at_word_start, 10).otherwise(0)
        advanced = F.struct(
            at.alias("pos"), streak.alias("streak"), (state.score + gain).cast("double").alias("score")
        )
        return F.when(at > 0, advanced).otherwise(lost)

    def step(state: Column, ch: Column) -> Column:
        ahead = bind(F.position(ch, c, state.pos + 1), lambda at: hit(state, at))
        return F.when(state.pos >= 0, ahead).otherwise(state)

    fragmented = F.aggregate(
        chars(q), start, step,
        lambda s: F.when(s.pos > 0, F.least(s.score, F.lit(199.0))).otherwise(F.lit(0.0)),
    )
    return (
        F.when((q == "") | (c == ""), F.lit(0.0))
        .when(c.contains(q), (200 + F.length(q)).cast("double"))
        .otherwise(fragmented)
    )


def alias_score(query: Column, reading: Column, initials: Column) -> Column:
    """Best fuzzy score on the reading and, when different, on the initials."""
    full = fuzzy_score(query, reading)
    return F.when(initials == reading, full).otherwise(
        F.greatest(full, fuzzy_score(query, initials))
    )


def short_alias_hit(query: Column, reading: Column, initials: Column) -> Column:
    """Strong hit of a query of up to three characters on initials or reading."""
    q, r, i = F.lower(query), F.lower(reading), F.lower(initials)
    return (F.length(query) <= 3) & (
        (i == q)
        | F.startswith(i, F.concat(q, F.lit(".")))
        | F.contains(F.concat(F.lit(" "), i, F.lit(" ")), F.concat(F.lit(" "), q, F.lit(" ")))
        | F.startswith(r, q)
    )


def component_match(component: Column, segment: Column) -> Column:
    """Equal; a letters-only segment may be a prefix up to a non-letter; others may be contained."""
    letters_only = segment.rlike("^[a-z]+$")
    next_char = F.substring(component, F.length(segment) + 1, F.lit(1))
    return (component == segment) | F.when(
        letters_only,
        F.startswith(component, segment) & ~next_char.rlike(r"^\p{L}"),
    ).otherwise(F.contains(component, segment))


def path_match(path: Column, expression: Column) -> Column:
    """Segments of the expression match path components in order (or as a bounded snippet)."""
    return bind(components(expression), lambda segments: _segments_match(path, expression, segments))


def _segments_match(path: Column, expression: Column, segments: Column) -> Column:
    low = F.translate(clean(path), "\\", "/")
    snippet = F.trim(F.translate(clean(expression), "\\", "/"), F.lit("/"))
    bounded = F.contains(
        F.concat(F.lit("/"), F.ltrim(low, F.lit("/")), F.lit("/")),
        F.concat(F.lit("/"), snippet, F.lit("/")),
    )

    def advance(i: Column, part: Column) -> Column:
        wanted = F.coalesce(F.get(segments, i), F.lit("/"))
        return F.when(component_match(part, wanted), i + 1).otherwise(i)

    first = lambda part: component_match(part, F.get(segments, F.lit(0)))
    return (
        F.when(F.size(segments) == 0, F.lit(False))
        .when(F.size(segments) == 1, F.exists(components(path), first))
        .otherwise(bounded | (F.aggregate(components(path), F.lit(0), advance) == F.size(segments)))
    )


def path_score(path: Column, expression: Column) -> Column:
    """Length of all segments plus two for each, 0 without a match."""

    def score(segments: Column) -> Column:
        total = F.aggregate(segments, F.lit(0), lambda acc, s: acc + F.length(s) + 2)
        return F.when(_segments_match(path, expression, segments), total).otherwise(0)

    return bind(components(expression), score)


@dataclass(frozen=True)
class NameForms:
    """Columns a term is matched against; ``name`` is trimmed lower case.

    Build them as real columns (:func:`with_match_columns`) so that each is computed once.
    """

    name: Column
    leaf: Column
    encoded: Column
    has_alias: Column
    reading: Column
    initials: Column
    path: Column
    parent_length: Column

    @classmethod
    def of_catalog(cls) -> "NameForms":
        return cls(
            *[F.col(c) for c in ("_name", "_leaf", "_encoded", "_has_alias")],
            reading=F.col("reading"),
            initials=F.col("initials"),
            path=F.col("full_path"),
            parent_length=F.length("parent_path"),
        )


MATCH_COLUMNS = ("_name", "_leaf", "_encoded", "_has_alias")


def with_match_columns(df: DataFrame) -> DataFrame:
    """Add the derived name columns every term rule reads."""
    named = df.withColumn("_name", clean(F.col("name")))
    return named.withColumns(
        {
            "_leaf": decoded_name(F.col("_name")),
            "_encoded": looks_percent_encoded(F.col("_name")),
            "_has_alias": F.lower("reading") != F.col("_name"),
        }
    )


def term_key(term: Column, row: NameForms, allow_fuzzy: bool = True) -> Column:
    """Tier, quality, length difference and reason of the first rule that hits, else null."""
    return F.get(_term_keys(F.array(term), row, allow_fuzzy), F.lit(0))


def _key(tier: int, quality: Column, length_diff: Column, reason: str) -> Column:
    return F.struct(
        F.lit(tier).alias("tier"),
        quality.cast("double").alias("quality"),
        length_diff.cast("int").alias("length_diff"),
        F.lit(reason).alias("reason"),
    )


def _term_keys(terms: Column, row: NameForms, allow_fuzzy: bool) -> Column:
    name = row.name

    def score(term: Column) -> Column:
        direct = name.contains(term) | (row.leaf == term)
        fields = [
            term.alias("q"),
            F.when(direct | ~term.rlike(r"[\\/]"), 0).otherwise(path_score(row.path, term)).alias("by_path"),
        ]
        if allow_fuzzy:
            fields += [
                F.when(direct, 0.0).otherwise(_fuzzy(term, name)).alias("fuzzy"),
                F.when(direct | ~row.has_alias, 0.0)
                .otherwise(alias_score(term, row.reading, row.initials))
                .alias("by_alias"),
            ]
        return F.struct(*fields)

    def rules(x: Column) -> Column:
        q = x.q
        size, name_size = F.length(q), F.length(name)
        longer, gap = name_size - size, F.abs(name_size - size)
        chain = (
            F.when(name == q, _key(0, size, F.lit(0), "exact-name"))
            .when((row.leaf != name) & (row.leaf == q), _key(1, size, F.greatest(F.lit(0), longer), "exact-name"))
            .when(F.startswith(name, q), _key(1, size, longer, "name-prefix"))
            .when(name.contains(q) & row.encoded, _key(6, size, longer, "name-substring"))
            .when(name.contains(q), _key(2, size, longer, "name-substring"))
        )
        if allow_fuzzy:
            chain = (
                chain.when(
                    (x.by_alias > 0) & short_alias_hit(q, row.reading, row.initials),
                    _key(1, 100 + x.by_alias, gap, "pinyin"),
                )
                .when(x.fuzzy > 0, _key(3, x.fuzzy, gap, "name-fuzzy"))
                .when(x.by_alias > 0, _key(4, x.by_alias, gap, "pinyin"))
            )
        return chain.when(
            x.by_path > 0, _key(2, x.by_path, F.abs(row.parent_length - size), "path-segment")
        )

    return F.transform(F.transform(terms, score), rules)


def all_keys(terms: Column, phrases: Column, row: NameForms) -> Column:
    """Keys of all phrases (never fuzzy) and terms, in that order; null entries did not match."""
    return F.concat(_term_keys(phrases, row, False), _term_keys(terms, row, True))


def all_matched(keys: Column) -> Column:
    return (F.size(keys) > 0) & F.forall(keys, lambda k: k.isNotNull())


def combine_keys(keys: Column) -> Column:
    """Worst tier, summed quality and length difference, reason of the worst key.

    Worst is the highest tier, then the lowest quality, then the first.
    """
    start = F.struct(
        F.lit(-1).alias("tier"), F.lit(0.0).alias("quality"), F.lit(0).alias("length_diff"),
        F.lit("none").alias("reason"), F.lit(0.0).alias("worst"),
    )

    def add(acc: Column, k: Column) -> Column:
        worse = (k.tier > acc.tier) | ((k.tier == acc.tier) & (k.quality < acc.worst))
        return F.struct(
            F.greatest(acc.tier, k.tier).alias("tier"),
            (acc.quality + k.quality).alias("quality"),
            (acc.length_diff + k.length_diff).alias("length_diff"),
            F.when(worse, k.reason).otherwise(acc.reason).alias("reason"),
            F.when(worse, k.quality).otherwise(acc.worst).alias("worst"),
        )

    return F.aggregate(keys, start, add)


def display_score(tier: Column, quality: Column) -> Column:
    return 10000 - 1000 * tier + quality


def recency(last_used: Column, as_of: Column) -> Column:
    """20 minus fractional days since use, within 0..20; 0 when never used."""
    days = (F.unix_micros(as_of) - F.unix_micros(last_used)) / F.lit(86_400_000_000)
    # greatest() and least() skip nulls, so "never used" needs its own branch
    return F.when(days.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(20.0), 20 - days)))


def item_score(name: Column, details: Column, aliases: Column, query: Column) -> Column:
    """Best alias score; details count only for items without an alias list. Null = no match."""
    q = clean(query)

    def one(alias: Column) -> Column:
        a = F.lower(alias)
        in_order = F.aggregate(
            chars(q),
            F.lit(0),
            lambda pos, ch: F.when((pos >= 0) & (F.position(ch, a, pos + 1) > 0),
                                   F.position(ch, a, pos + 1)).otherwise(-1),
        )
        return (
            F.when(a == q, 1000)
            .when(F.startswith(a, q), 800)
            .when(F.contains(a, q), 600 - (F.position(q, a) - 1))
            .when(in_order > 0, 100 - F.length(alias))
        )

    has_aliases = F.size(aliases) > 0
    names = F.when(has_aliases, aliases).otherwise(F.array(name))
    best = F.array_max(F.transform(names, one))
    at = F.position(q, F.lower(details))
    by_details = F.when(~has_aliases & (at > 0), 300 - (at - 1))
    return F.when(q != "", F.coalesce(best, by_details)).cast("double")


def root_priority(parent_key: Column, root: Column) -> Column:
    """0 for direct children of the preferred root (or without one), else 1."""
    return F.when(root.isNull() | (parent_key == F.lower(root)), 0).otherwise(1)


def root_group(key: Column, parent_key: Column, root: Column) -> Column:
    """0 direct child, 1 deeper descendant, 2 elsewhere."""
    low = F.lower(root)
    return (
        F.when(root.isNull() | (parent_key == low), 0)
        .when(F.startswith(key, F.concat(F.rtrim(low, F.lit("/")), F.lit("/"))), 1)
        .otherwise(2)
    )


def subsequence_pattern(text: str) -> str:
    """Java pattern: the characters occur in this order. Possessive, so it never backtracks."""
    body = "".join(f"[^{_esc(ch)}]*+{_esc(ch)}" for ch in text)
    return f"(?s)^{body}"


def _esc(ch: str) -> str:
    return f"\\x{{{ord(ch):x}}}"


