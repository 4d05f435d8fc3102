"""Row predicates over a catalog. Each returns a boolean column or filters a DataFrame.

Predicates on ``is_directory``, ``mtime``, ``ext`` and ``path_key`` are plain comparisons, so
they reach the Parquet scan of a stored catalog.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathmere.functions import paths as P
from pathmere.functions.formats import TYPE_PRESETS
from pathmere.functions.scoring import path_match, subsequence_pattern


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def kind(value: str) -> Column:
    """'any', 'files' or 'folders'."""
    if value == "any":
        return F.lit(True)
    if value not in ("files", "folders"):
        raise ValueError(f"unknown kind {value!r}")
    return F.col("is_directory") == F.lit(value == "folders")


def applications() -> Column:
    return P.is_application(F.col("full_path"), F.col("is_directory"))


def has_suffix(extensions: Sequence[str]) -> Column:
    """Name ends with one of the (possibly compound) extensions."""
    low = F.lower("name")
    return _any([F.endswith(low, F.lit("." + e.strip().lower())) for e in extensions if e.strip()])


def lacks_suffix(extensions: Sequence[str]) -> Column:
    return ~has_suffix(extensions)


def last_extension_in(extensions: Sequence[str]) -> Column:
    """Files whose last extension is listed (quick filter)."""
    wanted = sorted({e.strip().lstrip(".").lower() for e in extensions} - {""})
    if not wanted:
        return F.lit(True)
    return ~F.col("is_directory") & F.col("ext").isin(wanted)


def modified_since(bound: Column) -> Column:
    return F.col("mtime") >= bound


def date_preset(preset: str, as_of: Column) -> Column:
    """'any', 'today', '7d', '30d' or '1y' before ``as_of``."""
    bounds = {
        "today": F.date_trunc("day", as_of),
        "7d": as_of - F.expr("interval 7 days"),
        "30d": as_of - F.expr("interval 30 days"),
        "1y": as_of - F.expr("interval 1 year"),
    }
    return F.lit(True) if preset == "any" else modified_since(bounds[preset])


def type_preset(preset: str) -> Column:
    """'all', 'folders', 'files', 'documents', 'images' or 'videos'."""
    if preset in TYPE_PRESETS:
        return kind("files") & last_extension_in(TYPE_PRESETS[preset])
    return kind({"all": "any"}.get(preset, preset))


def contains_all(phrases: Sequence[str]) -> Column:
    return _all([F.col("path_key").contains(p.strip().lower()) for p in phrases])


def contains_none(terms: Sequence[str]) -> Column:
    return ~_any([F.col("path_key").contains(t.strip().lower()) for t in terms])


def matches_path_terms(expressions: Sequence[str]) -> Column:
    return _all([path_match(F.col("full_path"), F.lit(e)) for e in expressions])


def under(root: str) -> Column:
    return P.under_root(F.col("path_key"), F.lit(root))


def in_order(letters: str) -> Column:
    """Name contains the letters in this order."""
    return F.lower("name").rlike(subsequence_pattern(letters.strip().lower()))


def spellings(token: str) -> list[str]:
    """The token in lower case, and a plain one of 3+ characters in snake and kebab case too (as ``name_variants``)."""
    token = token.strip()
    low = token.lower()
    words = "".join(
        "_" * bool(i and c.isupper() and (token[i - 1].islower() or (token[i - 1].isupper() and token[i + 1 : i + 2].islower()))) + c
        for i, c in enumerate(token)
    ).lower()
    plain = len(low) >= 3 and not any(c.isspace() or c == ":" for c in token)
    return list(dict.fromkeys([low, words, words.replace("_", "-")])) if plain and words != low else [low]


def starts_with_variant(token: str, name: str | Column | None = None) -> Column:
    """Name starts with the token or with its snake/kebab spelling, ignoring case.

    ``name`` is the lower-cased name; on the stored ``name_lower`` the prefixes reach the scan.
    """
    low = F.lower("name") if name is None else name if isinstance(name, Column) else F.col(name)
    condition = F.lit(False)
    for spelling in spellings(token):
        condition = condition | low.startswith(spelling)
    return condition


def stored_prefix(catalog: DataFrame, token: str) -> Column:
    """:func:`starts_with_variant` on the sorted column of a stored catalog, where it is at hand."""
    return starts_with_variant(token, "name_lower" if "name_lower" in catalog.columns else None)


def stored_alias(catalog: DataFrame) -> Column:
    """:func:`has_alias` on the partition column of a stored catalog, where it is at hand."""
    return F.col("has_alias").cast("string") == "true" if "has_alias" in catalog.columns else has_alias()


def pinned_match(terms: Sequence[str], excluded: Sequence[str] = ()) -> Column:
    return contains_all(terms) & contains_none(excluded)


def has_alias() -> Column:
    return F.col("search_text") != ""


def not_metadata() -> Column:
    return ~F.col("name").startswith("$")


def outside_named_folders(names: Sequence[str]) -> Column:
    """No folder part carries one of the names; a file's own name does not count."""
    wanted = F.array(*[F.lit(n.strip().lower()) for n in names])
    parts = P.components(F.col("full_path"))
    folders = F.when(F.col("is_directory"), parts).otherwise(
        F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    )
    return ~F.arrays_overlap(folders, wanted)


def is_valid_row() -> Column:
    """Absolute non-blank path, size not negative, name not '.'; nulls count as invalid."""
    path = F.col("full_path")
    ok = (
        P.is_absolute(P.strip(path))
        & (F.col("size_bytes") >= 0)
        & (F.substring_index(F.replace(P.strip(path), F.lit("\\"), F.lit("/")), "/", -1) != ".")
    )
    return F.coalesce(ok, F.lit(False))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and rejects (the side output)."""
    return df.where(is_valid_row()), df.where(~is_valid_row())


def journal_range(start: int, end: int) -> Column:
    return (F.col("usn") >= start) & (F.col("usn") < end)


# --- configured exclusions -------------------------------------------------------------

def exclusion_kind(value: Column) -> Column:
    """'suffix' for ``*.x``, 'subtree' for absolute paths, 'segment' for bare words."""
    return (
        F.when(value.startswith("*."), "suffix")
        .when(P.is_absolute(value), "subtree")
        .otherwise("segment")
    )


def exclusion_rules(rules: DataFrame) -> DataFrame:
    """One lower-case equi-join key per configured value of column ``value``."""
    value = P.strip(F.col("value"))
    what = exclusion_kind(value)
    key = (
        F.when(what == "suffix", F.substring(value, F.lit(2), F.length(value)))
        .when(what == "subtree", P.norm_path(value))
        .otherwise(value)
    )
    return rules.where(value != "").select(F.concat(what, F.lit(":"), F.lower(key)).alias("rule")).distinct()


def rule_keys(path: Column) -> Column:
    """Every rule key that would exclude this path: its subtrees, parts and dotted suffixes."""
    key = F.lower(path)
    leaf = F.substring_index(key, "/", -1)
    pieces = F.split(leaf, r"\.")
    suffixes = F.when(
        F.size(pieces) > 1,
        F.transform(
            F.sequence(F.lit(2), F.size(pieces)),
            lambda i: F.concat(F.lit("."), F.array_join(F.slice(pieces, i, F.size(pieces)), ".")),
        ),
    ).otherwise(F.array().cast("array<string>"))

    def tagged(values: Column, tag: str) -> Column:
        return F.transform(values, lambda v: F.concat(F.lit(tag + ":"), v))

    return F.concat(
        tagged(P.self_and_ancestors(key), "subtree"),
        tagged(P.components(key), "segment"),
        tagged(suffixes, "suffix"),
    )


def drop_excluded(df: DataFrame, rules: DataFrame, path_col: str = "full_path") -> DataFrame:
    """Rows no configured exclusion hits. Rules of any number; all joins are equi-joins."""
    keys = df.select(
        F.col(path_col).alias("_path"), F.explode(F.array_distinct(rule_keys(F.col(path_col)))).alias("rule")
    )
    hit = keys.join(exclusion_rules(rules), "rule", "left_semi").select("_path").distinct()
    return df.join(hit, df[path_col] == hit["_path"], "left_anti")


def not_excluded(values: Sequence[str], path: Column | None = None) -> Column:
    """Same rules as a predicate, for a short configured list: no join, no shuffle."""
    path = F.col("full_path") if path is None else path
    key = F.lower(path)
    hits = []
    for value in (v.strip() for v in values):
        low = value.lower()
        if not value:
            continue
        if low.startswith("*."):
            hits.append(key.endswith(low[1:]))
        elif low.startswith("/") or low[1:3] in (":/", ":\\"):
            hits.append(P.under_root(key, F.lit(low.replace("\\", "/").rstrip("/"))))
        else:
            hits.append(F.array_contains(P.components(path), low))
    return ~_any(hits)
