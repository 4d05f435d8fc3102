"""Mixing sources to target weights on a domain-language-source tree.

*Budgets.* A total of tokens flows down the tree by weight. A node that cannot hold its share (its
tokens times ``max_epochs``) is filled, and the shortage goes to its siblings by weight; only when
all siblings are full does it reach the parent's siblings. Only one row for each leaf of the
tree reaches the driver.

*Selection.* A leaf of n tokens with budget b takes b // n whole epochs, and of the next epoch the
documents in seeded hash order until b is reached; of the last document ``take_tokens`` counts the
tokens that still fit. Running sums are not taken over a leaf at once: tokens are summed by leaf
and hash bucket (buckets grow with the input, so a leaf with a third of all rows has many), the
bucket in which the budget ends is found from these sums, and only its rows are ordered.

*Tree.* It is given, or a function makes it from the leaves that the rows have. :func:`tree_of` names
every leaf, with the target weights where named and default weights for all others, so no row falls
outside it. Leaves outside a given tree have weight zero and are not selected.

Defined cases: a null level is the name "unknown"; a null text has no tokens and is selected if the budget is not used up before it;
equal hashes are ordered by doc_id, then text; repeated rows are selected each by itself; an empty
table gives an empty result; other columns are carried in a struct.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathmere.llm.graph import stored

#: Rows of one hash bucket of a leaf, on average.
BUCKET_ROWS = 2_000
#: Nested {name: (weight, children)}; leaves have no children.
Tree = dict[str, tuple[float, dict]]


def words_of(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def leaves(tree: Tree, path: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    return [x for name, (_, below) in tree.items() for x in (leaves(below, (*path, name)) if below else [(*path, name)])]


def _share(amount: int, weights: dict[str, float], room: dict[str, int]) -> dict[str, int]:
    """Whole tokens by weight, none over its room; what a full one cannot hold goes to the others."""
    got, live = dict.fromkeys(weights, 0), {k for k in weights if weights[k] > 0 and room[k] > 0}
    amount = min(amount, sum(room[k] for k in live))
    while amount and live:
        total = sum(weights[k] for k in live)
        exact = {k: amount * weights[k] / total for k in live}
        full = {k for k in live if exact[k] >= room[k] - got[k]}
        if full:
            for k in full:
                amount -= room[k] - got[k]
                got[k] = room[k]
            live -= full
            continue
        for k in live:
            got[k] += int(exact[k])
        amount -= sum(int(exact[k]) for k in live)
        for k in sorted(live, key=lambda k: (int(exact[k]) - exact[k], k)):  # largest remainders first
            if not amount:
                break
            step = min(amount, 1, room[k] - got[k])
            got[k] += step
            amount -= step
    return got


def budgets(tree: Tree, tokens: dict[tuple[str, ...], int], total: int, max_epochs: int = 1, path: tuple[str, ...] = ()) -> dict[tuple[str, ...], int]:
    """Tokens for each leaf."""

    def room(name: str, below: dict, at: tuple[str, ...]) -> int:
        if not below:
            return tokens.get((*at, name), 0) * max_epochs
        return sum(room(n, b, (*at, name)) for n, (w, b) in below.items() if w > 0)

    got = _share(total, {n: w for n, (w, _) in tree.items()}, {n: room(n, b, path) for n, (_, b) in tree.items()})
    out: dict[tuple[str, ...], int] = {}
    for name, (_, below) in tree.items():
        out |= budgets(below, tokens, got[name], max_epochs, (*path, name)) if below else {(*path, name): got[name]}
    return out


def mix(docs: DataFrame, levels: list[Column], tree: Tree | Callable[[Iterable[tuple[str, ...]]], Tree], share: float = 1.0, max_epochs: int = 1, seed: int = 0, tokens: Column | None = None) -> DataFrame:
    """``(row, leaf, epoch, n_tokens, take_tokens)`` for each selection; total = ``share`` of all tokens in the tree."""
    spark = docs.sparkSession
    named = F.array(*[F.coalesce(c.cast("string"), F.lit("unknown")) for c in levels])
    rows = docs.select(F.struct("*").alias("row"), named.alias("leaf"), (words_of() if tokens is None else tokens).alias("n_tokens"))
    counts = rows.groupBy("leaf").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    if not callable(tree):
        counts = counts.where(F.array_join("leaf", "\x1f").isin(["\x1f".join(x) for x in leaves(tree)]))
    totals = {tuple(r["leaf"]): (r["t"], r["n"]) for r in counts.collect()}
    tree = tree(totals) if callable(tree) else tree
    have = {k: t for k, (t, _) in totals.items()}
    plan = budgets(tree, have, int(share * sum(have.values())), max_epochs)
    buckets = 1 << max(0, (max([n for _, n in totals.values()], default=1) // BUCKET_ROWS).bit_length())
    part = [(list(k), plan[k] // have[k] if have[k] else 0, plan[k] % have[k] if have[k] else 0) for k in plan if k in have]
    schema = T.StructType([T.StructField("leaf", T.ArrayType(T.StringType())), T.StructField("whole", T.LongType()), T.StructField("rest", T.LongType())])
    plan_rows = F.broadcast(spark.createDataFrame(part, schema))  # one row for each leaf of the tree
    rows = rows.join(plan_rows, "leaf")
    order = F.xxhash64(F.lit(seed), F.col("whole"), F.col("row.doc_id"))
    rows = rows.withColumn("h", order).withColumn("bucket", F.shiftrightunsigned("h", 64 - (buckets.bit_length() - 1)) if buckets > 1 else F.lit(0).cast("long"))

    # the bucket of each leaf in which the rest ends, and the tokens before it
    sums = stored(rows.where("rest > 0").groupBy("leaf", "rest", "bucket").agg(F.sum("n_tokens").alias("t")), "mix-buckets")
    before = F.expr("coalesce(sum(t) over (partition by leaf order by bucket rows between unbounded preceding and 1 preceding), 0)")
    ends = sums.select("leaf", "rest", "bucket", "t", before.alias("base")).where("base < rest and base + t >= rest").select("leaf", F.col("bucket").alias("cut"), "base")
    ends = F.broadcast(ends)  # at most one row for each leaf
    cut = rows.join(ends, "leaf", "left")
    epochs = cut.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), "whole"))).withColumn("take_tokens", F.col("n_tokens"))
    under = cut.where("rest > 0 and bucket < cut").withColumn("epoch", F.col("whole") + 1).withColumn("take_tokens", F.col("n_tokens"))
    at = cut.where("rest > 0 and bucket = cut").select("*", F.expr("base + coalesce(sum(n_tokens) over (partition by leaf order by h, row.doc_id, xxhash64(row) rows between unbounded preceding and 1 preceding), 0)").alias("start"))
    at = at.where("start < rest").withColumn("epoch", F.col("whole") + 1).withColumn("take_tokens", F.least("n_tokens", F.col("rest") - F.col("start")))
    fields = ["row", "leaf", "epoch", "n_tokens", "take_tokens"]
    return reduce(DataFrame.unionByName, (x.select(*fields) for x in (epochs, under, at)))


def cut(mixed: DataFrame) -> DataFrame:
    """The rows of a mix; of a document taken in part the first ``take_tokens`` words, joined by one blank, and their length in ``n_chars``."""
    part = F.col("take_tokens") < F.col("n_tokens")
    words = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text").cast("string"), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)), 1, F.col("take_tokens").cast("int")), " ")
    row = F.col("row").withField("text", words)
    if "n_chars" in mixed.schema["row"].dataType.names:
        row = row.withField("n_chars", F.length(words).cast(mixed.schema["row"].dataType["n_chars"].dataType))
    return mixed.select(F.when(part, row).otherwise(F.col("row")).alias("row")).select("row.*")


def source_levels() -> list[Column]:
    """Domain, language and source of ``documents``: the domain of a source goes by its number."""
    number = F.regexp_extract("source", r"(\d+)$", 1).try_cast("int")
    names = F.array(*map(F.lit, DOMAINS))
    return [F.coalesce(F.get(names, F.pmod(number, F.lit(len(DOMAINS)))), F.lit("other")), F.col("lang"), F.col("source")]


#: Target weights: a quarter of the sources each.
DOMAINS = {"web": 0.40, "books": 0.25, "news": 0.20, "forum": 0.15}
LANGUAGES = {"en": 0.60, "fr": 0.15, "de": 0.15, "es": 0.10}
#: Weight of every domain and language that has no target ("other", "unknown" and new ones), against those above.
DEFAULT_WEIGHT = 0.05


def tree_of(found: Iterable[tuple[str, ...]]) -> Tree:
    """Tree over all (domain, language, source) that occur; sources of a domain and language weigh alike."""
    tree: Tree = {}
    for domain, lang, source in sorted(found):
        _, langs = tree.setdefault(domain, (DOMAINS.get(domain, DEFAULT_WEIGHT), {}))
        _, sources = langs.setdefault(lang, (LANGUAGES.get(lang, DEFAULT_WEIGHT), {}))
        sources[source] = (1.0, {})
    return tree


def corpus_tree(sources: int = 20) -> Tree:
    """Tree over the sources src0, src1, ...; those of a domain and language weigh alike."""
    return {
        domain: (weight, {lang: (w, {f"src{s}": (1.0, {}) for s in range(i, sources, len(DOMAINS))}) for lang, w in LANGUAGES.items()})
        for i, (domain, weight) in enumerate(DOMAINS.items())
    }
