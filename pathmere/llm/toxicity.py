"""Toxicity scores of a sparse linear classifier with counterfactual regularisation.

Features of a text are its distinct lower-cased words and their 5- and 7-byte prefixes, hashed to
2**18 weights. Training is online (FTRL-proximal, L1 keeps few weights) over a bounded sample of
labelled rows: at most ``max_toxic`` toxic and ``max_clean`` other rows, those with the least
hash of doc_id; the intercept is shifted back to the label shares of all labelled rows.

Every sampled text has a counterfactual. Where it mentions a group (``IDENTITY_TERMS``), it is the
same text with each term swapped for another of its kind. Any other text is given a mention (a
term picked by its doc_id, put behind it) and the same mention swapped; every second epoch learns
the label from the text with the mention, so both labels are seen with all groups. The squared
difference of the scores of both versions, and of a text with and without the mention it was
given, is a penalty: the weight that a neutral mention could gain is taken from it and its like.

Scoring is one narrow pass: the text column alone goes to Python, where all words of a slice are
hashed and looked up as arrays.

Defined cases: repeated rows of a doc_id are each learned from; null and empty texts score by the intercept; rows without a label, or whose label
is not 0 or 1, are not learned from; if a doc_id has several labels, toxic wins; without toxic
labels all scores stay under 0.5; other columns pass through untouched.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathmere.llm.arrow import byte_sums, map_arrow, raw, ship, slices, span_hashes, spans

WEIGHT_BITS = 18
PREFIXES = (5, 7)
#: Kinds of group mentions; terms of one kind are swapped for one another.
IDENTITY_TERMS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("women", "men"), ("woman", "man"), ("female", "male"),
    ("german", "french", "spanish", "english", "mexican", "turkish", "polish", "chinese"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("deaf", "blind", "disabled", "autistic"),
    ("old", "young"),
    ("christen", "muslime", "juden"), ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


@dataclass
class Model:
    """Non-zero weights by feature, and the intercept."""

    bias: float
    features: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0, np.float32))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature and text position of every word and prefix, repeats included."""
    data, offsets = raw(texts)
    data = _LOWER[data]
    starts, ends, first = spans(data, offsets, _LETTER[data])
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    sums = byte_sums(data)
    found, at = [span_hashes(sums, starts, ends)], [doc]
    for n in PREFIXES:
        long = ends - starts > n
        found.append(span_hashes(sums, starts[long], starts[long] + n) * np.uint64(2 * n + 1))
        at.append(doc[long])
    return (np.concatenate(found) >> np.uint64(64 - WEIGHT_BITS)).astype(np.int64), np.concatenate(at)


def _swapper(terms=IDENTITY_TERMS):
    other = {t: kind[(i + 1) % len(kind)] for kind in terms for i, t in enumerate(kind)}
    pattern = re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(other, key=len, reverse=True))) + r")\b", re.IGNORECASE)
    return lambda text: pattern.sub(lambda m: other[m[0].lower()], text)


def labelled(docs: DataFrame, labels: DataFrame, usable: Column, max_toxic: int, max_clean: int) -> tuple[list, dict[int, int]]:
    """The bounded sample as (toxic, features, own, other, given), and counts of all usable labels.

    ``own`` are the features of the mention that swapping takes away, ``other`` those it brings;
    ``given`` says that the text itself has no mention, so ``own`` are not among its features.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & usable).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = known.join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    pick = lambda label, n: known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = pick(1, max_toxic).unionByName(pick(0, max_clean))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swap = _swapper()
        for batch in batches:
            texts = [x or "" for x in batch.column(2).to_pylist()]
            swapped = [swap(t) for t in texts]
            given = [s == t for s, t in zip(swapped, texts)]
            mentions = [mention(i) if g else ("", "") for i, g in zip(batch.column(0).to_pylist(), given)]
            x, y = _sets(texts), _sets(["" if g else s for g, s in zip(given, swapped)])
            one, two = _sets([m[0] for m in mentions]), _sets([m[1] for m in mentions])
            own = [np.setdiff1d(b if g else a, a if g else c) for g, a, b, c in zip(given, x, one, y)]
            other = [np.setdiff1d(b if g else c, a) for g, a, b, c in zip(given, x, two, y)]
            lists = [pa.array(side, pa.list_(pa.int32())) for side in (x, own, other)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists, pa.array(given)], names=["doc_id", "toxic", "x", "own", "other", "given"])

    found = map_arrow(sample.join(rows, "doc_id").select("doc_id", "toxic", "text"), run, "doc_id long, toxic int, x array<int>, own array<int>, other array<int>, given boolean")
    table = found.toArrow().sort_by("doc_id")
    sides = [[v.values.to_numpy() for v in table[name]] for name in ("x", "own", "other")]
    return list(zip(table["toxic"].to_pylist(), *sides, table["given"].to_pylist())), counts


def mention(doc_id: int) -> tuple[str, str]:
    """A group term for a text without one, and another of its kind."""
    draw = zlib.crc32(str(doc_id).encode())
    kind = IDENTITY_TERMS[draw % len(IDENTITY_TERMS)]
    at = draw // len(IDENTITY_TERMS) % len(kind)
    return kind[at], kind[(at + 1) % len(kind)]


def _sets(texts: list[str]) -> list[np.ndarray]:
    """Distinct features of each text, in order."""
    f, at = features(pa.array(texts, pa.string()))
    key = np.unique(at << WEIGHT_BITS | f)
    cut = np.searchsorted(key >> WEIGHT_BITS, np.arange(1, len(texts)))
    return np.split((key & ((1 << WEIGHT_BITS) - 1)).astype(np.int32), cut)


def fit(rows: list, counts: dict[int, int], epochs: int = 10, rate: float = 1.0, l1: float = 5.0, l2: float = 1.0, fairness: float = 4.0, seed: int = 0) -> Model:
    """FTRL-proximal over the sample; ``fairness`` weighs the squared changes of counterfactuals."""
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    if not n1 or not rows:
        return Model(float(np.log((n1 + 0.5) / (n0 + 1))))
    size = 1 << WEIGHT_BITS
    z, n = np.zeros(size), np.zeros(size)

    def weights(i: np.ndarray) -> np.ndarray:
        return -np.sign(z[i]) * np.maximum(np.abs(z[i]) - l1, 0) / ((1 + np.sqrt(n[i])) / rate + l2)

    def step(i: np.ndarray, w: np.ndarray, g: np.ndarray | float) -> None:
        square = g * g
        z[i] += g - (np.sqrt(n[i] + square) - np.sqrt(n[i])) / rate * w
        n[i] += square

    def draw_together(minuend: np.ndarray, subtrahend: np.ndarray) -> None:
        """A step against the squared difference of the weights of both sides."""
        a, b = weights(minuend), weights(subtrahend)
        pull = np.clip(2 * fairness * (a.sum() - b.sum()), -2, 2)
        if pull:
            step(minuend, a, pull)
            step(subtrahend, b, -pull)

    sampled = {t: sum(r[0] == t for r in rows) for t in (0, 1)}
    bias, bias_n = 0.0, 0.0
    order, nothing = np.random.default_rng(seed), np.empty(0, np.int32)
    for epoch in range(epochs):
        for k in order.permutation(len(rows)):
            toxic, x, own, other, given = rows[k]
            if given and epoch % 2:
                x = np.concatenate([x, own])
            w = weights(x)
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -30, 30))) - toxic
            bias_n += g * g
            bias -= rate * g / (1 + np.sqrt(bias_n))
            step(x, w, g)
            draw_together(own, other)
            if given:
                draw_together(own, nothing)
    everything = weights(np.arange(size))
    some = np.flatnonzero(everything)
    if sampled[0] and sampled[1] and n0:
        bias += float(np.log(n1 / sampled[1]) - np.log(n0 / sampled[0]))
    return Model(float(bias), some, everything[some].astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, max_toxic: int = 4000, max_clean: int = 8000) -> Model:
    """Fit on labelled rows for which ``usable`` (a condition on labels) holds."""
    return fit(*labelled(docs, labels, F.lit(True) if usable is None else usable, max_toxic, max_clean))


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    dense = np.zeros(1 << WEIGHT_BITS, np.float32)
    dense[model.features] = model.weights
    out = np.full(len(texts), model.bias)
    for start, stop in slices(texts):
        f, at = features(texts.slice(start, stop - start))
        some = dense[f] != 0
        key = np.unique(at[some] << WEIGHT_BITS | f[some])
        out[start:stop] += np.bincount(key >> WEIGHT_BITS, dense[key & ((1 << WEIGHT_BITS) - 1)], stop - start)
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def score(docs: DataFrame, model: Model, text: Column | None = None) -> Column:
    """Score column in 0..1 for the text column of ``docs``."""
    ship(docs.sparkSession)

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(scores(texts, model))

    return of(F.coalesce((F.col("text") if text is None else text).cast("string"), F.lit("")))


def drop_toxic(docs: DataFrame, labels: DataFrame, usable: Column | None = None, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` under the threshold, columns unchanged."""
    rows = docs.select(F.struct("*").alias("row"), "text")
    marked = rows.select("row", score(rows, train(docs, labels, usable)).alias("score"))
    return marked.where(F.col("score") < threshold).select("row.*")
