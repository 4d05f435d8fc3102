"""Near-dedup by SimHash and by likeness: documents linked by their fingerprints or by sets of five-word shingles with Jaccard 0.8 or more.

SimHash is a step of its own: every text has a 64-bit fingerprint of its five-word shingles, the binary
trie joined with itself finds all pairs within the budget of two bits, and each such pair is a link.

Fingerprints differ in about ten bits at Jaccard 0.8, so a second step adds the alike pairs they cannot
see. 24 bands of five MinHash values choose the sets that may have a partner (a pair at 0.8 shares none
with probability (1 - 0.8**5)**24, below 0.0001, a likelier pair less). Among these the join is exact
and by prefix: shingles are ordered from rare to frequent, a set is listed under its first
``n - ceil(0.8 n) + 1`` ones, and two alike sets share one of these, at positions that leave room for
their overlap.

Equal sets are one node. First each node of a list is compared with the first one of it; this joins
dense groups with one comparison for each member. Then pairs of a list that are still in different
components, fit by length and position and have not been compared are verified, so no pair of alike
sets is lost and a group of n near copies costs about n comparisons. Long lists are dealt in
blocks: a node that may be the shorter one of a pair goes to one block, every node visits all.

Defined cases: A-Z are folded, words are parted by ASCII white space; texts under five words are
one shingle; null and empty texts are alike; shingles and equal sets go by 64-bit hashes; rows that
share a doc_id and a component stay or go together; null doc_ids count as the smallest id; an empty
table gives an empty result; other columns are carried in a struct.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathmere.llm.arrow import forget, map_arrow, mix, raw, shingles, slices, word_hashes
from pathmere.llm.graph import components, stored
from pathmere.llm.simhash import _LOWER, _NO_ID, BLOCKS, BUDGET, links, simhashes

SIZE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5
#: Nodes of a list that are compared with its other nodes in one group, about.
LIST_BLOCK = 2048
#: Shingles that one task sorts, about.
PART_ROWS = 400_000
_SALTS, _FACTORS = np.random.default_rng(21).integers(1, 2**63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in order, and the first of each text."""
    data, offsets = raw(texts)
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    words, first = word_hashes(_LOWER[data], offsets)
    hashes, at = shingles(words, first, size)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((hashes, doc))
    hashes = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.concatenate(([0], np.cumsum(new)))[at]


def _folded(values: np.ndarray, at: np.ndarray, how: np.ufunc) -> np.ndarray:
    """``how`` over the values of each text; zero where there are none."""
    out, some = np.zeros(len(at) - 1, np.uint64), np.diff(at) > 0
    if some.any():
        out[some] = how.reduceat(values, at[:-1][some])
    return out


def _names(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    return mix(_folded(mix(hashes ^ _SALTS[0]), at, np.add))


def signatures(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``(id, node, n, fp, bands)``: set of each document by name, its size, SimHash and MinHash bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                texts = batch.column(1).slice(lo, hi - lo)
                hashes, at = _sets(texts, size)
                bands = np.zeros((hi - lo, BANDS), np.uint64)
                for k in range(BANDS * ROWS):
                    least = _folded((hashes ^ _SALTS[k]) * _FACTORS[k], at, np.minimum)
                    bands[:, k // ROWS] = mix(bands[:, k // ROWS] * np.uint64(31) + least)
                signed = lambda x: pa.array(x.view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), signed(bands.ravel()))
                columns = [batch.column(0).slice(lo, hi - lo), signed(_names(hashes, at)), pa.array(np.diff(at)), signed(simhashes(texts, size)), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "node", "n", "fp", "bands"])
        forget()

    return map_arrow(_rows(docs), run, "id long, node long, n long, fp long, bands array<long>")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.col("text").cast("string").alias("text"))


def _shingle_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """``(node, shingles)`` of ``nodes (node, id)``, read again from the documents named there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                hashes, at = _sets(batch.column(0).slice(lo, hi - lo), size)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(_names(hashes, at).view(np.int64)), lists], names=["node", "shingles"])
        forget()

    texts = _rows(docs).join(nodes.select("id").distinct(), "id", "left_semi").select("text")
    found = map_arrow(texts, run, "node long, shingles array<long>")
    return found.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _alike(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` whose sets have at least the Jaccard ``threshold``."""
    side = lambda k: sets.select(F.col("node").alias(k), F.col("shingles").alias(f"of_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.size(F.array_intersect("of_a", "of_b")).alias("common"), (F.size("of_a") + F.size("of_b")).alias("n"))
    return both.where(F.col("common") >= F.lit(threshold) * (F.col("n") - F.col("common"))).select("a", "b")


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """``(token, node, n, pos)``: the rarest shingles of each set that another set has too, at their place from rare to frequent."""
    total = sets.agg(F.sum(F.size("shingles"))).first()[0] or 0
    parts = max(sets.sparkSession.sparkContext.defaultParallelism, min(total // PART_ROWS, 100_000))
    listed = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("token")).repartition(parts, "token")
    counted = listed.withColumn("sets", F.count("*").over(Window.partitionBy("token"))).where("sets > 1")
    order = Window.partitionBy("node").orderBy("sets", "token")
    own = Window.partitionBy("node")
    placed = counted.select("token", "node", "n", (F.col("n") - F.count("*").over(own) + F.row_number().over(order) - 1).alias("pos"))
    return placed.where(F.col("pos") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9))


def _fits(threshold: float) -> Callable[[Column, Column, Column, Column], Column]:
    """Whether two sets that share the shingle at their positions have room for an overlap that makes them alike."""
    share = threshold / (1 + threshold)
    return lambda n, i, m, j: (F.least(n, m) >= threshold * F.greatest(n, m) - 1e-9) & (F.least(n - i, m - j) >= share * (n + m) - 1e-9)


def apart(lists: DataFrame, member: DataFrame, threshold: float, block: int = LIST_BLOCK) -> DataFrame:
    """Distinct pairs ``(a, b)`` of a list in different components that fit by length and position."""
    share = threshold / (1 + threshold)
    blocks = F.ceil(F.count("*").over(Window.partitionBy("token")) / block).cast("int")
    placed = stored(lists.join(member, "node", "left").select("token", "node", "n", "pos", F.coalesce("component", "node").alias("c"), blocks.alias("blocks")), "similar-parts")
    side = lambda k, salt: placed.select("token", salt.alias("salt"), *(F.col(x).alias(f"{x}_{k}") for x in ("node", "n", "pos", "c")))
    may_be_shorter = F.col("n_a") - F.col("pos_a") >= share * 2 * F.col("n_a") - 1e-9
    shorter = side("a", F.pmod(F.xxhash64("node"), "blocks").cast("int")).where(may_be_shorter)
    longer = side("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    ordered = (F.col("n_a") < F.col("n_b")) | (F.col("n_a") == F.col("n_b")) & (F.col("node_a") < F.col("node_b"))
    found = shorter.join(longer, ["token", "salt"]).where(ordered & (F.col("c_a") != F.col("c_b")) & _fits(threshold)(*map(F.col, ("n_a", "pos_a", "n_b", "pos_b"))))
    return found.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def by_fingerprint(signed: DataFrame, budget: int = BUDGET, blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """``(a, b)`` edges that connect the nodes of ``signed (node, n, fp)`` linked by fingerprints within the budget."""
    prints = stored(signed.where("n > 0").select("node", "fp").distinct(), "similar-fingerprints")
    near = components(links(prints.select("fp").distinct(), budget=budget, blocks=blocks)).select(F.col("node").alias("fp"), "component")
    placed = prints.join(near, "fp", "left").select("node", F.coalesce("component", "fp").alias("c"))
    least = placed.groupBy("c").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("c", "a")
    return placed.join(least, "c").where("node <> a").select("a", F.col("node").alias("b")).distinct()


def similar_components(docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, budget: int = BUDGET, blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """``(id, component_id)``, one row per document; a null doc_id is the smallest id."""
    signed = stored(signatures(docs, size), "similar-signatures")
    nodes = stored(signed.groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands")), "similar-nodes")
    prints = stored(by_fingerprint(signed, budget, blocks), "similar-prints")
    keys = nodes.where("n > 0").select(F.posexplode("bands").alias("band", "key"), "node")
    shared = keys.groupBy("band", "key").agg(F.count("*").alias("rows")).where("rows > 1").select("band", "key")
    able = stored(keys.join(shared, ["band", "key"], "left_semi").select("node").distinct(), "similar-able")
    sets = stored(_shingle_sets(docs, nodes.join(able, "node", "left_semi").select("node", "id"), size), "similar-sets")
    lists = stored(prefixes(sets, threshold), "similar-lists")

    fits = _fits(threshold)
    firsts = lists.groupBy("token").agg(F.min(F.struct("pos", "node", "n")).alias("first"))
    stars = lists.join(firsts, "token").where((F.col("node") != F.col("first.node")) & fits(F.col("n"), F.col("pos"), F.col("first.n"), F.col("first.pos")))
    stars = stored(stars.select(F.least("node", "first.node").alias("a"), F.greatest("node", "first.node").alias("b")).distinct(), "similar-stars")
    linked = stored(_alike(stars, sets, threshold).unionByName(prints), "similar-links")
    pairs = apart(lists, components(linked), threshold).join(stars, ["a", "b"], "left_anti")
    linked = stored(linked.unionByName(_alike(stored(pairs, "similar-pairs"), sets, threshold)), "similar-links")

    rows = signed.select("id", "node").join(components(linked), "node", "left").select("id", F.coalesce("component", "node").alias("c"))
    return rows.join(rows.groupBy("c").agg(F.min("id").alias("component_id")), "c").select("id", "component_id")


def drop_similar(docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, budget: int = BUDGET, blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """The documents whose id is the least of their component, with all their columns."""
    kept = similar_components(docs, size, threshold, budget, blocks).where("id = component_id").select("id").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"))
    return rows.join(kept, "id", "left_semi").select("row.*")
