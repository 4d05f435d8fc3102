"""SimHash near-dedup: fingerprints, and links within two bits found by a binary trie self-join.

Shingle size, bit budget and blocks are parameters; the text names their defaults (3, 2, 3 blocks).
Two fingerprints that differ in at most two bits agree in one of three blocks of bits. Three tries
are joined with themselves, each with another block on top, and a pair of nodes is followed only
while its differing bits are within the budget: none in the top block, two below it. The top
block is an equi-key for Spark. A top node with very many fingerprints is split by further
levels: each row goes to every pair of child nodes within the budget, as the traversal would.
Inside a task all node pairs of a level are advanced together as arrays.

Distinct fingerprints only take part, each of which has at most 2,080 others within two bits, so
links grow in proportion to the input even in one dense group of near copies. A task hands on a
spanning star for each set it has connected, not its links.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; texts under
three words are one shingle; rows that share a doc_id share a decision when they share a
component, and stay or go together; null doc_ids count as the smallest id; an empty table gives an
empty result; other columns are carried in a struct.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathmere.llm.arrow import IS_SPACE, map_arrow, raw, slices, spans
from pathmere.llm.graph import components, stored

BITS, BUDGET = 64, 2
#: Widths of the three blocks, highest first.
BLOCKS = (22, 21, 21)
#: Fingerprints of one node pair that a task may hold; beyond it the node is split on.
NODE_ROWS, SPLIT_BITS = 100_000, 8
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_NO_ID = -(1 << 63)


def simhashes(texts: pa.Array, size: int = 3, seed: int = 42) -> np.ndarray:
    """Unsigned 64-bit fingerprints of whole texts."""
    out = np.zeros(len(texts), np.uint64)
    for start, stop in slices(texts):
        data, offsets = raw(texts.slice(start, stop - start))
        if not len(data):
            continue
        inside = ~IS_SPACE[data]
        starts, ends, first = spans(data, offsets, inside)
        keep = inside.copy()
        keep[ends[ends < len(data)]] = True  # one blank after each word
        moved = np.concatenate(([0], np.cumsum(keep)))
        text = np.where(inside, _LOWER[data], 32).astype(np.uint8)[keep].tobytes()
        n = np.diff(first)
        counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
        at = np.concatenate(([0], np.cumsum(counts)))
        if not at[-1]:
            continue
        left = np.repeat(first[:-1] - at[:-1], counts) + np.arange(at[-1])
        right = np.minimum(left + size, np.repeat(first[1:], counts)) - 1
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(text[a:b], seed) for a, b in zip(moved[starts[left]].tolist(), moved[ends[right]].tolist())), np.uint64, at[-1])
        for lo in range(0, len(counts), 256):  # 2,048 counters for each document
            hi = min(lo + 256, len(counts))
            some = hashes[at[lo] : at[hi]]
            doc = np.repeat(np.arange(hi - lo) * 2048, counts[lo:hi])
            keys = doc[:, None] + np.arange(8) * 256 + some.view(np.uint8).reshape(-1, 8)
            seen = np.bincount(keys.ravel(), minlength=(hi - lo) * 2048).reshape(hi - lo, 8, 256) @ _BYTE_BITS
            bits = (2 * seen.reshape(hi - lo, 64) > counts[lo:hi, None]).astype(np.uint8)
            out[start + lo : start + hi] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(simhashes(batch.column(1), size).view(np.int64))], names=["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, fp long")


def _rotated(fp: Column, by: int) -> Column:
    return fp if not by else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by))


def _nodes(fps: DataFrame, blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """Each fingerprint in its top node of each trie: ``(trie, depth, a, b, side, x)``; a and b are the pair's prefixes."""
    tries = []
    for trie, width in enumerate(blocks):
        x = _rotated(F.col("fp"), sum(blocks[:trie]))
        top = F.shiftrightunsigned(x, BITS - width)
        tries.append(F.struct(F.lit(trie).alias("trie"), F.lit(width).alias("depth"), top.alias("a"), top.alias("b"), F.lit(0).alias("side"), x.alias("x")))
    return fps.select(F.explode(F.array(*tries)).alias("n")).select("n.*")


def _split(nodes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Send each row of a heavy node to all pairs of child nodes, ``SPLIT_BITS`` levels down, within the budget."""
    masks = [m for m in range(1 << SPLIT_BITS) if bin(m).count("1") <= budget]
    bits = F.least(F.lit(SPLIT_BITS), F.lit(BITS) - F.col("depth"))
    spent = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    own = F.expr(f"shiftrightunsigned(shiftleft(x, depth), {BITS} - least({SPLIT_BITS}, {BITS} - depth))")
    moved = nodes.withColumn("own", own).withColumn("mask", F.explode(F.lit(masks))).where((spent + F.bit_count("mask") <= budget) & (F.col("mask") < F.expr(f"shiftleft(1, least({SPLIT_BITS}, {BITS} - depth))")))
    moved = moved.withColumn("other", F.col("own").bitwiseXOR(F.col("mask").cast("long"))).withColumn("bits", bits)
    one = F.col("a") == F.col("b")
    swap = F.when(one, F.col("other") < F.col("own")).otherwise(F.col("side") == 1)
    left, right = F.when(swap, F.col("other")).otherwise(F.col("own")), F.when(swap, F.col("own")).otherwise(F.col("other"))
    grow = lambda prefix, child: F.expr(f"shiftleft({prefix}, bits)").bitwiseOR(child)
    return moved.select("trie", (F.col("depth") + F.col("bits")).alias("depth"), grow("a", left).alias("a"), grow("b", right).alias("b"), F.when(one & (F.col("mask") == 0), F.lit(0)).when(swap, 1).otherwise(0).alias("side"), "x")


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least member of the set of each of n items under the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (deeper := label[label])is not label and (deeper != label).any():
            label = deeper
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def trie_links(x: np.ndarray, pairs: np.ndarray, depth: np.ndarray, budget: int = BUDGET, leaf: int = 32, chunk: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of ``x`` within the budget, below given pairs of nodes.

    ``x`` is sorted within each node, ``pairs`` has columns (a from, a to, b from, b to, differing
    bits so far), ``depth`` the next level. Children are cut at the bit of the level by binary
    search; small pairs are compared directly.
    """
    found_a, found_b = [], []
    stack = [(pairs, depth)]
    while stack:
        now, level = stack.pop()
        if len(now) > chunk:  # bounds memory: depth first over chunks
            half = len(now) // 2
            stack += [(now[:half], level[:half]), (now[half:], level[half:])]
            continue
        na, nb = now[:, 1] - now[:, 0], now[:, 3] - now[:, 2]
        small = (na * nb <= leaf) | (level >= BITS)
        if small.any():
            s, size = now[small], (na * nb)[small]
            at = np.repeat(np.arange(len(s)), size)
            k = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
            i, j = s[at, 0] + k // nb[small][at], s[at, 2] + k % nb[small][at]
            near = (np.bitwise_count(x[i] ^ x[j]) <= budget) & ((s[at, 0] != s[at, 2]) | (i < j))
            found_a.append(i[near])
            found_b.append(j[near])
        now, level = now[~small], level[~small]
        if not len(now):
            continue
        cut = []
        for lo, hi in ((now[:, 0], now[:, 1]), (now[:, 2], now[:, 3])):
            low, high, bit = lo.copy(), hi.copy(), np.uint64(1) << (BITS - 1 - level).astype(np.uint64)
            while (live := low < high).any():  # first member whose bit of this level is set
                mid = (low + high) >> 1
                one = (x[np.minimum(mid, len(x) - 1)] & bit) != 0
                high = np.where(live & one, mid, high)
                low = np.where(live & ~one, mid + 1, low)
            cut.append(low)
        self_pair = now[:, 0] == now[:, 2]
        kids = []
        for p, q, cost in ((0, 0, 0), (1, 1, 0), (0, 1, 1), (1, 0, 1)):
            side_a = (now[:, 0], cut[0]) if p == 0 else (cut[0], now[:, 1])
            side_b = (now[:, 2], cut[1]) if q == 0 else (cut[1], now[:, 3])
            kid = np.stack([*side_a, *side_b, now[:, 4] + cost], axis=1)
            ok = (kid[:, 0] < kid[:, 1]) & (kid[:, 2] < kid[:, 3]) & (kid[:, 4] <= budget)
            ok &= ~(self_pair & (p == 1) & (q == 0))  # the mirror of (0, 1)
            ok &= ~((kid[:, 0] == kid[:, 2]) & (kid[:, 1] - kid[:, 0] < 2))
            kids.append((kid[ok], level[ok] + 1))
        stack.append((np.concatenate([k for k, _ in kids]), np.concatenate([d for _, d in kids])))
    none = np.empty(0, np.int64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


def _links_of(table: pa.Table, budget: int = BUDGET, blocks: tuple[int, ...] = BLOCKS) -> pa.RecordBatch:
    """Spanning stars of the whole nodes in a table sorted by (trie, depth, a, b, side, x unsigned)."""
    trie, depth, a, b, side = (table.column(i).to_numpy() for i in range(5))
    x = table.column(5).to_numpy().view(np.uint64) ^ np.uint64(1 << 63)  # the sort key has the sign flipped
    new = np.ones(len(x), bool)
    new[1:] = (trie[1:] != trie[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (depth[1:] != depth[:-1])
    at = np.flatnonzero(new)
    to = np.append(at[1:], len(x))
    ones = np.concatenate(([0], np.cumsum(side)))
    mid = to - (ones[to] - ones[at])  # where side b begins
    one = a[at] == b[at]
    pairs = np.stack([at, np.where(one, to, mid), np.where(one, at, mid), to, np.bitwise_count((a[at] ^ b[at]).view(np.uint64)).astype(np.int64)], axis=1)
    ok = np.where(one, to - at > 1, (mid > at) & (to > mid))
    i, j = trie_links(x, pairs[ok], depth[at][ok].astype(np.int64), budget)
    label = spanning(i, j, len(x))
    moved = np.flatnonzero(label != np.arange(len(x)))
    turn = np.array([0, *np.cumsum(blocks)[:-1]], np.uint64)[trie]
    back = np.where(turn == 0, x, (x >> turn) | (x << ((np.uint64(BITS) - turn) & np.uint64(BITS - 1)))).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(back[moved]), pa.array(back[label[moved]])], names=["a", "b"])


def links(fps: DataFrame, node_rows: int = NODE_ROWS, budget: int = BUDGET, blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """``(a, b)`` edges that connect exactly the distinct fingerprints ``(fp)`` linked within ``budget`` bits."""
    if sum(blocks) != BITS or len(blocks) <= budget:
        raise ValueError(f"{len(blocks)} blocks of {sum(blocks)} bits for a budget of {budget}")
    nodes, key = _nodes(fps, blocks), ["trie", "depth", "a", "b"]
    done = None
    while True:
        heavy = nodes.groupBy(*key).count().where((F.col("count") > node_rows) & (F.col("depth") < BITS)).select(*key)
        heavy = stored(heavy, "simhash-heavy")
        if heavy.isEmpty():
            break
        light = nodes.join(heavy, key, "left_anti")
        done = light if done is None else done.unionByName(light)
        nodes = stored(_split(nodes.join(heavy, key, "left_semi"), budget), "simhash-nodes")
    nodes = nodes if done is None else done.unionByName(nodes)
    flipped = F.col("x").bitwiseXOR(F.lit(_NO_ID))  # signed order of the flipped value is unsigned order
    nodes = nodes.withColumn("x", flipped).repartition(*key).sortWithinPartitions(*key, "side", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(i)[batch.num_rows - 1] for i in range(4)]
            same = None
            for i, value in enumerate(last):
                equal = pc.equal(batch.column(i), value)
                same = equal if same is None else pc.and_(same, equal)
            tail = int(pc.sum(same).as_py())
            head = batch.num_rows - tail
            if head or (held and [held[-1].column(i)[held[-1].num_rows - 1] for i in range(4)] != last):
                whole = pa.Table.from_batches([*held, batch.slice(0, head)])
                if whole.num_rows:
                    yield _links_of(whole, budget, blocks)
                held = []
            held.append(batch.slice(head))
        if held:
            yield _links_of(pa.Table.from_batches(held), budget, blocks)

    return map_arrow(nodes.select(*key, "side", "x"), run, "a long, b long")


def near_components(docs: DataFrame, size: int = 3, budget: int = BUDGET, blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per document."""
    prints = stored(fingerprints(docs, size).withColumn("doc_id", F.coalesce("doc_id", F.lit(_NO_ID))), "simhash-prints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("doc")), "simhash-distinct")
    member = components(links(distinct.select("fp"), budget=budget, blocks=blocks))
    distinct = distinct.join(member, F.col("fp") == F.col("node"), "left").select("fp", "doc", F.coalesce("component", "fp").alias("c"))
    least = distinct.groupBy("c").agg(F.min("doc").alias("component_id"))
    named = distinct.join(least, "c").select("fp", "component_id")
    clean = lambda c: F.nullif(F.col(c), F.lit(_NO_ID)).alias(c)
    return prints.join(named, "fp").select(clean("doc_id"), "fp", clean("component_id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The documents whose id is the least of their component, with all their columns."""
    kept = near_components(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"))
    return rows.join(kept, "id", "left_semi").select("row.*")
