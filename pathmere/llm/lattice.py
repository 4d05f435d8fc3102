"""Embedding near-dedup by lattice hashing: vectors of one label are linked at cosine 0.98 or more.

1. Rows with the same vector and label are one class (two 64-bit hashes of label and components),
   so a vector that a third of all rows repeat is compared once.
2. Each of ``TABLES`` tables projects the unit vector at random to ``BLOCKS`` times eight
   dimensions, and each eight are decoded to the nearest point of the E8 lattice. A vector is at
   home in the cell of its points and visits the cells of the ``PROBES`` lattice neighbours (of the
   240 least vectors of E8, in any block) that it is nearest to. Only keys are shuffled here.
3. Cells with one vector at home and another one at home or visiting are compared. A cell is cut
   into blocks of about ``BLOCK`` vectors, and each pair of blocks is a group of its own, so that no
   cell is held in one task and no vector is left out. Vectors are fetched for such cells only.
4. Inside a pair of blocks all cosines are one matrix product in doubles. A linked pair may be found
   in several cells; it counts where it is found first (by table, then the cell of the smaller node),
   which both vectors' cells tell without asking another task. What leaves a block is one count and
   one edge to the least node of its part for each vector, not pairs.

Recall at cosine 0.98 is about 0.9997 for one pair (by simulation at 64 dimensions; more for likelier
pairs); at the shapes of these tables false candidates are rare. For much larger labels, more
``BLOCKS`` with more ``TABLES`` keep cells small.

Defined cases: a null label, and a vector that is null, empty, zero or holds a null or non-finite
component, link with nothing: no links, their own id as component. Vectors of different length do not
link. Equal vectors (also rows repeated whole) link with each other. A null vec_id takes part; it is
never the component's id unless all ids of the component are null, and such a row is kept only then.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathmere.llm.arrow import joined, map_arrow, mix
from pathmere.llm.graph import components, stored

COSINE = 0.98
TABLES, BLOCKS, PROBES = 7, 2, 3
#: Edge of a lattice cell: the projection of a unit vector of D dimensions is stretched by WIDTH * sqrt(D / 8).
WIDTH = 1.77
#: Vectors of a cell that one group compares with as many others, about.
BLOCK = 512
#: Rows that are hashed or compared together.
CHUNK = 4096
#: What is compared together: a cell, vectors of one label and length, a pair of blocks.
GROUP = ("key", "kind", "i", "j")


def least_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    whole = [[a if k == i else b if k == j else 0 for k in range(8)] for i, j in combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    half = [s for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + half, dtype=np.float64)


_NEAR = least_vectors()


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum: round, and re-round the worst entry the other way where the sum is odd."""
    near = np.rint(x)
    off = x - near
    rows = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(off[rows]).argmax(axis=1)
    near[rows, worst] += np.where(off[rows, worst] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row of eight numbers: the better of both cosets of the even integer points."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


@lru_cache(maxsize=64)
def _table(table: int, dims: int, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Projection, shift and hash factors of a table."""
    random = np.random.default_rng([table, dims, blocks])
    onto = random.normal(size=(dims, 8 * blocks))
    onto = np.linalg.qr(onto)[0] if dims >= 8 * blocks else onto / np.linalg.norm(onto, axis=0)
    return onto * WIDTH * np.sqrt(dims / 8), random.uniform(0, 1, 8 * blocks), random.integers(0, 1 << 63, 8 * blocks, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def cells(unit: np.ndarray, kind: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES) -> np.ndarray:
    """Keys of shape (vectors, tables, 1 + probes): the home cell, then the neighbours nearest first."""
    out = np.empty((len(unit), tables, 1 + probes), np.uint64)
    for table in range(tables):
        onto, shift, factors = _table(table, unit.shape[1], blocks)
        x = (unit @ onto + shift).reshape(-1, 8)
        point = decode(x)
        factors = factors.reshape(blocks, 8)
        doubled = lambda v: np.rint(2 * v).astype(np.int64).view(np.uint64)
        home = (doubled(point).reshape(-1, blocks, 8) * factors).sum(axis=(1, 2), dtype=np.uint64) + kind + np.uint64(table)
        step = (doubled(_NEAR)[None] * factors[:, None]).sum(axis=2, dtype=np.uint64).ravel()
        gain = ((x - point) @ _NEAR.T).reshape(len(unit), -1)
        top = np.argpartition(-gain, probes - 1, axis=1)[:, :probes]
        out[:, table, 0] = mix(home)
        out[:, table, 1:] = mix(home[:, None] + step[top])
    return out


def _units(vectors: pa.Array, dims: int) -> np.ndarray:
    """Vectors of one length, of norm one, in doubles."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _earlier(a: np.ndarray, b: np.ndarray, table: int, second: bool) -> np.ndarray:
    """Whether pairs with cells ``a`` (smaller node) and ``b`` were found before the cell of this table."""
    found = np.zeros(len(a), bool)
    for t in range(table + 1):
        if t < table or second:
            found |= (b[:, t] == a[:, t, :1]).any(axis=1)
        if t < table:
            found |= (a[:, t] == b[:, t, :1]).any(axis=1)
    return found


def compare(unit: np.ndarray, keys: np.ndarray, node: np.ndarray, table: int, left: np.ndarray, right: np.ndarray, cosine: float) -> tuple[np.ndarray, ...]:
    """Pairs (of positions) of a left vector, at home here, and a right one, that are linked and found here first."""
    u, v = np.nonzero(unit[left] @ unit[right].T >= cosine)
    u, v = left[u], right[v]
    other = node[u] != node[v]
    u, v = u[other], v[other]
    keep = []
    for at in range(0, len(u), CHUNK):
        x, y = u[at : at + CHUNK], v[at : at + CHUNK]
        owner_first = node[x] < node[y]
        seen = np.empty(len(x), bool)
        for second in (False, True):
            of = owner_first != second
            a, b = (y[of], x[of]) if second else (x[of], y[of])
            seen[of] = _earlier(keys[a], keys[b], table, second)
        keep.append(~seen)
    kept = np.concatenate(keep) if keep else np.zeros(0, bool)
    return u[kept], v[kept]


def _least(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least position that each of ``n`` positions reaches over the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(id, x, y)`` of every row, x null where it links with nothing, and stored classes ``(node, x, y, least, rows, kind, vec)``."""
    vec = F.col("embedding")
    sound = F.col("label").isNotNull() & vec.isNotNull()
    finite = lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))
    sound = sound & F.forall(vec, finite) & F.exists(vec, lambda v: v != 0)
    label = F.col("label").cast("string")
    plain = F.transform(vec, lambda v: v + F.lit(0).cast("int"))  # -0.0 is 0.0
    named = rows.select(F.col("vec_id").cast("long").alias("id"), F.coalesce(sound, F.lit(False)).alias("sound"), label.alias("label"), plain.alias("vec"))
    named = named.withColumns({"x": F.when(F.col("sound"), F.xxhash64("label", "vec")), "y": F.when(F.col("sound"), F.xxhash64(F.lit("second"), "vec", "label"))})
    kind = F.xxhash64("label", F.size("vec"))
    found = named.where("sound").groupBy("x", "y").agg(F.min("id").alias("least"), F.count("*").alias("rows"), F.first(kind).alias("kind"), F.first("vec").alias("vec"))
    return named.select("id", "x", "y"), stored(found.withColumn("node", F.monotonically_increasing_id()), "vector-classes")


def cell_keys(found: DataFrame, tables: int, blocks: int, probes: int) -> DataFrame:
    """``(key, tbl, node, home)``: the cells of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                for lo in range(0, len(at), CHUNK):
                    part = batch.take(pa.array(at[lo : lo + CHUNK]))
                    keys = cells(_units(part.column(2), int(d)), part.column(1).to_numpy().view(np.uint64), tables, blocks, probes)
                    n, each = len(part), tables * (1 + probes)
                    columns = [pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), 1 + probes), n)),
                               pa.array(np.repeat(part.column(0).to_numpy(), each)), pa.array(np.tile(np.arange(1 + probes) == 0, n * tables))]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "tbl", "node", "home"])

    return map_arrow(found.select("node", "kind", "vec", F.size("vec").alias("dims")), run, "key long, tbl int, node long, home boolean")


def linked(groups: DataFrame, tables: int, blocks: int, probes: int, cosine: float) -> DataFrame:
    """``(node, links, least)`` for each vector linked in a group: rows it is linked to there, and the least node of its part."""

    def outcome(rows: pa.Table) -> pa.RecordBatch:
        column = lambda name: rows[name].to_numpy()
        node, n, dims, left, table, kinds = map(column, ("node", "rows", "dims", "left", "tbl", "kind"))
        same = np.logical_and.reduce([column(name)[1:] == column(name)[:-1] for name in GROUP])
        ends = np.append(np.flatnonzero(~same) + 1, len(node))
        starts = np.append(0, ends[:-1])
        links, pairs = np.zeros(len(node), np.int64), []
        vectors = rows["vec"].combine_chunks()
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            unit = _units(vectors.take(pa.array(at)), int(d))
            keys, named = cells(unit, kinds[at].view(np.uint64), tables, blocks, probes), node[at]
            for lo, hi in zip(np.searchsorted(at, starts), np.searchsorted(at, ends)):
                own = np.arange(lo, hi)
                side = left[at[lo:hi]]
                if lo < hi:
                    u, v = compare(unit, keys, named, int(table[at[lo]]), own[side], own[~side], cosine)
                    pairs.append((at[u], at[v]))
        u, v = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
        np.add.at(links, u, n[v])
        np.add.at(links, v, n[u])
        # positions of one node (it may be on both sides, and in several groups) are one
        order = np.unique(node, return_index=True, return_inverse=True)
        least = _least(len(order[0]), order[2][u], order[2][v])
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(order[0][least[order[2][some]]])], names=["node", "links", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            rest.append(batch)
            if sum(map(len, rest)) < CHUNK:
                continue
            rows = joined(rest)
            last = np.logical_and.reduce([rows[name].to_numpy() == rows[name][-1].as_py() for name in GROUP])
            cut = 0 if last.all() else len(rows) - int(last[::-1].argmin())  # the last group may go on in the next batch
            if cut:
                yield outcome(rows.slice(0, cut))
                rest = rows.slice(cut).combine_chunks().to_batches()
        if rest and sum(map(len, rest)):
            yield outcome(joined(rest))

    return map_arrow(groups.repartition(*GROUP).sortWithinPartitions(*GROUP, "node"), run, "node long, links long, least long")


def near_components(rows: DataFrame, cosine: float = COSINE, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row for each row of ``rows (vec_id, embedding, label)``."""
    named, found = classes(rows)
    keys = stored(cell_keys(found, tables, blocks, probes), "lattice-keys")
    crowded = keys.groupBy("key").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count("*").alias("n")).where("homes > 0 and n > 1")
    of = lambda n: F.ceil(F.col(n) / F.lit(block)).cast("int")
    member = keys.join(crowded.select("key", of("homes").alias("lefts"), of("n").alias("rights")), "key")
    # a vector at home is a left one against every block of the cell; every vector is a right one against every block of those at home
    place = F.xxhash64("node")
    lefts = F.transform(F.sequence(F.lit(0), F.col("rights") - 1), lambda j: F.struct(F.pmod(place, "lefts").cast("int").alias("i"), j.alias("j"), F.lit(True).alias("left")))
    rights = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda i: F.struct(i.alias("i"), F.pmod(place, "rights").cast("int").alias("j"), F.lit(False).alias("left")))
    sides = F.when(F.col("home"), F.concat(lefts, rights)).otherwise(rights)
    dealt = member.select("key", "tbl", "node", F.explode(sides).alias("at")).select("key", "tbl", "node", "at.*")
    groups = dealt.join(found.select("node", "rows", "kind", "vec", F.size("vec").alias("dims")), "node")
    links = stored(linked(groups, tables, blocks, probes, cosine), "lattice-links")
    parts = components(links.select(F.col("node").alias("a"), F.col("least").alias("b")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    whole = found.select("node", "x", "y", "least", "rows").join(parts, "node", "left").join(counts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    known = whole.join(least, "component").select("x", "y", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"), "component_id")
    out = named.join(known, ["x", "y"], "left")
    component = F.when(F.col("x").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
