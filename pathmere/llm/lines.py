"""Fuzzy line dedup: one line of each group of near-equal lines stays, in the whole corpus.

A line is a run of text between newlines without its outer white space; blank lines always stay.
Lines are alike if the Jaccard likeness of their sets of 8-character shingles is 0.8 or more (a
shorter line is one shingle), and groups are the connected components of that relation; the first
line of a group (smallest doc_id, then position) stays.

1. Every batch of documents signs its distinct lines by MinHash: 30 permutations in 10 bands of 3.
   A pair at 0.8 shares a band with a chance of 0.999. Bands travel by ranges of their keys, many in
   a row; a task sorts a range and keeps the keys that two different lines share. Each line of such
   a band meets the band's least line, its leader.
2. A second pass writes the first place of every line in a batch, and the texts of these lines. A
   Bloom filter of at most 8 MB keeps most other texts out; it only ever lets too many pass.
3. Lines of all bands of one leader are compared exactly by a breadth-first walk: each line reached
   is compared at once with all lines not reached yet, so a group of near copies costs about one
   comparison for each line. A band is whole in the group of its leader, and near copies, which
   share most of their bands, meet in one group. Groups hold distinct lines only: a line in a third
   of all documents is there once.
4. Components join across bands by distributed union-find, and the first line of each is found by
   ordinary aggregation.

Defined cases: a null text has no lines; rows that share a doc_id are told apart by their position
in the input (``monotonically_increasing_id``), which also orders them; a null doc_id comes first;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathmere.llm.arrow import IS_SPACE, SPACE, byte_sums, map_arrow, mix, powers, raw, slices, span_hashes
from pathmere.llm.graph import components, stored

SHINGLE, LIKENESS = 8, 0.8
BANDS, BAND_ROWS = 10, 3
#: Bits of the Bloom filter that is sent to all tasks, at most: 8 MB.
FILTER_BITS, PROBES = 1 << 26, 2
#: Bytes of text whose lines are looked at together, and bytes that are signed together: both stay in the processor's cache.
LINE_BYTES, SIGN_BYTES = 1 << 18, 1 << 16
#: Bytes of text whose bands are sorted by one task at a time, about.
RANGE_BYTES = 1 << 24
#: Lines of a batch whose bands are sent together, at most.
SENT = 1 << 20
#: Lines whose bands are compared together, at least.
COMPARED = 1024
_random = np.random.default_rng(9)
_XOR = _random.integers(0, 1 << 32, BANDS * BAND_ROWS, dtype=np.uint32)
_FACTOR = _random.integers(0, 1 << 31, BANDS * BAND_ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

_TAG = np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _stripped(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
    """Move the bounds of lines in place past their outer white space."""
    for edge, off, step in ((start, 0, 1), (end, -1, -1)):
        at = np.flatnonzero(start < end)
        for _ in range(8):
            at = at[IS_SPACE[data[edge[at] + off]]]
            edge[at] += step
            at = at[start[at] < end[at]]
            if not len(at):
                break
        else:  # long white space: the next byte of content is looked up
            content = np.flatnonzero(~IS_SPACE[data])
            if step == 1:
                edge[at] = np.minimum(np.append(content, len(data))[np.searchsorted(content, edge[at])], end[at])
            else:
                edge[at] = np.maximum(np.append(content + 1, 0)[np.searchsorted(content, edge[at]) - 1], start[at])


def _shingles(data: np.ndarray, sums: np.ndarray, back: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the shingles from every character on, and the first and the end of those of each line that is not empty.

    ``sums`` and ``back``, the inverse powers, go with ``data``, which may be a part of some texts.
    """
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    if len(chars) == len(data):
        at, lo, hi, turn = sums, start, end, back[: len(chars)]
    else:
        at, lo, hi, turn = sums[np.append(chars, len(data))], np.searchsorted(chars, start), np.searchsorted(chars, end), back[chars]
    h = np.zeros(len(at), np.uint64)
    if len(at) > SHINGLE:
        h[:-SHINGLE] = mix((at[SHINGLE:] - at[:-SHINGLE]) * turn[: len(at) - SHINGLE])
    short = np.flatnonzero((hi - lo < SHINGLE) & (hi > lo))  # no other line has a shingle from there on
    h[lo[short]] = mix((sums[end[short]] - sums[start[short]]) * back[start[short]])
    return h, lo, np.maximum(hi - SHINGLE + 1, lo + 1)


class Lines:
    """The lines of some texts: text, position in it, span of bytes and 64-bit hash."""

    def __init__(self, texts: pa.Array):
        self.data, offsets = raw(texts)
        breaks = np.flatnonzero(self.data == 10)
        first = np.searchsorted(breaks, offsets)
        start = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
        end = np.sort(np.concatenate((breaks, offsets[1:])))
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first) + 1)
        _stripped(self.data, start, end)
        at = np.flatnonzero(start < end)
        self.start, self.end, self.doc = start[at], end[at], doc[at]
        self.pos = at - first[self.doc] - self.doc
        self.sums = byte_sums(self.data)
        self.h = span_hashes(self.sums, self.start, self.end)

    def second(self) -> np.ndarray:
        """The other half of the 128-bit hashes."""
        return span_hashes(byte_sums(self.data, 1), self.start, self.end, 1)

    def bands(self) -> np.ndarray:
        """Keys of the bands of all lines, one row for each line."""
        least = np.empty((BANDS * BAND_ROWS, len(self.h)), np.uint64)
        if not len(self.h):
            return least[:BANDS].T
        back = powers(len(self.sums), 0, True)
        a = 0
        while a < len(self.h):
            base = int(self.start[a])
            b = max(a + 1, int(np.searchsorted(self.end, base + SIGN_BYTES, "right")))
            top = int(self.end[b - 1])
            h, lo, hi = _shingles(self.data[base:top], self.sums[base : top + 1], back[base : top + 1], self.start[a:b] - base, self.end[a:b] - base)
            h = (h >> np.uint64(32)).astype(np.uint32)
            runs = np.stack((lo, hi), axis=1).ravel()  # every second run lies between two lines
            turned = np.empty_like(h)
            for k in range(BANDS * BAND_ROWS):
                np.multiply(np.bitwise_xor(h, _XOR[k], out=turned), _FACTOR[k], out=turned)
                least[k, a:b] = np.minimum.reduceat(turned, runs)[::2]
            a = b
        least += _TAG[:, None]
        keys = np.arange(BANDS, dtype=np.uint64)[:, None]
        for k in range(BAND_ROWS):
            keys = mix(keys ^ least[k::BAND_ROWS])
        return keys.T


def _firsts(h: np.ndarray, g: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first of each set of lines with equal hashes, texts in the order of ``rank``."""
    order = np.lexsort((np.arange(len(h)), rank, g, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (g[order[1:]] != g[order[:-1]])
    return np.sort(order[new])


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of values as bytes, each up to its end."""
    offsets = np.concatenate(([0], ends * values.itemsize)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))


def _several(band: np.ndarray, line: np.ndarray) -> pa.RecordBatch:
    """Of the bands that two different lines share, each line with the least line of its band."""
    order = np.argsort(band)
    for _ in range(2):  # most bands stand alone; of the others, equal lines are dropped
        band, line = band[order], line[order]
        same = band[1:] == band[:-1]
        both = np.zeros(len(band), bool)
        both[1:] |= same
        both[:-1] |= same
        band, line = band[both], line[both]
        order = np.lexsort((line, band))
        new = np.ones(len(order), bool)
        new[1:] = (band[order[1:]] != band[order[:-1]]) | (line[order[1:]] != line[order[:-1]])
        order = order[new]
    new = np.ones(len(band), bool)
    new[1:] = band[1:] != band[:-1]
    leader = line[new][np.cumsum(new) - 1]
    return pa.RecordBatch.from_arrays([pa.array(leader.view(np.int64)), pa.array(line.view(np.int64))], names=["leader", "line"])


def repeated_bands(docs: DataFrame) -> DataFrame:
    """``(leader, line)`` of all lines, by half their hash, that share a band with another line: leader is the least line of the band.

    Bands travel by ranges of their keys, one row for each batch of texts and range; there are as
    many ranges as keep one at about ``RANGE_BYTES`` of text, so a task sorts a bounded part.
    """
    size = docs.select(F.sum(F.octet_length(F.col("text").cast("string"))).alias("n")).first()["n"] or 0
    bits = max(8, (size // RANGE_BYTES).bit_length())

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        for batch in batches:
            parts = [Lines(batch.column(0).slice(lo, hi - lo)) for lo, hi in slices(batch.column(0), LINE_BYTES)]
            if not (parts := [(x.h, x.bands()) for x in parts if len(x.h)]):
                continue
            line, at = np.unique(np.concatenate([h for h, _ in parts]), return_index=True)
            own = np.concatenate([b for _, b in parts])[at]
            for a in range(0, len(line), SENT):
                keys = own[a : a + SENT].ravel()
                order = np.argsort(keys)
                keys, of = keys[order], line[a + order // BANDS]
                ends = np.append(np.searchsorted(keys, bounds), len(keys))
                part = np.flatnonzero(np.diff(ends, prepend=0))
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), _binary(keys, ends[part]), _binary(of, ends[part])], names=["part", "bands", "lines"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A range of keys after the other; the last one waits for the next batch."""
        now, held = None, []

        def closed() -> pa.RecordBatch:
            out = _several(*(np.concatenate([np.frombuffer(x[i], np.uint64) for x in held]) for i in range(2)))
            held.clear()
            return out

        for batch in batches:
            for part, keys, line in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now and held:
                    yield closed()
                now = part
                held.append((keys, line))
        if held:
            yield closed()

    signed = map_arrow(docs.select(F.col("text").cast("string").alias("text")), sign, "part int, bands binary, lines binary")
    ordered = signed.repartition("part").sortWithinPartitions("part")
    return stored(map_arrow(ordered, shared, "leader long, line long"), "line-bands")


def _filter(lines: DataFrame) -> np.ndarray:
    """Bloom filter of the line hashes: the bits of all partitions, or-ed."""
    n = lines.count()
    bits = min(FILTER_BITS, 1 << max(10, (8 * n).bit_length()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits, bool)
        for batch in batches:
            for which in range(PROBES):
                seen[_probe(batch.column(0).to_numpy().view(np.uint64), bits, which)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(seen).tobytes()], pa.binary())], names=["bits"])

    total = np.zeros(bits // 8, np.uint8)
    for row in map_arrow(lines.coalesce(8), fill, "bits binary").toLocalIterator():  # at most eight rows of 8 MB
        total |= np.frombuffer(row["bits"], np.uint8)
    return total


def _probe(h: np.ndarray, bits: int, which: int) -> np.ndarray:
    return ((h >> np.uint64(27 * which)) & np.uint64(bits - 1)).astype(np.int64)


def placed(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """``(line, id, doc_id, row, pos, text)``: the first place of each line in each batch of documents; texts of the given line hashes, and of few others."""
    bits = _filter(lines)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            # a line that is not first among its equals in a batch cannot be the first of its component
            ids = pc.fill_null(batch.column(0), -(1 << 63)).to_numpy()
            rank = np.empty(len(ids), np.int64)
            rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
            found = []
            for lo, hi in slices(texts, LINE_BYTES):
                x = Lines(texts.slice(lo, hi - lo))
                wanted = np.ones(len(x.h), bool)
                for which in range(PROBES):
                    where = _probe(x.h, len(bits) * 8, which)
                    wanted &= (bits[where >> 3] >> (7 - (where & 7)).astype(np.uint8)) & 1 == 1
                own = np.full(len(x.h), None, object)
                for i in np.flatnonzero(wanted).tolist():
                    own[i] = x.data[x.start[i] : x.end[i]].tobytes()
                found.append((x.h, x.second(), x.doc + lo, x.pos, own))
            if not found:
                continue
            h, g, doc, pos, own = (np.concatenate(x) for x in zip(*found))
            at = _firsts(h, g, rank[doc])
            doc = pa.array(doc[at])
            both = _binary(np.stack([h[at], g[at]], axis=1).ravel(), 2 * np.arange(1, len(at) + 1))
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), both, batch.column(0).take(doc), batch.column(1).take(doc), pa.array(pos[at]), pa.array(own[at], pa.string())], names=["line", "id", "doc_id", "row", "pos", "text"])

    return stored(map_arrow(_rows(docs), fetch, "line long, id binary, doc_id long, row long, pos long, text string"), "line-places")


def _shingle_table(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each line, numbered from 0, and the first of each line."""
    data, offsets = raw(pa.array(texts, pa.string()))
    h, lo, hi = _shingles(data, byte_sums(data), powers(len(data) + 1, 0, True), offsets[:-1], offsets[1:])
    count = hi - lo
    line = np.repeat(np.arange(len(texts)), count)
    first = np.cumsum(count) - count
    h = h[np.arange(len(line)) + np.repeat(lo - first, count)]
    h[first[np.diff(offsets) == 0]] = 0  # the shingle of an empty line
    order = np.argsort(h)
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    number = np.cumsum(new) - 1
    all_of = int(number[-1]) + 1
    keys = np.sort(line[order] * all_of + number)  # np.unique would hash them, which takes many times as long
    new[1:] = keys[1:] != keys[:-1]
    line, number = np.divmod(keys[new], all_of)
    return number, np.searchsorted(line, np.arange(len(texts) + 1))


def grouped(texts: list[str], groups: list[int] | None = None) -> list[int]:
    """The first line of the component of each of some distinct lines, under the exact relation inside each group.

    ``groups`` has the size of each group, one after the other; without it all lines are one.
    Groups of two are compared all at once. Others are walked breadth-first: each line reached is
    compared at once with all lines of its group not reached yet, so lines of one dense group cost
    about one comparison each, and no pair is compared twice.
    """
    number, at = _shingle_table(texts)
    size = np.diff(at)
    label = np.arange(len(texts))
    mark = np.zeros(int(number.max()) + 1, np.int32)
    sizes = np.array([len(texts)] if groups is None else groups, np.int64)
    begins = np.cumsum(sizes) - sizes
    two = begins[sizes == 2]
    if len(two):
        pair = np.full(len(texts), -1, np.int64)
        pair[two] = pair[two + 1] = np.arange(len(two))
        of = np.repeat(pair, size)
        keys = np.sort((of * (int(number.max()) + 1) + number)[of >= 0])
        both = np.bincount(keys[1:][keys[1:] == keys[:-1]] // (int(number.max()) + 1), minlength=len(two))
        near = both >= LIKENESS * (size[two] + size[two + 1] - both) - 1e-9
        label[two[near] + 1] = two[near]
    for begin, count in zip(begins[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        left = np.arange(begin, begin + count)
        while len(left):
            seed, left = int(left[0]), left[1:]
            queue, flat = [seed], None
            while queue and len(left):
                if flat is None:  # shingles of the lines not reached, one after the other
                    n = size[left]
                    cut = np.cumsum(n) - n
                    flat = number[np.repeat(at[left] - cut, n) + np.arange(int(n.sum()))]
                v = queue.pop()
                mark[number[at[v] : at[v + 1]]] = 1
                both = np.add.reduceat(mark[flat], cut)
                mark[number[at[v] : at[v + 1]]] = 0
                near = both >= LIKENESS * (size[v] + size[left] - both) - 1e-9
                if near.any():
                    label[left[near]] = seed
                    queue += left[near].tolist()
                    left, flat = left[~near], None
    return label.tolist()


def links(bands: DataFrame, texts: DataFrame) -> DataFrame:
    """``(a, b)`` edges that join the lines of all bands of a leader that are alike, as stars."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, str] = {}
        leader = None
        ids: list[bytes] = []
        lines: list[str] = []
        sizes: list[int] = []

        def close() -> None:
            """The group that has ended joins those that wait to be compared."""
            if len(held) > 1:
                ids.extend(held)
                lines.extend(held.values())
                sizes.append(len(held))
            held.clear()

        def out() -> pa.RecordBatch:
            edges = [(ids[i], ids[g]) for i, g in enumerate(grouped(lines, sizes)) if i != g] if lines else []
            for waiting in (ids, lines, sizes):
                waiting.clear()
            a, b = zip(*edges) if edges else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

        for batch in batches:
            for key, i, text in zip(*(c.to_pylist() for c in batch.columns)):
                if key != leader:
                    close()
                    leader = key
                    if len(lines) >= COMPARED:
                        yield out()
                held[i] = text
        close()
        yield out()

    # near lines share most bands, and these have the same leader: one group instead of up to ten, with no pair of a band left out
    rows = bands.distinct().join(texts, "line").select("leader", "id", "text")
    return map_arrow(rows.repartition("leader").sortWithinPartitions("leader", "id"), verify, "a binary, b binary")


def dedup(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_lines, n_removed, kept)``: lines that are not blank, and the text without those removed."""
    bands = repeated_bands(docs)
    lines = stored(bands.select("line").distinct(), "line-hashes")
    places = placed(docs, lines)
    found = stored(places.where("text is not null").select("line", "id", "text").join(lines, "line", "left_semi").dropDuplicates(["id"]), "line-texts")
    member = components(links(bands, found))

    lowest = F.coalesce("doc_id", F.lit(-(1 << 63)))
    named = places.join(member.withColumnRenamed("node", "id"), "id", "left").select(F.coalesce("component", "id").alias("c"), F.struct(lowest.alias("d"), "row", "pos").alias("at"))
    winners = named.groupBy("c").agg(F.min("at").alias("at"))
    stays = winners.groupBy(F.col("at.row").alias("row")).agg(F.collect_list("at.pos").alias("stays"))  # at most the lines of one document
    rows = _rows(docs).join(stays, "row", "left").select("doc_id", "text", "stays")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for text, keep in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                parts, keep = (text or b"").split(b"\n"), set(keep or ())
                full = [bool(p.strip(SPACE)) for p in parts]
                left = [p for i, p in enumerate(parts) if not full[i] or i in keep]
                for column, value in zip(out, (sum(full), len(parts) - len(left), b"\n".join(left).decode())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["doc_id", "n_lines", "n_removed", "kept"])

    return map_arrow(rows, cut, "doc_id long, n_lines long, n_removed long, kept string")
