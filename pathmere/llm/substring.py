"""Substring dedup: every window of 20 words that also starts earlier loses its words.

Documents are dealt into parts, contiguous ranges of doc_id, so an earlier part holds earlier
windows. Three steps exchange compact messages between parts and blocks of hash space, while the
texts are dealt out once:

1. *Sketch.* Each part fills a count-min sketch whose width grows with the corpus and sends its
   non-empty cells, sorted and delta-coded, to the blocks of cells. Counters saturate at two: a
   block merges the sketches by counting the parts of each cell (a part knows itself which cells it
   fills twice) and answers each part with one bit for each cell it sent.
2. *Exact pass.* Windows whose cells are full in every row are estimated repeated; an
   overestimate loses none. Each part sends their distinct 128-bit hashes to blocks, which group
   them exactly and answer with one bit: does an earlier part hold this window?
3. *Removal.* A window goes if an earlier part holds it, or if it is not its first in the part.

A window in a third of all documents costs a part one entry, however often it occurs there. Two
windows are held equal if two independent mixed 64-bit hashes agree (for 10**13 windows the
chance of any error is under 10**-12).

Defined cases: a null text has no words; documents under 20 words are unchanged; a null doc_id is the
earliest; rows that share a doc_id are ordered by text, then arbitrarily, as one document after
the other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathmere.llm.arrow import by_ranges, mix, raw, ship, slices, tidy, windows, word_hashes

WINDOW, ROWS = 20, 2
#: Cells or windows that a block gathers, on average; bytes of text in a part.
BLOCK_ITEMS, PART_BYTES = 1 << 20, 16 << 20
_SALTS = (np.uint64(0x8F1BBCDCCA62C1D6), np.uint64(0x5A827999A953FD4E))
_ESCAPE = 0xFFFF


def _packed(values: np.ndarray) -> bytes:
    """Increasing non-negative integers as compressed 16-bit gaps; a gap code of 65535 adds to the next."""
    gaps = np.diff(values, prepend=0)
    more = gaps // _ESCAPE
    codes = np.full(len(values) + int(more.sum()), _ESCAPE, "<u2")
    codes[np.cumsum(more + 1) - 1] = gaps % _ESCAPE
    planes = codes.view(np.uint8).reshape(-1, 2).T.tobytes()
    return len(codes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 2 * n, "zstd", asbytes=True), np.uint8)
    codes = np.ascontiguousarray(planes.reshape(2, n).T).view("<u2").ravel().astype(np.int64)
    return np.cumsum(codes)[codes != _ESCAPE]


def _bits(flags: np.ndarray) -> bytes:
    return len(flags).to_bytes(8, "little") + pa.compress(np.packbits(flags).tobytes(), "zstd", asbytes=True)


def _flags(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.unpackbits(np.frombuffer(pa.decompress(data[8:], (n + 7) // 8, "zstd", asbytes=True), np.uint8), count=n).astype(bool)


class Part:
    """Texts of a part in order, and the hashes and first words of all their windows."""

    def __init__(self, table: pa.Table, window: int, lanes: int):
        table = table.take(pa.compute.sort_indices(table, sort_keys=[("_key", "ascending"), ("text", "ascending")]))
        self.ids, self.texts = table["doc_id"], table["text"].combine_chunks()
        if isinstance(self.texts, pa.ChunkedArray):
            self.texts = pa.concat_arrays(self.texts.chunks) if self.texts.num_chunks else pa.array([], pa.string())
        hashes: list[list[np.ndarray]] = [[] for _ in range(lanes)]
        starts, firsts, base = [], [np.zeros(1, np.int64)], 0
        for lo, hi in slices(self.texts):
            data, offsets = raw(self.texts.slice(lo, hi - lo))
            for lane in range(lanes):
                words, first = word_hashes(data, offsets, lane)
                h, start = windows(words, first, window, lane)
                hashes[lane].append(h)
            starts.append(start + base)
            firsts.append(first[1:] + base)
            base += int(first[-1])
        self.hashes = [np.concatenate([np.empty(0, np.uint64), *h]) for h in hashes]
        self.starts = np.concatenate([np.empty(0, np.int64), *starts])
        self.first = np.concatenate(firsts)  # first word of each text, then the end


def _cells(h: np.ndarray, row: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct cells of a row of the sketch in order, the cell of each window and the windows in each."""
    return np.unique((mix(h ^ _SALTS[row]) >> np.uint64(64 - bits)).astype(np.int64), return_inverse=True, return_counts=True)


def _batch(schema: tuple[str, ...], rows: list[tuple], kinds: tuple[pa.DataType, ...]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.table({n: pa.array(c, k) for n, c, k in zip(schema, columns, kinds)})


_MESSAGE = ("block", "part", "payload"), (pa.int64(), pa.int32(), pa.binary())
_ANSWER = ("part", "block", "payload"), (pa.int32(), pa.int64(), pa.binary())
_MESSAGE_DDL, _ANSWER_DDL = "block long, part int, payload binary", "part int, block long, payload binary"


def dedup(docs: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES, block_items: int = BLOCK_ITEMS, cell_bits: int | None = None) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``: ``kept`` joins the words that stay by one space."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = F.length("text").cast("long")
    total = rows.select(F.sum(size).alias("n")).first()["n"] or 0
    rows, parts = by_ranges(rows, F.col("doc_id"), size, part_bytes)
    texts = rows.select("_part", "_key", "doc_id", "text").repartitionById(parts, "_part")
    bits = cell_bits or max(10, int(total).bit_length())  # a text has about six characters for each window: six to twelve cells
    blocks = 1 << max(0, (total // 6 // block_items).bit_length())
    block_bits = blocks.bit_length() - 1
    low = bits - block_bits

    def sketch(table: pa.Table) -> pa.Table:
        tidy()
        part, out = table["_part"][0].as_py(), []
        h = Part(table, window, 1).hashes[0]
        for row in range(ROWS):
            cells = _cells(h, row, bits)[0]
            cut = np.searchsorted(cells, np.arange(blocks + 1) << low)
            out += [(row * blocks + b, part, _packed(cells[cut[b] : cut[b + 1]] - (b << low))) for b in range(blocks) if cut[b] < cut[b + 1]]
        return _batch(_MESSAGE[0], out, _MESSAGE[1])

    def merge(table: pa.Table) -> pa.Table:
        """Of the cells that each part has sent, those that two parts have."""
        tidy()
        block = table["block"][0].as_py()
        sent = [_unpacked(x) for x in table["payload"].to_pylist()]
        seen = np.zeros(1 << low, np.uint8)
        for cells in sent:
            seen[cells] = np.minimum(seen[cells] + 1, 2)
        return _batch(_ANSWER[0], [(p, block, _bits(seen[c] > 1)) for p, c in zip(table["part"].to_pylist(), sent)], _ANSWER[1])

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        tidy()
        if not left.num_rows:
            return _batch(_MESSAGE[0], [], _MESSAGE[1])
        part, own = left["_part"][0].as_py(), Part(left, window, 2)
        h, g = own.hashes
        told = dict(zip(right["block"].to_pylist(), right["payload"].to_pylist()))
        repeated = np.ones(len(h), bool)
        for row in range(ROWS):
            cells, of, counts = _cells(h, row, bits)
            full = np.concatenate([np.empty(0, bool), *(_flags(told[b]) for b in sorted(told) if b // blocks == row)])
            repeated &= (full | (counts > 1))[of]
        keys = _distinct(h[repeated], g[repeated])[0]
        cut = np.searchsorted(keys[:, 0] >> np.uint64(64 - block_bits), np.arange(blocks + 1, dtype=np.uint64)) if block_bits else np.array([0, len(keys)])
        out = [(b, part, keys[cut[b] : cut[b + 1]].T.tobytes()) for b in range(blocks) if cut[b] < cut[b + 1]]
        return _batch(_MESSAGE[0], [(-1 - part, part, _bits(repeated)), *out], _MESSAGE[1])

    def first(table: pa.Table) -> pa.Table:
        """Of the windows that each part has sent, those that an earlier part has; a part's own marks pass through."""
        block = table["block"][0].as_py()
        if block < 0:
            return table.select(_ANSWER[0])
        table = table.sort_by("part")
        sent = [np.frombuffer(x, np.uint64).reshape(2, -1) for x in table["payload"].to_pylist()]
        h, g = np.concatenate([s[0] for s in sent]), np.concatenate([s[1] for s in sent])
        order = np.lexsort((np.arange(len(h)), g, h))
        again = np.zeros(len(h), bool)
        again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (g[order[1:]] == g[order[:-1]])
        cut = np.cumsum([0, *(s.shape[1] for s in sent)])
        return _batch(_ANSWER[0], [(p, block, _bits(again[cut[i] : cut[i + 1]])) for i, p in enumerate(table["part"].to_pylist())], _ANSWER[1])

    def removed(left: pa.Table, right: pa.Table) -> pa.Table:
        tidy()
        out: list[tuple] = []
        if left.num_rows:
            own = Part(left, window, 2)
            told = dict(zip(right["block"].to_pylist(), right["payload"].to_pylist()))
            marks = next(v for k, v in told.items() if k < 0)
            at = np.flatnonzero(_flags(marks))
            keys, of, earliest = _distinct(own.hashes[0][at], own.hashes[1][at])
            earlier = np.concatenate([np.empty(0, bool), *(_flags(told[b]) for b in sorted(told) if b >= 0)])
            gone = own.starts[at[earlier[of] | (earliest[of] != np.arange(len(at)))]]
            edge = np.zeros(int(own.first[-1]) + 1, np.int32)
            np.add.at(edge, gone, 1)
            np.add.at(edge, gone + window, -1)
            stays = np.cumsum(edge[:-1]) == 0
            for i, (doc, text) in enumerate(zip(own.ids.to_pylist(), own.texts.cast(pa.binary()).to_pylist())):
                keep = stays[own.first[i] : own.first[i + 1]]
                words, n = text.split(), int(keep.sum())
                out.append((doc, len(words), len(words) - n, (b" ".join(words) if n == len(words) else b" ".join(compress(words, keep.tolist()))).decode()))
        return _batch(("doc_id", "n_words", "n_removed", "kept"), out, (pa.int64(), pa.int64(), pa.int64(), pa.string()))

    sketches = texts.groupBy("_part").applyInArrow(sketch, _MESSAGE_DDL)
    merged = sketches.groupBy("block").applyInArrow(merge, _ANSWER_DDL)
    route = lambda answers: answers.repartitionById(parts, "part").groupBy("part")
    found = texts.groupBy("_part").cogroup(route(merged)).applyInArrow(candidates, _MESSAGE_DDL)
    grouped = found.groupBy("block").applyInArrow(first, _ANSWER_DDL)
    return texts.groupBy("_part").cogroup(route(grouped)).applyInArrow(removed, "doc_id long, n_words long, n_removed long, kept string")


def _distinct(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, the pair of each item, and the first item of each pair."""
    order = np.lexsort((np.arange(len(h)), g, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (g[order[1:]] != g[order[:-1]])
    of = np.empty(len(h), np.int64)
    of[order] = np.cumsum(new) - 1
    return np.stack([h[order][new], g[order][new]], axis=1) if len(h) else np.empty((0, 2), np.uint64), of, order[new]


