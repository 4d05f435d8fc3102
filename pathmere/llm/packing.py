"""Packing into fixed-length training sequences: first-fit decreasing with a tournament tree.

A document's token ids (its end-of-text id last) are cut into full sequences and one rest; each
full piece is a sequence of its own. Rests are dealt into randomised groups by a hash of the
document, so groups are alike whatever the order, source or length of documents, and each group
is packed by itself: pieces in decreasing length go to the first bin with room, found by going
down a tournament tree whose nodes hold the largest room below them. The number of groups grows
with the pieces, so a group has a bounded number of them whatever the size of the input.

Tokens never pass a shuffle: digests or ids that a caller wants are carried by the pieces.

Defined cases: a null or empty text is the end-of-text id alone; equal and repeated documents are
packed each by itself (pieces of rows that share a doc_id are told apart by ``row``); an empty
table gives an empty result; other columns can be named in ``carry``.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathmere.llm.arrow import map_arrow, raw, ship, slices
from pathmere.llm.graph import stored

#: Tokens in a sequence, pieces in a group on average, chunks of text a task keeps the ids of.
LENGTH, GROUP_PIECES, CACHED = 2048, 4096, 1 << 18
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: ASCII characters that are neither letters nor white space.
_SIGN = np.zeros(256, bool)
_SIGN[33:127] = True
_SIGN[65:91] = _SIGN[97:123] = False


def _byte_letters() -> dict[int, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others follow from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: 256 + i for i, b in enumerate(rest)}


class Encoder:
    """Token ids of texts, by chunk.

    White space is dropped before the vocabulary's own splitting and no token spans it, so a text's
    ids are those of its chunks, which repeat and are remembered. A chunk also ends between a Latin
    letter and an ASCII sign, where the splitting parts them too, and A-Z are folded first, so
    "Word," and "word" share an entry. Chunks of Latin letters alone are one word for the splitting
    and go to the vocabulary's model at once; others go through the whole tokenizer. Added tokens such
    as <|endoftext|> are found in the raw text first, in exact case, as the tokenizer does.
    """

    def __init__(self, path: str, limit: int = CACHED):
        import re

        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.older, self.limit = Tokenizer.from_file(path), {}, {}, limit
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError(f"added tokens of {path} are not found by their plain text")
        self.added = {t.content.encode(): array("I", [i]).tobytes() for i, t in added.items()}
        self.is_added = re.compile(b"|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)))
        self.is_word = re.compile(rb"(?:[a-z]++|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++").fullmatch

    def _word(self, word: bytes) -> bytes:
        text = word.decode().lower()
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def _learn(self, chunks: set[bytes]) -> None:
        known, older, todo = self.known, self.older, []
        for c in chunks:
            if (ids := older.get(c)) is not None:
                known[c] = ids
            elif self.is_word(c):
                known[c] = self._word(c)
            else:
                todo.append(c)
        for c, e in zip(todo, self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in todo], add_special_tokens=False)):
            known[c] = array("I", e.ids).tobytes()

    def rest(self) -> None:
        """Between tasks a worker keeps few words: it may go on to other stages."""
        self.older = {}
        if len(self.known) > self.limit // 8:
            self.known = {}

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        data, offsets = raw(texts)
        text = data.tobytes()
        if not any(x in text for x in self.added):
            return self._encode(data, offsets)
        parts, first, marks, ends = [0], [0], {}, offsets.tolist()
        for a, b in zip(ends, ends[1:]):
            for found in self.is_added.finditer(text, a, b):
                parts.append(found.start())
                marks[len(parts) - 1] = self.added[found[0]]
                parts.append(found.end())
            parts.append(b)
            first.append(len(parts) - 1)
        coded = self._encode(data, np.array(parts))
        for k, ids in marks.items():
            coded[k] = ids
        return [b"".join(coded[a:b]) for a, b in zip(first, first[1:])]

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids of each part of the bytes; added tokens have been cut out."""
        data = _FOLD[data]
        if len(data) > 1:
            letter = (data >= 97) & (data <= 122)
            letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
            cut = np.flatnonzero(letter[:-1] & _SIGN[data[1:]]) + 1
            data = np.insert(data, cut, 32)
            offsets = offsets + np.searchsorted(cut, offsets)
        text, at = data.tobytes(), offsets.tolist()
        chunks = [text[a:b].split() for a, b in zip(at, at[1:])]
        if len(self.known) > self.limit:  # what was used since the last time is kept
            self.known, self.older = {}, self.known
        new = set().union(*chunks).difference(self.known)
        if new:
            self._learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, c)) for c in chunks]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """``(doc_id, row, start, length, ids, doc_tokens)``: the cut documents; ``ids`` is binary, little-endian unsigned 32-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, end = encoder(tokenizer).encode, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = batch.column(2)
            for lo, hi in slices(texts):
                out: list[list] = [[], [], [], [], [], []]
                coded = encode(texts.slice(lo, hi - lo))
                for doc, row, whole in zip(ids[lo:hi], rows[lo:hi], coded):
                    whole += end
                    n = len(whole) // 4
                    for start in range(0, n, length):
                        stop = min(n, start + length)
                        for column, value in zip(out, (doc, row, start, stop - start, whole[4 * start : 4 * stop], n)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()))], names=["doc_id", "row", "start", "length", "ids", "doc_tokens"])
        encoder(tokenizer).rest()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, row long, start long, length long, ids binary, doc_tokens long")


def first_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece."""
    order = np.argsort(-lengths, kind="stable").tolist()
    size = 1
    while size < len(lengths):
        size *= 2
    tree = [room] * (2 * size)  # an unused bin has all its room
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    sizes = lengths.tolist()
    for i in order:
        need, node = sizes[i], 1
        while node < size:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[i], offsets[i] = node - size, room - tree[node]
        tree[node] -= need
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
    return bins, offsets


def pack(pieces: DataFrame, length: int = LENGTH, group_pieces: int = GROUP_PIECES, seed: int = 0) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces ``(doc_id, row, start, length, ...)`` of at most ``length`` tokens.

    Sequence ids are a group and a number within it; full pieces have groups of their own range.
    """
    pieces = stored(pieces, "pieces")  # tokenised once, though counted first
    count = pieces.where(F.col("length") < length).count()
    groups = max(1, -(-count // group_pieces))
    salted = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "row", F.lit(seed)), F.lit(groups)).cast("int"))
    schema = T.StructType([*pieces.schema.fields, T.StructField("_group", T.IntegerType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "row", "start")])
        bins, offsets = first_fit_decreasing(table["length"].to_numpy(), length)
        group = table["_group"][0].as_py()
        return table.append_column("sequence_id", pa.array(bins + (group << 32))).append_column("offset", pa.array(offsets))

    ship(pieces.sparkSession)
    full = salted.where(F.col("length") == length).withColumn("sequence_id", F.monotonically_increasing_id().bitwiseOR(F.lit(1 << 62))).withColumn("offset", F.lit(0).cast("long"))
    rest = salted.where(F.col("length") < length).repartitionById(groups, "_group").groupBy("_group").applyInArrow(one, schema)
    return full.unionByName(rest).drop("_group")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """Pieces with their token ids and their place in a sequence."""
    return pack(token_pieces(docs, tokenizer, end_id, length), length)


def digests(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """As :func:`pack_documents`, with a CRC-32 of the ids in place of the ids."""
    pieces = token_pieces(docs, tokenizer, end_id, length).select("doc_id", "row", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(pieces, length).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "row")
