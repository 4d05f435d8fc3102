"""Target-distribution importance resampling: documents drawn by how much likelier their word n-grams are in a target corpus.

Words are runs of digits, letters a-z (A-Z are lower-cased) and non-ASCII characters; features are all
runs of one and two words, hashed by CRC-32 into buckets. A bucket's gain is the scaled log ratio of
its share in the target to its share in the corpus, with one added to each count; a document's weight
is the floored mean gain of its features; documents are drawn without replacement by the highest
weight plus seeded Gumbel noise.

Counting deduplicates segments. Newlines, which are separators, cut a text into lines; the two words
around a newline are a segment of their own. Equal segments are combined in each slice of documents
and again in the whole corpus, and only the distinct ones are hashed: their feature counts are
multiplied by their occurrences. A boilerplate line in a third of all documents is one row for each
task in the shuffle. Each task adds up one vector of bucket counts; the driver sees ``buckets`` rows.

Drawing needs no global sort: scores are integers, so a table of counts for each score (bounded by
their range, however many documents there are) tells how many documents precede a score, and only
documents of one score are ordered among themselves.

Defined cases: null and empty texts have no features, weight 0 and are never drawn (they have no
words); a null doc_id takes part as the text ``null`` in the noise and comes last among ties; rows
repeated whole are documents of their own, in any order among themselves; an empty corpus or target
gives counts of zero; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathmere.llm.arrow import map_arrow, raw, slices, spans
from pathmere.llm.graph import stored

BUCKETS, MIN_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Every byte that is not part of a word becomes a blank, A-Z become a-z; newlines stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 or b == 10 else 32 for b in range(256))
_FOLDED = np.frombuffer(_FOLD, np.uint8)
#: Words of more bytes are hashed one at a time.
LONG = 48


def _crc_table() -> np.ndarray:
    """The CRC-32 of each byte, from the reflected polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC register of each span of bytes, begun with ``state``."""
    out = state.copy()
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    first = int(np.searchsorted(-size[order], -LONG))  # spans of LONG bytes or more
    for k in order[:first].tolist():
        out[k] = zlib.crc32(data[starts[k] : ends[k]].tobytes(), int(out[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    order = order[first:]
    at, now, left = starts[order], out[order], size[order]
    for step in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -step, "left"))  # spans of more than ``step`` bytes come first
        now[:n] = _CRC[(now[:n] ^ data[at[:n] + step]) & np.uint32(255)] ^ (now[:n] >> np.uint32(8))
    out[order] = now
    return out


class Features:
    """Buckets of the features of some texts: all words, then all pairs of neighbours in one text."""

    def __init__(self, texts: pa.Array, buckets: int):
        data, offsets = raw(texts)
        data = _FOLDED[data]
        starts, ends, self.first = spans(data, offsets, (data != 32) & (data != 10))
        self.text = np.searchsorted(self.first, np.arange(len(starts)), "right") - 1
        fresh = np.full(len(starts), 0xFFFFFFFF, np.uint32)
        word = crc_of(data, starts, ends, fresh)
        pair = np.flatnonzero(self.text[1:] == self.text[:-1]) if len(starts) else np.zeros(0, np.int64)
        blank = _CRC[(word[pair] ^ np.uint32(32)) & np.uint32(255)] ^ (word[pair] >> np.uint32(8))
        both = crc_of(data, starts[pair + 1], ends[pair + 1], blank)
        bucket = lambda register: ((register ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64)
        self.words, self.pairs, self.pair_text = bucket(word), bucket(both), self.text[pair]


def segments(docs: DataFrame) -> DataFrame:
    """``(segment, across, n)``: distinct lines, and pairs of words across newlines, with their occurrences in each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                lines: Counter[bytes] = Counter()
                across: Counter[bytes] = Counter()
                for text in batch.column(0).slice(lo, hi - lo).cast(pa.binary()).to_pylist():
                    before = None
                    for line in (text or b"").translate(_FOLD).split(b"\n"):
                        words = line.split()
                        if not words:
                            continue
                        lines[b" ".join(words)] += 1
                        if before is not None:
                            across[before + b" " + words[0]] += 1
                        before = words[-1]
                if lines:
                    both = [*lines, *across]
                    n = pa.array([*lines.values(), *across.values()], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(both, pa.binary()), pa.array(np.arange(len(both)) >= len(lines)), n], names=["segment", "across", "n"])

    return map_arrow(docs.select(F.col("text").cast("string").alias("text")), run, "segment binary, across boolean, n long")


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of features in each bucket over all of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                found = Features(batch.column(0).slice(lo, hi - lo), buckets)
                across = batch.column(1).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                n = batch.column(2).slice(lo, hi - lo).to_numpy()
                own = ~across[found.text]  # the words of a pair across a newline were counted with their lines
                np.add.at(total, found.words[own], n[found.text[own]])
                np.add.at(total, found.pairs, n[found.pair_text])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    distinct = segments(docs).groupBy("segment", "across").agg(F.sum("n").alias("n"))
    summed = map_arrow(distinct, run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for row in summed.collect():  # at most ``buckets`` rows
        total[row["bucket"]] = row["n"]
    return total


def gains(corpus: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """Floored, scaled log ratio of the target's share of each bucket to the corpus's, one added to each count."""
    n, m, k = float(corpus.sum()), float(target.sum()), float(len(corpus))
    ratio = lambda s, t: (t + 1.0) * (n + k) / ((s + 1.0) * (m + k))
    return np.array([math.floor(scale * math.log(ratio(float(s), float(t)))) for s, t in zip(corpus, target)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                found = Features(batch.column(1).slice(lo, hi - lo), len(gain))
                total = np.zeros(hi - lo, np.int64)
                np.add.at(total, found.text, gain[found.words])
                np.add.at(total, found.pair_text, gain[found.pairs])
                words = np.diff(found.first)
                n = words + np.maximum(words - 1, 0)
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(words), pa.array(n), pa.array(np.floor_divide(total, np.maximum(n, 1)))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, n_words long, n_features long, weight long")


def drawn(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """Add ``rank`` to stored rows with ``n_words``, ``score`` and ``doc_id``: 1, 2, 3 ... for those drawn."""
    able = F.col("n_words") >= min_words
    held = scored.where(able).groupBy("score").agg(F.count("*").alias("n")).withColumn("range", F.floor(F.col("score") / 256))
    ranges = held.groupBy("range").agg(F.sum("n").alias("in_range"))  # a few hundred rows
    above = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = ranges.select("range", F.coalesce(F.sum("in_range").over(above), F.lit(0)).alias("above"), F.floor(F.sum("in_range").over(whole) * percent / 100).alias("wanted"))
    inside = Window.partitionBy("range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    before = held.join(ranges, "range").select("score", "wanted", (F.col("above") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("before"))
    order = Window.partitionBy("score", "able").orderBy(F.asc_nulls_last("doc_id"))
    placed = scored.withColumn("able", able).join(before, "score", "left").withColumn("place", F.col("before") + F.row_number().over(order))
    return placed.withColumn("rank", F.when(F.col("able") & (F.col("place") <= F.col("wanted")), F.col("place")).cast("long"))


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every document; rank is null for those not drawn."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stored(weights(docs, gain).withColumn("score", (F.col("weight") + noise).cast("long")), "resample-scores")
    return drawn(scored, percent, min_words).select("doc_id", "n_features", "weight", "score", "rank")
