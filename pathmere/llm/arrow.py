"""Vectorised helpers that operators run inside Arrow batches on the executors.

Hashes are prefix sums of ``table[byte] * P**i`` modulo 2**64: the hash of any span is one
subtraction and one multiplication, so words, shingles and windows of a whole slice of documents
are hashed without a Python loop. A mixing step removes the algebraic structure.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that are hashed at a time; a longer single text makes a slice of its own.
SLICE_BYTES = 1 << 21
#: The ASCII white space of the word contracts: [\x20\x09-\x0D].
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE)] = True

_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_TABLES = tuple(np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed in (11, 12))
_powers: dict[tuple[int, bool], np.ndarray] = {}


#: Bytes of an Arrow batch that a Python worker is sent.
BATCH_BYTES = 8 << 20


def tidy() -> None:
    """Give freed memory back, so that reused workers do not keep their peak."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def forget() -> None:
    """Drop tables kept between batches; for tasks whose workers go on to other stages."""
    _powers.clear()
    tidy()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed (tests, local runs), in batches of bounded size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH")) if x)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(batches):
            yield out
            del out
            tidy()

    return df.mapInArrow(run, schema)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes."""
    if not len(texts):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, done = 0, 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield start, stop
        start, done = stop, int(ends[stop - 1])


def joined(batches) -> pa.Table:
    return pa.Table.from_batches(batches)


def raw(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = pc.fill_null(texts, b"")
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    base = int(at[0])
    n = int(at[-1]) - base
    return (np.frombuffer(data, np.uint8, n, base) if n else np.empty(0, np.uint8)), at - base


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes marked in ``inside``, and the first run of each text."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    cut = offsets[:-1][np.diff(offsets) > 0]  # first byte of each text that is not empty
    before, following = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], following[:-1] = inside[:-1], inside[1:]
    before[cut] = False
    following[cut[1:] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~following) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def powers(n: int, lane: int = 0, inverse: bool = False) -> np.ndarray:
    """``P**i`` (or its inverse) modulo 2**64 for i below n."""
    known = _powers.get((lane, inverse))
    if known is None or len(known) < n:
        base = int(_MULTIPLIERS[lane])
        base = pow(base, -1, 1 << 64) if inverse else base
        known = np.full(max(n, 1 << 16), base, np.uint64)
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if len(known) <= 1 << 23:
            _powers[lane, inverse] = known
    return known[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3 (public constants)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def prefix_sums(values: np.ndarray, lane: int = 0) -> np.ndarray:
    """Sums of ``values[j] * P**j`` for j below i, for i = 0..n."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), lane), dtype=np.uint64, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(len(sums), lane, True)[starts])


def byte_sums(data: np.ndarray, lane: int = 0) -> np.ndarray:
    return prefix_sums(_TABLES[lane][data], lane)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and the first word of each text."""
    starts, ends, first = spans(data, offsets, ~IS_SPACE[data])
    return span_hashes(byte_sums(data, lane), starts, ends, lane), first


def windows(words: np.ndarray, first: np.ndarray, size: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within one text, and the word each starts at."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    starts = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else first[:-1], counts) + np.arange(counts.sum())
    return span_hashes(prefix_sums(words, lane), starts, starts + size, lane), starts


def shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word shingles of each text (all words if there are fewer), and the first of each text."""
    n = np.diff(first)
    counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    at = np.concatenate(([0], np.cumsum(counts)))
    starts = np.repeat(first[:-1] - at[:-1], counts) + np.arange(at[-1])
    ends = np.minimum(starts + size, np.repeat(first[1:], counts))
    return span_hashes(prefix_sums(words), starts, ends), at


def by_ranges(df: DataFrame, key: Column, bytes_of: Column, target: int = 16 << 20) -> tuple[DataFrame, int]:
    """Add ``_part``, an index of contiguous ranges of a long ``key``, so that parts hold about ``target`` bytes.

    Bounds are quantiles from a mergeable sketch; only these (one long for each part) reach the
    driver. Nulls in ``key`` count as the lowest value. Rows of equal keys share a part.
    """
    keyed = df.withColumn("_key", F.coalesce(key.cast("long"), F.lit(-(1 << 63)).cast("long")))
    total = df.select(F.sum(bytes_of).alias("n")).first()["n"] or 0
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-total // target), min(-(-total // (1 << 18)), cores))
    bounds: list[int] = []
    if parts > 1:
        at = ", ".join(f"{i / parts:.12g}D" for i in range(1, parts))
        bounds = sorted(set(keyed.select(F.expr(f"approx_percentile(_key, array({at}), {max(10_000, 20 * parts)})").alias("q")).first()["q"] or []))
    if not bounds:
        return keyed.withColumn("_part", F.lit(0)), 1
    steps = [1 << s for s in reversed(range(len(bounds).bit_length()))]
    array = f"transform(split('{','.join(map(str, bounds))}', ','), b -> cast(b as bigint))"
    search = f"aggregate(array({', '.join(map(str, steps))}), 0, (lo, s) -> if(coalesce(get({array}, lo + s - 1) < _key, false), lo + s, lo))"
    return keyed.withColumn("_part", F.expr(search).cast("int")), len(bounds) + 1
