"""Document fingerprints: bottom-k sketches of shingle hashes.

The sketch of a text is the k least 63-bit hashes of its distinct five-word shingles (a shorter
text is one shingle, a text without words has an empty sketch), ascending. Sketches of parts merge
by keeping the k least of their union, so a source, a day or the whole corpus has one too. They
estimate resemblance, containment and the number of distinct shingles.

Defined cases: a null text counts as empty; two empty sketches resemble each other fully; equal
texts have equal sketches; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathmere.llm.arrow import by_ranges, map_arrow, raw, ship, shingles, slices, tidy, word_hashes

K, SHINGLE = 128, 5
#: Ranges whose first documents are looked up by a broadcast of 16 bytes each.
BROADCAST_PARTS = 100_000


def sketches(texts: pa.Array, k: int = K, size: int = SHINGLE) -> list[np.ndarray]:
    out = []
    for lo, hi in slices(texts):
        words, first = word_hashes(*raw(texts.slice(lo, hi - lo)))
        hashes, at = shingles(words, first, size)
        hashes = (hashes >> np.uint64(1)).astype(np.int64)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            own = hashes[a:b]
            if b - a > 64 * k:  # the least hashes only, but enough of them to be k distinct ones
                least = np.unique(np.partition(own, 8 * k)[: 8 * k])
                own = least if len(least) >= k else own
            out.append(np.unique(own)[:k])
    return out


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness of the shingle sets of two sketches."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:k]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum() / len(union))


def text_of(sketch: np.ndarray) -> str:
    """Big-endian 64-bit hashes in base 64."""
    return base64.b64encode(sketch.astype(">i8").tobytes()).decode()


def fingerprint(docs: DataFrame, k: int = K, size: int = SHINGLE) -> DataFrame:
    """``(doc_id, sketch array<long>)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sketches(batch.column(1), k, size), pa.list_(pa.int64()))], names=["doc_id", "sketch"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, sketch array<long>")


def merged(parts: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """One sketch for each key from the sketches of its parts: distinct hashes, k least, cut before the shuffle."""
    hashes = parts.select(*keys, F.explode_outer("sketch").alias("h"))
    partial = hashes.groupBy(*keys, "h").agg(F.lit(1).alias("one"))
    ranked = partial.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("h").asc_nulls_last()))).where(F.col("r") <= k)
    return ranked.groupBy(*keys).agg(F.array_sort(F.collect_list("h")).alias("sketch"))  # at most k values


def likeness(a: Column, b: Column, k: int = K) -> Column:
    """Resemblance of two sketch columns, in the JVM."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Exact under k, else (k - 1) over the k-th least hash as a share of hash space."""
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) * float(1 << 63) / F.element_at(sketch, -1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of a that b has too: |A and B| from resemblance and both sizes."""
    j, na, nb = likeness(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(na == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (na + nb) / (1 + j) / na))


def against_edits(docs: DataFrame, k: int = K, size: int = SHINGLE) -> DataFrame:
    """Fingerprints of all texts, of edited texts, and their likeness to the edit and to the next document.

    The edit replaces the last half of the code points by the beginning of the next document in
    descending doc_id order (the first after the last). Texts are dealt out once, as ranges of
    doc_id; each range gets the first document of the next one as a guest. Rows that share a
    doc_id follow each other by text; null doc_ids come last.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows, parts = by_ranges(rows, F.col("doc_id"), F.length("text").cast("long"))
    rows = rows.select("_part", "_key", "doc_id", "text")
    # the largest id below each range; the lowest range gets the largest of all. One row for each range.
    tops = rows.groupBy("_part").agg(F.max("_key").alias("top"))
    lowest = tops.agg(F.min("_part").alias("host"), F.max("top").alias("top"))
    guests = tops.withColumn("host", F.lead("_part").over(Window.partitionBy(F.lit(0)).orderBy("_part")))
    guests = guests.where("host is not null").select("host", "top").unionByName(lowest)
    # one row for each range: sent to all tasks while that is a few megabytes, else joined by key
    guests = F.broadcast(guests) if parts <= BROADCAST_PARTS else guests
    guests = rows.join(guests, F.col("_key") == F.col("top")).select(F.col("host").alias("part"), F.col("text").alias("guest"))
    guests = guests.groupBy("part").agg(F.min("guest").alias("guest"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tidy()
        left = left.take(pa.compute.sort_indices(left, sort_keys=[("_key", "descending"), ("text", "ascending")]))
        texts, guest = left["text"].to_pylist(), right["guest"][0].as_py() if right.num_rows else ""
        following = [*texts[1:], guest]
        edits = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, following)]
        of = lambda x: sketches(pa.array(x, pa.string()), k, size)
        own, edited = of([*texts, guest]), of(edits)
        columns = {
            "doc_id": left["doc_id"], "n_chars": pa.array(list(map(len, texts)), pa.int64()),
            "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edits],
            "fingerprint": list(map(text_of, own[:-1])), "edited_fingerprint": list(map(text_of, edited)),
            "near_edited": [resemblance(a, b, k) for a, b in zip(own, edited)],
            "near_next": [resemblance(a, b, k) for a, b in zip(own, own[1:])],
        }
        return pa.table(columns)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.repartitionById(parts, "_part").groupBy("_part").cogroup(guests.repartitionById(parts, "part").groupBy("part")).applyInArrow(run, schema)


