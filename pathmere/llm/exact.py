"""Exact dedup by distributed MSD radix partitioning; equality is decided on bytes, never on digests.

The digit of a level is the next block of bytes of the normalised text (white space deleted), and
blocks double in width, so a text of n bytes has about log2(n) levels.

1. *Combine.* Each slice of an Arrow batch is split by successive digits until groups are singletons or their
   texts have ended. One row for each distinct text of a slice goes on, with its members beside
   it, so a text that a third of all rows share costs one copy for each slice.
2. *Partition.* These rows are dealt out by their first digits. A node that holds too many bytes
   is split by more bytes until it is small or its texts have ended; ended nodes need no text any
   more and are summed up by ordinary aggregation.
3. *Recurse.* Each small node is split in memory as in step 1.

Defined cases: a null text counts as empty; equal texts keep the row with most code points, then
the smallest doc_id (null last), then the first slice; rows that are repeated whole count as
separate rows of which one is kept; an empty table gives an empty result; columns other than the
id and the text are carried inside one struct, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathmere.llm.arrow import SPACE, map_arrow, slices
from pathmere.llm.graph import stored

#: Bytes of the first digit, and bytes of text that one node may hold in a task.
DIGIT, NODE_BYTES = 16, 8 << 20
#: Bytes of text that are combined at a time.
COMBINE_BYTES = 8 << 20
_NO_ID = (1 << 63) - 1


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, SPACE)


def radix_groups(texts: list[bytes], width: int = 8) -> list[list[int]]:
    """Positions of equal texts: split by successive digits until a group is a singleton or ended."""
    done, live, at = [], [list(range(len(texts)))], 0
    while live:
        split = []
        for group in live:
            if len(group) == 1:
                done.append(group)
                continue
            digits: dict[bytes, list[int]] = {}
            for i in group:
                digits.setdefault(texts[i][at : at + width], []).append(i)
            for digit, members in digits.items():
                (done if len(members) == 1 or len(digit) < width else split).append(members)
        live, at, width = split, at + width, width * 2
    return done


def combined(docs: DataFrame) -> DataFrame:
    """One stored row for each distinct text of a slice: the row that would stay, and all members."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    member = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType())])
    schema = T.StructType([
        T.StructField("local", T.LongType()), T.StructField("row", rows.schema["row"].dataType), T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()), T.StructField("n_bytes", T.LongType()),
        T.StructField("digit", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("members", T.ArrayType(member)),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for whole in batches:
            for lo, hi in slices(whole.column(2), COMBINE_BYTES):
                batch = whole.slice(lo, hi - lo)
                ids, texts = batch.column(1).to_pylist(), [x or "" for x in batch.column(2).to_pylist()]
                norm = [normalised(x) for x in texts]
                out: dict[str, list] = {k: [] for k in ("pick", "n_chars", "n_bytes", "digit", "size", "members")}
                for group in radix_groups(norm):
                    best = min(group, key=lambda i: (-len(texts[i]), _NO_ID if ids[i] is None else ids[i], i))
                    group.remove(best)  # the row that may stay is the first member
                    for k, v in zip(out, (best, len(texts[best]), len(norm[best]), norm[best][:DIGIT], len(group) + 1, [{"doc_id": ids[i], "n_chars": len(texts[i])} for i in (best, *group)])):
                        out[k].append(v)
                pick = pa.array(out["pick"], pa.int64())
                n = len(pick)
                columns = [
                    pa.array(range(at, at + n), pa.int64()), batch.column(0).take(pick), batch.column(1).take(pick),
                    pa.array(out["n_chars"], pa.int64()), pa.array(out["n_bytes"], pa.int64()), pa.array(out["digit"], pa.binary()),
                    pa.array(out["size"], pa.int64()), pa.array(out["members"], pa.list_(pa.struct([("doc_id", pa.int64()), ("n_chars", pa.int64())]))),
                ]
                at += n
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return stored(map_arrow(rows, run, schema), "exact-combined")


def _recursed(nodes: DataFrame) -> DataFrame:
    """Split the texts of whole nodes; rows arrive sorted by node, and one node is held at a time."""

    def flush(rows: list[tuple]) -> Iterable[tuple]:
        norm = [normalised(r[1]) for r in rows]
        for group in radix_groups(norm):
            keep = min(group, key=lambda i: (-rows[i][3], _NO_ID if rows[i][2] is None else rows[i][2], rows[i][0]))
            size, digest = sum(rows[i][4] for i in group), hashlib.sha256(norm[keep]).hexdigest()
            for i in group:
                yield rows[i][0], rows[keep][2], size, digest, i == keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        node, volume = None, 0
        for batch in batches:
            out: list[tuple] = []
            for key, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if key != node and volume > (NODE_BYTES >> 3):
                    out.extend(flush(held))
                    held, volume = [], 0
                node = key
                held.append(tuple(row))
                volume += len(row[1] or "")
            if out:
                yield _table(out)
        yield _table(list(flush(held)))

    chosen = nodes.select("node", "local", "text", "doc_id", "n_chars", "size").repartition("node").sortWithinPartitions("node")
    return map_arrow(chosen, run, "local long, keep_id long, group_size long, text_sha256 string, winner boolean")


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["local", "keep_id", "group_size", "text_sha256", "winner"])


def decisions(groups: DataFrame, node_bytes: int = NODE_BYTES) -> DataFrame:
    """``(local, keep_id, group_size, text_sha256, winner)`` for every row of :func:`combined`."""
    whole = groups.select("local", "doc_id", F.col("row.text").alias("text"), "n_chars", "n_bytes", "size", F.col("digit").alias("node"), F.lit(True).alias("deep"))
    norm = F.encode(F.translate(F.coalesce("text", F.lit("")), SPACE.decode(), ""), "UTF-8")
    depth = DIGIT
    while True:
        # rows that went as deep as this; only their nodes can be too heavy
        sums = whole.where("deep").groupBy("node").agg(F.sum("n_bytes").alias("b"), F.max("n_bytes").alias("longest"))
        heavy = stored(sums.where((F.col("b") > node_bytes) & (F.col("longest") > depth)).select("node", F.lit(True).alias("heavy")), "exact-heavy")
        if heavy.isEmpty():
            break
        depth *= 4
        split = F.col("deep") & F.coalesce("heavy", F.lit(False))
        whole = whole.join(heavy, "node", "left").select(
            "local", "doc_id", "text", "n_chars", "n_bytes", "size", F.when(split, F.substring(norm, 1, depth)).otherwise(F.col("node")).alias("node"), split.alias("deep")
        )
    # a node shorter than its texts needs them; an ended one is the text itself
    ended = F.col("n_bytes") == F.length("node")
    open_nodes = _recursed(whole.where(~ended))
    closed = whole.where(ended).select("node", "local", "doc_id", "n_chars", "size")
    order = F.struct((-F.col("n_chars")).alias("n"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("d"), F.col("local").alias("l"))
    best = closed.groupBy("node").agg(F.min(order).alias("best"), F.sum("size").alias("group_size"), F.sha2(F.col("node"), 256).alias("text_sha256"))
    closed = closed.select("node", "local").join(best, "node").select(
        "local", F.nullif("best.d", F.lit(_NO_ID)).alias("keep_id"), "group_size", "text_sha256", (F.col("local") == F.col("best.l")).alias("winner")
    )
    return open_nodes.unionByName(closed)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    groups = combined(docs.select("doc_id", "text"))
    members = groups.select("local", F.posexplode("members").alias("i", "m"))
    return members.join(decisions(groups), "local").select(
        F.col("m.doc_id").alias("doc_id"), "keep_id", "group_size", (F.col("winner") & (F.col("i") == 0)).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    groups = combined(docs)
    winners = decisions(groups).where("winner").select("local")
    return groups.select("local", "row").join(winners, "local", "left_semi").select("row.*")
