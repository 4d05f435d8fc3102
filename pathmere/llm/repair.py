"""Conversation structure repair: the cheapest edits after which roles alternate, and of these the least in letters.

A conversation must read ``(s?(ua)+)?`` by the initials of its roles. Each turn is kept, given another
role (user or assistant) or deleted; empty turns can be inserted. Blank and repeated turns must go,
and a turn that breaks off costs more when it stays.

The optimum is the least path in a DAG of (turn, automaton state), walked from the last turn. A path's
weight is one integer: its high digits are the cost, and its low digits, of fixed width, hold one
letter of the edits at each position, in ASCII order from one upwards, with zeros behind the last. So
an ordinary minimum of integers compares cost first and then the letters, a prefix before its
extensions. An edge adds its cost and moves the letters one position behind its own. The width is
bounded because deleting all turns is always possible: inserts beyond its cost cannot be optimal.

Spark deals rows by conversation once for the diagnosis (windows; running, so they spill) and once for
the application of edits (a sorted stream). Only two letters a turn are gathered, as long as the
audit that the result holds anyway; texts are streamed, never gathered.

Defined cases: turns are ordered by turn (nulls first), then role and text; a null role or text is one
blank; a null conv_id is a conversation; equal rows of one turn are repeats; a conversation without
rows has an empty repair; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathmere.llm.arrow import map_arrow


class Costs(NamedTuple):
    """Costs of the edits; all but ``keep`` must be positive, so that no cycle of inserts is free."""

    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


COSTS = Costs()
#: Delete, insert, keep, rerole: letters in ASCII order have the digits 1 to 4; 0 is the padding.
LETTERS, BITS = "DIKR", 3
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: Moves of the automaton of ``(s?(ua)+)?``; it accepts in ``_START`` and ``_ASSISTANT``.
_MOVES = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_ASSISTANT, "u"): _USER, (_USER, "a"): _ASSISTANT}
BLANK, DUPLICATE, TRUNCATED, SOUND = "BDT-"
_SPACE = r"[\x20\x09-\x0D]"


def cheapest(turns: str, costs: Costs = COSTS) -> tuple[int, str]:
    """Cost and letters of the best edits of ``turns``: two characters for each, initial of the role and fault."""
    return _short(turns, costs) if len(turns) <= 64 else _cheapest(turns, costs)


def _cheapest(turns: str, costs: Costs) -> tuple[int, str]:
    n = len(turns) // 2
    width = BITS * (n + n * costs.delete // costs.insert + 2)
    low = (1 << width) - 1
    digit = {letter: (k + 1) << (width - BITS) for k, letter in enumerate(LETTERS)}
    never = (n + 2) * (costs.keep + costs.rerole + costs.delete + costs.insert + costs.truncated + 1) << width

    def after(letter: str, cost: int, rest: int) -> int:
        """Weight of a path that begins with one more edit."""
        return ((rest >> width) + cost << width) + digit[letter] + ((rest & low) >> BITS)

    def with_inserts(best: list[int]) -> list[int]:
        for _ in range(3):  # a path without cycles passes at most three inserts
            best = [min([best[q], *(after("I", costs.insert, best[to]) for (at, x), to in _MOVES.items() if at == q and x != "s")]) for q in range(4)]
        return best

    best = with_inserts([0, never, never, 0])
    for k in range(n - 1, -1, -1):
        initial, fault = turns[2 * k], turns[2 * k + 1]
        more = costs.truncated if fault == TRUNCATED else 0
        step = []
        for q in range(4):
            ways = [after("D", costs.delete, best[q])]
            if fault not in (BLANK, DUPLICATE):
                if (q, initial) in _MOVES:
                    ways.append(after("K", costs.keep + more, best[_MOVES[q, initial]]))
                ways += [after("R", costs.rerole + more, best[to]) for (at, x), to in _MOVES.items() if at == q and x != "s"]
            step.append(min(ways))
        best = with_inserts(step)
    found, letters = best[_START], []
    for at in range(width - BITS, -1, -BITS):
        if not (d := found >> at & (1 << BITS) - 1):
            break
        letters.append(LETTERS[d - 1])
    return found >> width, "".join(letters)


_short = lru_cache(maxsize=1 << 15)(_cheapest)


def sound_rows(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, gone)`` with blanks for null roles and texts."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), filled("role"), filled("text"), F.lit(False).alias("gone"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with seeded damage: of twenty parts one is dropped (``gone`` stays as a mark), one emptied, one
    stripped of sentence ends, one repeated and one given to the user."""
    rows = sound_rows(conversations)
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("part", F.crc32(key) % 20)
    text = F.when(F.col("part") == 1, F.lit("")).when(F.col("part") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("part") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("part") == 3, 2).otherwise(1)))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("part") == 0).alias("gone"), times.alias("copy"))
    return out.drop("copy")


def placed(rows: DataFrame) -> DataFrame:
    """Add ``seq`` (0, 1, 2 ... in order), ``fault``, ``illegal`` (with the turn before) and ``fresh`` (a turn number not seen yet) to rows; those gone come last."""
    order = [F.asc_nulls_first("turn"), "role", "text"]
    rows = rows.repartition("conv_id")
    own = Window.partitionBy("conv_id").orderBy("gone", *order)
    rows = rows.withColumn("seq", F.row_number().over(own) - 1)
    same = Window.partitionBy("conv_id", "gone", "role", "text").orderBy("seq")
    own = Window.partitionBy("conv_id").orderBy("seq")
    rows = rows.withColumn("again", F.row_number().over(same) > 1)
    end = F.right(F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     ")), F.lit(1))
    fault = F.when(end == "", BLANK).when(F.col("again"), DUPLICATE).when(end.isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    before = F.lag(F.left("role", F.lit(1))).over(own)
    illegal = before.isNotNull() & ~F.concat(before, F.left("role", F.lit(1))).isin("su", "ua", "au")
    fresh = F.col("turn").isNotNull() & ~F.lag("turn").over(own).eqNullSafe(F.col("turn"))
    there = ~F.col("gone")
    return rows.select("conv_id", "turn", "role", "text", "gone", "seq", fault.alias("fault"), (illegal & there).alias("illegal"), (fresh & there).alias("fresh"))


def reports(rows: DataFrame, costs: Costs = COSTS) -> DataFrame:
    """One row for each conversation of ``placed`` rows: gaps, faults, illegal neighbours, cost and audit."""
    there = ~F.col("gone")
    turn = F.when(there, F.col("turn"))
    count = lambda c: F.sum(F.when(there & c, 1).otherwise(0)).alias
    first = F.rpad(F.left("role", F.lit(1)), 1, " ")
    code = F.when(there, F.struct("seq", F.concat(F.when(first.isin("s", "u", "a"), first).otherwise("-"), "fault").alias("code")))
    found = rows.groupBy("conv_id").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.sum(F.col("fresh").cast("long")), F.lit(0)).cast("long").alias("gaps"),
        count(F.col("fault") == BLANK)("blank"), count(F.col("fault") == DUPLICATE)("duplicate"), count(F.col("fault") == TRUNCATED)("truncated"),
        count(F.col("illegal"))("illegal"),
        F.array_join(F.transform(F.array_sort(F.collect_list(code)), lambda c: c["code"]), "").alias("turns"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cost, audit = zip(*(cheapest(t, costs) for t in batch.column("turns").to_pylist())) if len(batch) else ((), ())
            columns = [c for n, c in zip(batch.schema.names, batch.columns) if n != "turns"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cost, pa.int64()), pa.array(audit, pa.string())], names=[*batch.schema.names[:-1], "cost", "audit"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    return map_arrow(found, run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def repaired(rows: DataFrame, report: DataFrame) -> DataFrame:
    """``(conv_id, pos, edit, role, text, audit...)``: the report of each conversation (pos -1), then its repaired turns in order.

    A sorted stream: the audit of a conversation comes first, then its turns, each met by its letters.
    """
    names = [c for c in report.columns if c != "conv_id"]
    kind = rows.schema["conv_id"].dataType.simpleString()
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    heads = report.select("conv_id", F.lit(-1).cast("long").alias("seq"), none("role", "string"), none("text", "string"), F.struct(*names).alias("facts"))
    turns = rows.where("not gone").select("conv_id", F.col("seq").cast("long").alias("seq"), "role", "text", F.lit(None).cast(heads.schema["facts"].dataType).alias("facts"))
    stream = heads.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state = "", 0, _START
        for batch in batches:
            out: list[tuple] = []  # position of the input row, pos, edit, role, text

            def inserts(row: int) -> None:
                nonlocal at, state
                while at < len(audit) and audit[at] == "I":
                    x = "a" if state == _USER else "u"
                    out.append((row, at, "I", "assistant" if x == "a" else "user", ""))
                    at, state = at + 1, _MOVES[state, x]

            audits = batch.column(4).field("audit").to_pylist()
            for row, (seq, role, text, given) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), audits)):
                if seq < 0:
                    audit, at, state = given, 0, _START
                    out.append((row, -1, None, None, None))
                    inserts(row)
                    continue
                letter = audit[at]
                if letter != "D":
                    x = role[:1] if letter == "K" else "a" if state == _USER else "u"
                    out.append((row, at, letter, role if letter == "K" else "assistant" if x == "a" else "user", text))
                    state = _MOVES[state, x]
                at += 1
                inserts(row)
            source, pos, edit, role, text = zip(*out) if out else ((),) * 5
            take = pa.array(source, pa.int64())
            facts = batch.column(4).take(pc.if_else(pa.array([p < 0 for p in pos], pa.bool_()), take, pa.scalar(None, pa.int64())))
            columns = [batch.column(0).take(take), pa.array(pos, pa.int64()), pa.array(edit, pa.string()), pa.array(role, pa.string()), pa.array(text, pa.string()), facts]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "pos", "edit", "role", "text", "facts"])

    return map_arrow(stream, run, f"conv_id {kind}, pos long, edit string, role string, text string, facts {heads.schema['facts'].dataType.simpleString()}")


def digests(turns: DataFrame) -> DataFrame:
    """The report of each conversation of ``repaired`` turns and the SHA-256 of its lines ``role:text``, hashed as they stream by."""
    kind, facts = turns.schema["conv_id"].dataType.simpleString(), turns.schema["facts"].dataType
    schema = f"conv_id {kind}, facts {facts.simpleString()}, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = h = None
        mark = ""
        for batch in batches:
            ended, hashes = [], []
            for row, (pos, role, text) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 3, 4)))):
                if pos >= 0:
                    h.update(f"{mark}{role}:{text}".encode())
                    mark = "\n"
                    continue
                if waiting is not None:
                    ended.append(waiting)
                    hashes.append(h.hexdigest())
                waiting, h, mark = batch.slice(row, 1), hashlib.sha256(), ""
            if ended:
                yield closed(ended, hashes)
        if waiting is not None:
            yield closed([waiting], [h.hexdigest()])

    def closed(heads: list[pa.RecordBatch], hashes: list[str]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(heads).combine_chunks()
        columns = [rows[name].combine_chunks() for name in ("conv_id", "facts")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(hashes, pa.string())], names=["conv_id", "facts", "repaired_sha256"])

    return map_arrow(turns, run, schema).select("conv_id", "facts.*", "repaired_sha256")


def repair(rows: DataFrame, costs: Costs = COSTS) -> DataFrame:
    """Repaired turns of conversations as given by ``sound_rows`` or ``damaged``, with their reports."""
    found = placed(rows)
    return repaired(found, reports(found, costs))
