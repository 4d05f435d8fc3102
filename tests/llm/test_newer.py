"""Lattice near-dedup, conversation repair and importance resampling against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from pathmere.llm import lattice, repair, resample
from llm_helpers import documents, odd_texts

VECTORS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
    T.StructField("node", T.StringType()), T.StructField("key", T.StringType()), T.StructField("x", T.StringType()),
])


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, "n", "k", "x") for i, v, label in rows], VECTORS)


def brute_links(rows, cosine=lattice.COSINE):
    def sound(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    unit = [np.array(np.array(v, np.float32), float) / np.linalg.norm(np.array(np.array(v, np.float32), float)) if sound(v, label) else None for _, v, label in rows]
    n = [[j for j in range(len(rows)) if j != i and rows[i][2] == rows[j][2] and unit[i] is not None and unit[j] is not None
          and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = set(n[todo.pop()]) - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(n[i]), min(ids, default=None), rows[i][0] == min(ids, default=None)))
    return sorted(out, key=str)


def odd_vectors():
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).tolist(), i % 3) for i in range(60)]
    centre = rng.normal(size=16)
    rows += [(100 + i, (centre + rng.normal(size=16) * 0.1).tolist(), 1) for i in range(40)]
    rows += [(200 + i, centre.tolist(), 1) for i in range(6)] + [(200, centre.tolist(), 1), (300, (3 * centre).tolist(), 1), (301, centre.tolist(), None), (302, centre.tolist(), 2)]
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 16, 1), (403, [None] + [1.0] * 15, 1), (404, [float("nan")] * 16, 1), (405, [float("inf")] * 16, 1)]
    rows += [(None, centre.tolist(), 1), (None, [1.0] * 16, 7), (500, [1.0, 2.0, 3.0], 1), (501, [1.0, 2.0, 3.0], 1), (502, [2.0, 4.0, 6.0], 1), (503, [-0.0, 1.0], 1), (504, [0.0, 1.0], 1)]
    return rows


@pytest.mark.parametrize("block", [lattice.BLOCK, 8])
@pytest.mark.parametrize("rows", [odd_vectors(), []])
def test_near_components(spark, rows, block):
    got = lattice.near_components(vectors(spark, rows).repartition(3), block=block).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == brute_links(rows)


def test_recall_of_links_at_the_threshold(spark):
    """Pairs at a cosine just above the threshold, where the lattice misses most, and pairs just below, which must not link."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(1500):
        u = rng.normal(size=64)
        u /= np.linalg.norm(u)
        w = rng.normal(size=64)
        w -= (w @ u) * u
        w /= np.linalg.norm(w)
        for k, c in enumerate((1.0, 0.9802 if i % 3 else 0.9798)):
            rows.append((2 * i + k, (c * u + math.sqrt(1 - c * c) * w).tolist(), 0))
    got = {r.vec_id: r.n_links for r in lattice.near_components(vectors(spark, rows)).collect()}
    near = [got[2 * i] for i in range(1500) if i % 3]
    assert sum(near) >= 0.998 * len(near) and not any(got[2 * i] for i in range(0, 1500, 3))


def test_decode_finds_the_nearest_lattice_point():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)) * 2
    found = lattice.decode(x)
    near = lattice.least_vectors()
    assert len(near) == 240 and np.allclose((near**2).sum(axis=1), 2)
    best = ((x - found) ** 2).sum(axis=1)
    for steps in (near, 2 * near[:112:5]):
        assert (best[:, None] <= ((x[:, None] - found[:, None] - steps[None]) ** 2).sum(axis=2) + 1e-9).all()
    whole = np.rint(2 * found) % 2
    assert ((whole == whole[:, :1]).all(axis=1)).all() and (np.rint(found.sum(axis=1)) % 2 == 0).all()


def all_repairs(turns, costs, inserts):
    """Cost and letters of every edit sequence with at most so many inserts."""
    found = []

    def walk(k, left, cost, letters, roles):
        if k == len(turns) // 2:
            if re.fullmatch("(s?(ua)+)?", roles):
                found.append((cost, letters))
        else:
            x, fault = turns[2 * k], turns[2 * k + 1]
            walk(k + 1, left, cost + costs.delete, letters + "D", roles)
            if fault not in "BD":
                more = costs.truncated * (fault == "T")
                walk(k + 1, left, cost + costs.keep + more, letters + "K", roles + x)
                for role in "ua":
                    walk(k + 1, left, cost + costs.rerole + more, letters + "R", roles + role)
        if left:
            for role in "ua":
                walk(k, left - 1, cost + costs.insert, letters + "I", roles + role)

    walk(0, inserts, 0, "", "")
    return min(found)


@pytest.mark.parametrize("costs", [repair.COSTS, repair.Costs(0, 3, 4, 1, 2), repair.Costs(1, 1, 1, 1, 1), repair.Costs(0, 9, 3, 2, 1)])
def test_cheapest_edits(costs):
    rng = random.Random(4)
    cases = ["", "s-", "u-", "a-", "uTaB", "u-uD"] + ["".join(rng.choice("suua-") + rng.choice("---BDT") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    for turns in cases:
        assert repair.cheapest(turns, costs) == all_repairs(turns, costs, 4), turns


def test_long_conversation_is_repaired():
    turns = "u-a-" * 1500 + "uDaBuT" + "a-u-" * 1500
    cost, audit = repair.cheapest(turns)
    assert len(audit) == len(turns) // 2 and cost == 5 * repair.COSTS.delete and set(audit) == {"K", "D"}


CONVERSATIONS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("seq", T.StringType()), T.StructField("gone", T.StringType()), T.StructField("fault", T.IntegerType()),
])


def some_conversations():
    rng = random.Random(6)
    rows = []
    for c in [*range(60), None]:
        for t in range(rng.randint(1, 7)):
            role = rng.choice(["user", "assistant", "system", "tool", "", None]) if rng.random() < 0.4 else ("user", "assistant")[t % 2]
            text = rng.choice(["Hello.", "what", "Yes! ", "", " \t", None, "é?\x0b", "ends", "Über. x", "z" * 3000 + "."])
            rows.append((c, rng.choice([t, t, t, t * 2, None]), role, text))
    return rows + rows[:3] + [(77, None, "user", "a."), (77, None, "user", "a.")]


def brute_repair(rows):
    groups = {}
    for c, t, role, text in rows:
        own = groups.setdefault(c, [])
        role, text = (" " if x is None else x for x in (role, text))
        part = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if part == 1 else re.sub("[.!?]", "", text) if part == 2 else text
        own += [(t, "user" if part == 4 else role, text)] * (0 if part == 0 else 2 if part == 3 else 1)
    out = []
    for c, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in own:
            body = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("B" if not body else "D" if (role, text) in seen else "-" if body[-1] in ".!?" else "T")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        initials = [role[:1] for _, role, _ in own]
        cost, audit = all_repairs("".join((x or "-") + f for x, f in zip(initials, faults)), repair.COSTS, 1)
        lines, expect, k = [], "", 0
        for letter in audit:
            nxt = "assistant" if expect == "a" else "user"
            role, text = ("", "") if letter == "I" else own[k][1:]
            k += letter != "I"
            if letter != "D":
                role = role if letter == "K" else nxt
                lines.append(f"{role}:{text}")
                expect = "a" if role[:1] == "u" else "u"
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in itertools.pairwise(initials))
        out.append((c, gaps, *(faults.count(f) for f in "BDT"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [some_conversations(), []])
def test_repair(spark, rows):
    table = spark.createDataFrame([(*r, "s", "g", 1) for r in rows], CONVERSATIONS).repartition(3)
    turns = repair.repair(repair.damaged(table))
    got = repair.digests(turns).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_repair(rows)
    edits = {}
    for r in sorted((r for r in turns.collect() if r.pos >= 0), key=lambda r: (str(r.conv_id), r.pos)):
        edits.setdefault(r.conv_id, []).append(r.role[:1])
    assert all(re.fullmatch("s?(ua)+", "".join(x)) for x in edits.values())


def test_repair_of_sound_conversations_keeps_all(spark):
    table = spark.createDataFrame([(1, 0, "system", "Be brief."), (1, 1, "user", "Why?"), (1, 2, "assistant", "So.")], "conv_id long, turn long, role string, text string")
    got = repair.digests(repair.repair(repair.sound_rows(table))).first()
    assert (got.cost, got.audit) == (0, "KKK") and got.repaired_sha256 == hashlib.sha256(b"system:Be brief.\nuser:Why?\nassistant:So.").hexdigest()


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_resample(docs, target, percent=25, least=20, buckets=10_000):
    def features(text):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return len(w), [zlib.crc32(f.encode()) % buckets for f in w + [f"{a} {b}" for a, b in itertools.pairwise(w)]]

    found = [(i, *features(t)) for i, t in docs]
    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for _, _, f in found:
        np.add.at(s, f, 1)
    for text in target:
        np.add.at(t, features(text)[1], 1)
    gain = [math.floor(1000 * math.log((float(b) + 1) * (float(s.sum()) + buckets) / ((float(a) + 1) * (float(t.sum()) + buckets)))) for a, b in zip(s, t)]
    out = []
    for i, words, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def many_texts():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(80)] + ["Éa", "x" * 60, "the", "OF", "1,2"]
    rows = [(i, "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\n", "\n\n", ", ", "-"]) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    return rows + [(i, "same line of text here\n" * 12) for i in range(200, 230)] + [(5, rows[5][1])] + odd_texts()


@pytest.mark.parametrize("rows", [many_texts(), odd_texts(), []])
def test_resample(spark, rows):
    target = [None, "", "w1 w2 w3\nthe w4", "Same LINE of"]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = [tuple(r) for r in resample.resample(documents(spark, rows).repartition(3), table).collect()]
    assert sorted(got, key=str) == brute_resample(rows, target)


def test_resample_to_an_empty_target(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    got = [tuple(r) for r in resample.resample(documents(spark, many_texts()), empty).collect()]
    assert sorted(got, key=str) == brute_resample(many_texts(), [])
