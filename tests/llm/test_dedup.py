"""Exact, substring, near and line dedup against plain versions."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pathmere.llm import exact, graph, lines, simhash, similar, substring
from llm_helpers import documents, odd_texts, words


def some_texts(n=150, seed=3):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "ab", "cd", "é", "fox"] + [f"w{i}" for i in range(40)]
    out = []
    for i in range(n):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 25, 60, 90])))
        out.append((i, text))
        if rng.random() < 0.4 and out:
            copy = rng.choice(out)[1]
            out[-1] = (i, copy if rng.random() < 0.5 else copy.replace("ab", "ab\t\n") + rng.choice(["", " fox"]))
    return out


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        out += [(i, keep[0], len(members), hashlib.sha256(norm.encode()).hexdigest()) for i, _ in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [some_texts(), odd_texts(), []])
@pytest.mark.parametrize("node_bytes", [50, exact.NODE_BYTES])
def test_exact_dedup(spark, rows, node_bytes, monkeypatch):
    monkeypatch.setattr(exact.decisions, "__defaults__", (node_bytes,))
    docs = documents(spark, rows).repartition(3)
    got = exact.exact_dedup(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute_exact(rows)
    kept = [r.doc_id for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got})
    left = exact.drop_copies(docs)
    assert left.columns == docs.columns and sorted(map(str, (r.doc_id for r in left.collect()))) == sorted(map(str, kept))


def test_exact_dedup_of_repeated_rows(spark):
    got = exact.exact_dedup(documents(spark, [(1, "a b"), (1, "a b"), (1, "ab"), (2, "c")])).collect()
    assert sorted((r.doc_id, r.group_size, r.kept) for r in got) == [(1, 3, False), (1, 3, False), (1, 3, True), (2, 1, True)]


def test_radix_groups():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 1, 7, 8, 9, 24, 25]))) for _ in range(400)]
    want = collections.defaultdict(list)
    for i, t in enumerate(texts):
        want[t].append(i)
    assert sorted(map(sorted, exact.radix_groups(texts))) == sorted(want.values())


def brute_substring(rows, window):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if (key := tuple(w[k : k + window])) in seen:
                gone[k : k + window] = [True] * window
            seen.add(key)
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [some_texts(), odd_texts(), [(1, "a " * 50), (1, "a " * 50), (1, "b")], []])
@pytest.mark.parametrize("sizes", [{}, {"part_bytes": 500, "block_items": 64}, {"part_bytes": 2000, "cell_bits": 12}])
def test_substring_dedup(spark, rows, sizes):
    got = substring.dedup(documents(spark, rows).repartition(3), **sizes)
    assert sorted(map(tuple, got.collect()), key=str) == brute_substring(rows, 20)


def brute_simhash(text):
    w = words("".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [(i, brute_simhash(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if bin(prints[a][1] ^ prints[b][1]).count("1") <= 2:
                parent[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(prints):
        least[find(k)].append(i)
    low = {k: None if None in v else min(v) for k, v in least.items()}
    return sorted(((i, f"{p:016x}", low[find(k)]) for k, (i, p) in enumerate(prints)), key=str)


@pytest.mark.parametrize("rows", [some_texts(), odd_texts(), []])
def test_near_components(spark, rows):
    docs = documents(spark, rows).repartition(3)
    got = [(r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in simhash.near_components(docs).collect()]
    assert sorted(got, key=str) == brute_components(rows)
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {r[2] for r in got}


@pytest.mark.parametrize("node_rows", [20, simhash.NODE_ROWS])
def test_trie_links_equal_all_pairs(spark, node_rows):
    rng = np.random.default_rng(0)
    near = []
    for _ in range(500):
        x = int(rng.integers(3)) << 61 | 12345
        for _ in range(rng.integers(0, 5)):
            x ^= 1 << int(rng.integers(64))
        near.append(x)
    values = np.unique(np.array(near + rng.integers(0, 2**63, 100).tolist(), np.uint64))
    fps = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    pairs = [(a, b) for a in range(len(values)) for b in range(a) if bin(int(values[a]) ^ int(values[b])).count("1") <= 2]
    edges = spark.createDataFrame([(int(values.view(np.int64)[a]), int(values.view(np.int64)[b])) for a, b in pairs], "a long, b long")
    groups = lambda e: {frozenset(v) for v in graph.components(e).toPandas().groupby("component").node.agg(list)}
    assert groups(simhash.links(fps, node_rows)) == groups(edges)


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(80)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(rows):
    texts = {}
    order = sorted(enumerate(rows), key=lambda r: (r[1][0] is not None, r[1][0] or 0, r[0]))
    for _, (_, t) in order:
        for x in (t or "").split("\n"):
            if y := x.strip(" \t\n\x0b\x0c\r"):
                texts.setdefault(y, {y[i : i + 8] for i in range(max(1, len(y) - 7))})
    keys = list(texts)
    parent = {k: k for k in keys}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(keys)):
        for b in range(a):
            x, y = texts[keys[a]], texts[keys[b]]
            if len(x & y) >= 0.8 * len(x | y):
                parent[find(keys[a])] = find(keys[b])
    seen, out = set(), []
    for _, (i, t) in order:
        kept, n = [], 0
        parts = (t or "").split("\n")
        for x in parts:
            y = x.strip(" \t\n\x0b\x0c\r")
            n += bool(y)
            if not y or find(y) not in seen:
                kept.append(x)
            if y:
                seen.add(find(y))
        out.append((i, n, len(parts) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_rows(seed=5):
    rng = random.Random(seed)
    base = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice([1, 3, 30, 60]))) for _ in range(25)]
    rows = []
    for i in range(60):
        own = []
        for _ in range(rng.randrange(6)):
            line = rng.choice(base)
            if rng.random() < 0.4:
                w = line.split()
                w[rng.randrange(len(w))] = "é" * rng.randrange(1, 4)
                line = " ".join(w)
            own.append(rng.choice(["", " "]) + line)
        rows.append((i, "\n".join(own)))
    return rows


@pytest.mark.parametrize("rows", [line_rows(), odd_texts(), [(2, "a\nb"), (1, "b\n\na"), (None, "a")], []])
def test_line_dedup(spark, rows):
    got = lines.dedup(documents(spark, rows).coalesce(1))
    assert sorted(map(tuple, got.collect()), key=str) == brute_lines(rows)


def test_line_groups_are_components():
    texts = ["abcdefghij" * 9 + "x" * i for i in range(0, 30, 5)] + ["something else entirely, you see", "é", "", "é" * 7]
    of = lines.grouped(texts)
    sets = [{t[i : i + 8] for i in range(max(1, len(t) - 7))} for t in texts]
    reach = {i: {j for j in range(len(texts)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in range(len(texts))}
    for _ in texts:
        reach = {i: set().union(*(reach[j] for j in r)) for i, r in reach.items()}
    assert of == [min(reach[i]) for i in range(len(texts))]


def test_lines_are_split_stripped_and_hashed_as_in_plain_text():
    blank = " \t\x0b\x0c\r"
    texts = [None, "", " \n ", "a", "b\n\na  ", "x", "\n", "y" + " " * 50 + "\nz", " " * 40 + "q w\n" + blank * 9, "é" * 7 + "\n" + "ü" * 20, "日本語の行です。長い行。\n 短い ", "z" * 9, blank * 5]
    plain = [(i, n, x.strip(blank)) for i, t in enumerate(texts) for n, x in enumerate((t or "").split("\n")) if x.strip(blank)]
    got = lines.Lines(pa.array(texts, pa.string()))
    assert [(d, p, bytes(got.data[a:b]).decode()) for d, p, a, b in zip(got.doc.tolist(), got.pos.tolist(), got.start, got.end)] == plain
    alone = [lines.Lines(pa.array([x])) for _, _, x in plain]
    assert got.h.tolist() == [x.h[0] for x in alone] and got.second().tolist() == [x.second()[0] for x in alone]
    assert got.bands().tolist() == [x.bands()[0].tolist() for x in alone]


def test_lines_that_share_bands_meet_once(spark, monkeypatch):
    """Near copies share up to ten bands; each meets the others in few groups, and no pair of a band is left out."""
    monkeypatch.setattr(lines, "SENT", 7)
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    texts = [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(60)] + [" ".join(f"v{rng.randrange(10**6)}" for _ in range(9)) for _ in range(40)]
    docs = documents(spark, [(i, "\n".join(texts[i : i + 3])) for i in range(len(texts))]).repartition(4)
    pairs = {(r.leader, r.line) for r in lines.repeated_bands(docs).collect()}
    one = lines.Lines(pa.array(["\n".join(texts)]))
    name = one.h.view(np.int64).tolist()
    bands = collections.defaultdict(set)
    for line, keys in zip(name, one.bands().tolist()):
        for key in keys:
            bands[key].add(line)
    groups = collections.defaultdict(set)
    for leader, line in pairs:
        groups[leader].add(line)
    shared = {frozenset(b) for b in bands.values() if len(b) > 1}
    assert shared and all(any(b <= g for g in groups.values()) for b in shared)
    assert {line for _, line in pairs} == set().union(*shared)
    assert len(pairs) < 0.6 * sum(map(len, shared))  # rows to compare; before, one for each line of each such set


def test_line_dedup_across_partitions(spark):
    rows = [r for r in line_rows(9) if r[0] != 7] + [(7, "é\nsome line that is long enough\n\n é ")]
    got = lines.dedup(documents(spark, rows).repartition(5))
    assert sorted(map(tuple, got.collect()), key=str) == brute_lines(rows)


def edited_texts(seed=7):
    """Texts with copies that have one to eight words replaced, so that Jaccard lies on both sides of 0.8."""
    rng = random.Random(seed)
    rows = []
    for _ in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([4, 40, 120, 300]))]
        for _ in range(rng.randrange(1, 7)):
            copy = list(base)
            for _ in range(rng.randrange(9)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), rng.choice([" ", "\n"]).join(copy).replace("w1", rng.choice(["w1", "W1"]))))
    return rows


def brute_similar(rows):
    sets = []
    for _, t in rows:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    part = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                part = [part[b] if p == part[a] else p for p in part]
    ids = [-(1 << 63) if i is None else i for i, _ in rows]
    return sorted((i, min(j for j, q in zip(ids, part) if q == p)) for i, p in zip(ids, part))


@pytest.mark.parametrize("rows", [edited_texts(), odd_texts(), []])
def test_similar_documents_of_the_pipeline_stage(spark, rows):
    import corpus_pipeline

    docs = documents(spark, rows).repartition(3)
    want = brute_similar(rows)
    assert sorted(map(tuple, similar.similar_components(docs).collect())) == want
    left = corpus_pipeline.without_near_copies(spark, docs, "")
    assert left.columns == docs.columns and {-(1 << 63) if r.doc_id is None else r.doc_id for r in left.collect()} == {c for _, c in want}


def test_trie_links_with_another_budget(spark):
    rng = np.random.default_rng(1)
    values = np.unique(np.array([12345 ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 6), False)) for _ in range(60)] + rng.integers(0, 2**63, 60).tolist(), np.uint64)).view(np.int64)
    fps = spark.createDataFrame([(int(v),) for v in values], "fp long")
    pairs = [(int(a), int(b)) for a in values for b in values if b < a and bin(int(a ^ b)).count("1") <= 4]
    groups = lambda e: {frozenset(v) for v in graph.components(e).toPandas().groupby("component").node.agg(list)}
    assert groups(simhash.links(fps, 20, 4, (13, 13, 13, 13, 12))) == groups(spark.createDataFrame(pairs, "a long, b long"))
    with pytest.raises(ValueError):
        simhash.links(fps, budget=3)
